import numpy as np

from tallyforge.llm import toxicity
from tallyforge.llm.common import doc_fold


def all_runs(s):
    """Maximal runs by their definition: the best run, then the same left and right of it."""

    def rec(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += s[j]
                if total > 0 and (best is None or total > best[2] + 1e-12):
                    best = (i, j + 1, total)
        return [] if best is None else [*rec(a, best[0]), best, *rec(best[1], b)]

    return rec(0, len(s))


def test_runs_are_maximal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.normal(-0.3, 1, rng.integers(0, 25))
        got, want = toxicity.maximal_runs(s), all_runs(s)
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert np.allclose([r[2] for r in got], [r[2] for r in want])


def planted(spark, n=600):
    rng = np.random.default_rng(5)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for d in range(n):
        words = rng.choice(clean, rng.integers(20, 400)).tolist()
        toxic = d % 6 == 0
        for _ in range(3 * toxic):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["vile", "Foul!", "rotten,"])))
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_planted_passages_are_found(spark):
    docs, labels = planted(spark)
    held = doc_fold("doc_id", 5) == 0
    rows = toxicity.score_toxicity(docs, labels, ~held).join(labels, "doc_id").join(docs, "doc_id").where(held).collect()
    assert len(rows) > 50 and all((r.predicted == 1) == (r.toxic == 1) for r in rows)
    for r in rows:
        for p in r.passages:
            assert {w.strip("!,").lower() for w in r.text.split()[p.start : p.end]} & {"vile", "foul", "rotten"}


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, None), (7, 0), (5, 0)], "doc_id long, toxic int")
    always = doc_fold("doc_id", 5) >= 0
    rows = toxicity.score_toxicity(odd, labels, always).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.score_toxicity(odd, labels.limit(0), always).collect()} == {0.0}
    assert toxicity.score_toxicity(none, labels, always).count() == 0


def test_memory_bound_changes_no_result(spark, odd):
    docs, labels = planted(spark)
    docs = docs.unionByName(odd.select("doc_id", "text"))
    known = doc_fold("doc_id", 5) != 0
    counts = toxicity.token_counts(docs, labels.where(known), "toxic")
    model = toxicity.learn(counts, max_tokens=1)
    assert len(model.scores) == 1 and model.rest.count() >= 2
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score, [tuple(p) for p in r.passages])
    want, got = (sorted(map(key, toxicity.score_toxicity(docs, labels, known, max_tokens=most).collect())) for most in (50_000, 1))
    assert got == want and any(passages for *_, passages in want)
