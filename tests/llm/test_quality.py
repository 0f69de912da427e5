import re
from collections import Counter

from tallyforge.llm import quality_model, quality_rules
from tallyforge.llm.common import doc_fold
from tallyforge.llm.statistics import repeats

import numpy as np


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, odd, none):
    texts = {i: t for i, t in enumerate(["a b c a b c a", "x\nx\n x\n\n\r\nx", "#* é€𝄞 |", "a b", None, "", "a a a a", "\x0b\x0cq\x1cr s"])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in quality_rules.ledger(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), texts[r.doc_id]
    book = quality_rules.ledger(odd)
    assert book.count() == odd.count() and quality_rules.ledger(none).count() == 0
    for r in quality_rules.verdicts(book).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_windows_of_many_words_are_exact():
    numbers = np.arange(5000) + (1 << 21)
    assert repeats(numbers) == (0, 5000)
    assert repeats(np.concatenate([numbers[:4], numbers[:3]])) == (6, 4)


def test_ablation_is_what_dropping_a_rule_does(spark):
    book = quality_rules.ledger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    policy = quality_rules.POLICIES["web-1"]
    rows = {r["rule"]: r for r in quality_rules.ablation(book, "web-1").collect()}
    bits = [r.failed for r in book.collect()]
    for rule in policy.rules:
        less = policy.mask & ~quality_rules.BIT[rule]
        assert rows[rule].n_kept_without == sum(b & less == 0 for b in bits)
        assert rows[rule].n_failed == sum(bool(b & quality_rules.BIT[rule]) for b in bits)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(r.kept, r.base_failed, labels[r.doc_id]) for r in quality_rules.verdicts(book).collect() if r.doc_id in labels]
    assert not any(kept and q == 0 for kept, _, q in judged)
    assert sum(not kept and not base for kept, base, q in judged if q == 1) <= 1


def test_model_separates_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = doc_fold("doc_id", 4) == 2
    rows = quality_model.score_quality(docs, labels, ~held).join(labels, "doc_id").where(held).collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_model_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, None), (7, 0), (5, 1)], "doc_id long, quality int")
    rows = quality_model.score_quality(odd, labels, doc_fold("doc_id", 4) >= 0).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_model.score_quality(odd, labels.limit(0), doc_fold("doc_id", 4) >= 0).collect()} == {0.5}
    assert quality_model.score_quality(none, labels, doc_fold("doc_id", 4) >= 0).count() == 0


def plain_gap(x, y, at, pooled, ridge):
    """Log-density of class 1 less that of class 0 at each row of ``at``, by explicit covariances, determinants and solves."""
    within = sum(np.cov(x[y == c].T, bias=True) * (y == c).sum() for c in (0, 1)) / len(y)
    scale, out = np.sqrt(np.diag(within)), []
    for c in (0, 1):
        own = (1 - pooled) * np.cov(x[y == c].T, bias=True) + pooled * within
        own = own / np.outer(scale, scale)
        own = ((1 - ridge) * own + ridge * np.trace(own) / len(own) * np.eye(len(own))) * np.outer(scale, scale)
        far = at - x[y == c].mean(axis=0)
        out.append(np.log((y == c).mean()) - np.linalg.slogdet(own)[1] / 2 - np.einsum("ij,ij->i", far, np.linalg.solve(own, far.T).T) / 2)
    return out[1] - out[0]


def test_the_discriminant_is_the_plain_one(spark):
    rng = np.random.default_rng(3)
    y = np.repeat([0, 1], [120, 60])
    x = rng.normal(size=(180, 4)) @ rng.normal(size=(4, 4)) * [1, 50, 0.01, 3] + np.outer(y, [0.5, 20, 0.02, -1])
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(int(k), *map(float, r)) for k, r in zip(y, x, strict=True)], "y int, a double, b double, c double, d double")
    for pooled, ridge in ((0.1, 0.01), (0.5, 0.3)):
        model = quality_model.fit(df, "y", names, pooled, ridge)
        got = np.array([r.g for r in df.select((model[1].log_density(names) - model[0].log_density(names)).alias("g")).collect()])
        assert np.allclose(got, plain_gap(x, y, x, pooled, ridge), rtol=1e-6, atol=1e-6)
