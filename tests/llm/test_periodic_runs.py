import hashlib
import zlib

import numpy as np
import pytest

from tallyforge.llm import periodic_runs
from tallyforge.llm.catalog import op11_periodic_runs


def plain_runs(words, least=12):
    """Every period tried at every place."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at < len(words) - q:
            end = at
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            if end - at >= max(q, least - q):
                found.setdefault((at, end + q), q)
            at = max(end, at + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng):
    n, kinds = int(rng.integers(0, 300)), int(rng.choice([1, 2, 3, 40, 1000]))
    words = [b"w%d" % x for x in rng.integers(0, kinds, n)]
    for _ in range(int(rng.integers(0, 4))):
        if n > 4:
            a = int(rng.integers(0, n - 2))
            p = int(rng.integers(1, max(2, (n - a) // 2)))
            for i in range(a + p, min(n, a + int(rng.integers(p, n)))):
                words[i] = words[i - p]
    return words


def test_runs_are_those_of_brute_force():
    rng = np.random.default_rng(5)
    for least in (2, 12, 12, 40):
        texts = [some_words(rng) for _ in range(80)]
        counts, per, runs, collapsed = periodic_runs._batch([b" ".join(t) for t in texts], least)
        ends = np.cumsum(per)
        assert counts.tolist() == [len(t) for t in texts]
        for words, a, b, text in zip(texts, ends - per, ends, collapsed, strict=True):
            want = plain_runs(words, least)
            assert [tuple(r) for r in runs[a:b].tolist()] == want
            assert text == plain_collapsed(words, want)


def test_words_with_many_runs():
    short, long = [b"a"], [b"a", b"b"]  # Fibonacci words have nearly as many runs as words
    while len(long) < 700:
        short, long = long, long + short
    for words in (long, [b"x"] * 500, [b"x", b"y", b"z"] * 150 + [b"x"], [b"a", b"b"] * 40 + [b"c"] + [b"a", b"b"] * 40 + [b"c"]):
        _, _, runs, collapsed = periodic_runs._batch([b" ".join(words)], 12)
        assert [tuple(r) for r in runs.tolist()] == plain_runs(words)
        assert collapsed[0] == plain_collapsed(words, plain_runs(words))


@pytest.mark.parametrize("size", [1, 4, 8, 64])
def test_convolution_is_exact_modulo_each_prime(size):
    rng = np.random.default_rng(size)
    blocks, windows = rng.integers(0, 50_000, (size, 3)), rng.integers(0, 50_000, (3 * size, 3))
    want = np.array([[sum((blocks[j, c] - windows[d + j, c]) ** 2 for j in range(size)) for c in range(3)] for d in range(2 * size + 1)])
    for prime, root in periodic_runs.PRIMES:
        assert pow(root, (prime - 1) // 2, prime) == prime - 1  # so its powers have all even orders that divide prime - 1
        assert (periodic_runs.squared_differences(blocks, windows, prime, root) == want % prime).all()


def test_a_sum_that_is_a_multiple_of_one_prime_is_no_copy(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PRIMES", ((97, 5), (193, 5), *periodic_runs.PRIMES[:2]))
    ids = np.arange(1000, 1050)
    ids[30:38] = ids[16:24] = ids[:8]
    ids[16] += 97  # the squared difference is a multiple of the first prime
    block, distance = periodic_runs.occurrences(ids, np.array([0]), np.array([50]), 8)
    assert list(zip(block.tolist(), distance.tolist(), strict=True)) == [(0, 30)]


def test_odd_rows(spark, odd, none):
    rows = periodic_runs.periodic_runs(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id in (2, 3, 4):
            assert (r.n_words, r.runs, r.collapsed) == (0, [], "")
    long = next(r for r in rows if r.doc_id == 5)
    assert long.n_words == 120_000 and [tuple(x) for x in long.runs] == [(0, 120_000, 997 * 31)] and len(long.collapsed.split()) == 997 * 31
    assert periodic_runs.periodic_runs(none).count() == 0
    digest = {r.doc_id: r for r in periodic_runs.run_digest(periodic_runs.periodic_runs(odd)).collect()}
    assert tuple(digest[3])[1:6] == (0, None, None, None, None) and digest[3].runs_sha256 == digest[3].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert digest[5].exponent_milli == 120_000_000 // (997 * 31)


def test_query_is_brute_force(spark, tmp_path):
    """The registered query, planted repeats included."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) < 500]
    rows += [(None, "a b " * 20), (100_000, None), (100_001, " \t")] + [(200_000 + i, f"x{i} " * i) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        words = (text or "").encode().split()
        n = len(words)
        if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
        want = (doc_id, len(runs), *best, milli, hashlib.sha256(lines).hexdigest(), hashlib.sha256(plain_collapsed(words, runs)).hexdigest())
        assert tuple(got[doc_id]) == want
    assert planted > 5
