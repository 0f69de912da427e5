import random

import pytest

from tallyforge.llm import near_dup
from tallyforge.llm.shingles import shingle_set


def brute(rows, width):
    """Components by comparing every pair of whole sets; rows of one doc_id are linked too."""
    named = [(i, shingle_set((t or "").encode(), width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in named}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (a, x) in enumerate(named):
        for b, y in named[k + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted((i, len(s), root(i)) for i, s in named)


def same(df, rows, width):
    got = near_dup.near_duplicates(df, width).collect()
    assert len(got) == len(rows)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(rows, width)


@pytest.mark.parametrize("width", [2, 5])
def test_documents(spark, width):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    same(docs, [(r.doc_id, r.text) for r in docs.collect()], width)


def test_a_large_group_of_near_copies_around_a_base(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(1000, " ".join(base))]
    for i in range(300):  # many pairs of copies are below the threshold though both link with others
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(2000 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(40))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(df, rows, 2)


def test_one_id_with_several_texts(spark):
    x, y, z = (" ".join(f"{k}{i}" for i in range(40)) for k in "xyz")
    rows = [(3, x), (5, x), (5, y), (7, y + " more"), (9, z), (9, z), (9, None), (11, z + " end"), (None, y), (12, "short"), (13, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(df, rows, 2)
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 2).collect()}
    assert (found[3], found[5], found[7], found[9], found[11]) == (3, 3, 3, 9, 9)


def test_a_hot_group_of_thousands_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(5000):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        rows.append((i + 7, " ".join(words)))
    rows += [(9000 + i, " ".join(base[:40]) + " " + " ".join(f"q{i}x{j}" for j in range(20))) for i in range(100)]  # share much, but too little
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.component_id for r in got if r.doc_id < 9000} == {7}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id >= 9000)


def test_odd_rows(spark, odd, none):
    same(odd, [(r.doc_id, r.text) for r in odd.collect()], 2)
    assert near_dup.near_duplicates(none, 2).count() == 0


def test_blocks_and_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 103), (101, 103), (102, 103)], "x long, y long")
    got = {r.node: r.comp for r in near_dup.components(edges).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 104), 100)
