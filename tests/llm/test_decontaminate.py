import random

from tallyforge.llm import decontaminate as dc


def distance(item, text):
    """Least edit distance of item to any run of text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_alignment_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        item = [rng.choice(b"abc").to_bytes() for _ in range(rng.randrange(1, 9))]
        text = [rng.choice(b"abc").to_bytes() for _ in range(rng.randrange(0, 20))]
        d, a, b = dc.align(item, text)
        assert d == distance(item, text) == edit(item, text[a:b])


def planted(benchmark, edits, n, seed):
    rng = random.Random(seed)
    rows, want = [], set()
    for d in range(n):
        item, text = rng.choice(benchmark)
        words = text.split()
        for _ in range(edits):
            at, how = rng.randrange(len(words)), rng.random()
            if how < 0.4:
                words[at] = f"zz{rng.randrange(9999)}"
            elif how < 0.7:
                words.insert(at, f"yy{rng.randrange(9999)}")
            else:
                words.pop(at)
        around = [f"q{rng.randrange(500)}" for _ in range(rng.randrange(0, 300))]
        at = rng.randrange(len(around) + 1)
        rows.append((d, " ".join([*around[:at], *words, *around[at:]])))
        want.add((d, item))
    return rows, want


def test_planted_items(spark):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    for edits, recall in ((0, 1.0), (1, 0.98), (2, 0.96), (3, 0.93)):
        rows, want = planted(items, edits, 300, edits)
        got = {(r.doc_id, r.item_id) for r in dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
        assert len(got & want) >= recall * len(want)
        assert len(got - want) <= 2


def test_all_allowed_edits_are_found(spark):
    rng = random.Random(9)
    long = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    short = [(1000 + i, " ".join(f"s{rng.randrange(300)}" for _ in range(5 + i % 4))) for i in range(80)]
    bench = spark.createDataFrame(long + short, "item_id long, text string")
    text_of = dict(long + short)
    for items in (long, short):
        for share in (0.1, 0.15, 0.2, 0.25):
            rows, want = [], set()
            for d in range(200):
                one = rng.choice(items)
                (row,), pair = planted([one], int(share * len(one[1].split())), 1, rng.random())
                rows.append((d, row[1]))
                want |= {(d, i) for _, i in pair}
            got = {(r.doc_id, r.item_id): r.distance for r in dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
            assert want <= set(got)
            for (d, i), e in got.items():
                assert e == distance(dc.tokens(text_of[i].encode()), dc.tokens(rows[d][1].encode()))


def test_documents_by_brute_force(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: dc.tokens(r.text.encode()) for r in bench.collect()}
    want = {}
    for r in docs.where("length(text) < 3000").collect():
        words = dc.tokens(r.text.encode())
        for i, item in items.items():
            if len(item) - len(set(item) & set(words)) <= 0.5 * len(item) and (d := distance(item, words)) <= int(0.25 * len(item)):
                want[r.doc_id, i] = d
    got = {(r.doc_id, r.item_id): r.distance for r in dc.contaminated(docs.where("length(text) < 3000"), bench, block_items=7).collect()}
    assert got == want and want


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Ofira"), (2, "blue Ofira"), (3, "why blue Ofira?"), (4, "who saw blue Ofira"), (5, "光合作用发生在叶绿体中。"), (6, "แมวอยู่บนเสื่อ"), (7, "ひかりはどこから"), (8, "什么")]
    docs = [
        (1, "see ofira."), (2, "a blue, OFIRA b"), (3, "x why blue ofira y"), (4, "who has blue Ofira"), (5, "Ofira blue"),
        (6, "我们知道光合作用发生在叶绿体中，是吗"), (7, "我们知道光合反应发生于叶绿体里，是吗"), (8, "ฉันเห็นแมวอยู่บนเสื่อนั้น"), (9, "さてひかりはどこへ"), (10, "说什么呢"), (11, "caf\u00e9 \u2019 na\u00efve"), (12, "光合反应不发生叶"),
    ]
    want = {}
    for d, text in docs:
        for i, item in items:
            a, b = dc.tokens(item.encode()), dc.tokens(text.encode())
            if (e := distance(a, b)) <= len(a) // 4:
                want[d, i] = e
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (6, 5), (8, 6), (9, 7), (10, 8)} <= set(want) and not any(d in (11, 12) for d, _ in want)
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.distance for r in got.collect()} == want


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, "one two"), (None, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6"), (1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.distance) for r in dc.contaminated(odd, bench).collect()]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=key) == sorted([(d, 1, 0) for d in (None, 1, 6, 6) for _ in range(2)] + [(5, None, 0)], key=key)
    assert dc.contaminated(none, bench).count() == 0 and dc.contaminated(odd, bench.limit(0)).count() == 0


def test_word_hashes_of_short_and_long_texts_agree():
    text = b'a "bc" def... ?! x' + "é ünï-code".encode() + b" tail,"
    known = {w: h for w, h in zip(dc.tokens(text), dc.word_hashes(text).tolist(), strict=True)}
    long = b" ".join([text] * 2000)  # beyond the table of powers
    assert len(text) < len(dc._POWERS) <= len(long)
    assert dc.word_hashes(long).tolist() == [known[w] for w in dc.tokens(long)]
    assert len(dc.word_hashes(b"  ")) == 0 and dc.word_hashes(b"def").tolist() == [known[b"def"]]
