import corpus_pipeline
from tallyforge.llm import catalog, decontaminate, near_dup, toxicity
from tallyforge.llm.common import doc_fold

SF = "/root/testdata/sf0.001"


def test_stages_decide_as_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    clean = stages["toxicity"](spark, docs, SF).cache()
    assert clean.columns == docs.columns
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, labels, doc_fold("doc_id", 5) != 0).where("predicted = 1").collect()}
    assert ids(clean) == sorted(set(ids(docs)) - toxic)
    unique = stages["near_duplicates"](spark, clean, SF).cache()
    assert ids(unique) == sorted(r.doc_id for r in near_dup.near_duplicates(clean, 5, 80).where("kept").collect())
    sound = stages["decontamination"](spark, unique, SF).cache()
    leaks = {r.doc_id for r in decontaminate.contaminated(unique, bench).collect()}
    assert ids(sound) == sorted(set(ids(unique)) - leaks)
    private = stages["pii"](spark, sound, SF).cache()
    assert private.schema == sound.schema and ids(private) == ids(sound)
    packed = stages["packing"](spark, private, SF)
    assert sorted({r.doc_id for r in packed.collect()}) == ids(private)


def test_odd_rows_pass_through(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert out.where("doc_id is null").count() == 2, name
        assert stage(spark, none, SF).count() == 0, name


def test_rows_are_decided_one_by_one(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    scored = toxicity.score_toxicity(docs, labels, doc_fold("doc_id", 5) != 0)
    bad = scored.join(labels, "doc_id", "left_anti").where("predicted = 1").first().doc_id
    good = scored.join(labels, "doc_id", "left_anti").where("predicted = 0").first().doc_id
    item = bench.first().text
    mixed = lambda texts: spark.createDataFrame([(-1, texts[0]), (-1, texts[1]), (None, texts[0]), (None, texts[1])], "doc_id long, text string")
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.where("doc_id is null or doc_id < 0").collect()), key=str)
    text = {r.doc_id: r.text for r in docs.where(docs.doc_id.isin(bad, good)).collect()}
    more = docs.select("doc_id", "text").union(mixed([text[bad], text[good]]))
    assert left(stages["toxicity"](spark, more, SF)) == sorted([(-1, text[good]), (None, text[good])], key=str)
    texts = [f"so it says {item} and more", "nothing of that kind is in here at all"]
    assert left(stages["decontamination"](spark, mixed(texts), SF)) == sorted([(-1, texts[1]), (None, texts[1])], key=str)
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(3, words), (2, words + " end"), (2, words), (2, words), (2, "quite another text under the same number"), (None, words), (None, words)]
    unique = stages["near_duplicates"](spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    linked = [r.doc_id for r in unique if r.text.startswith(words)]
    assert sorted(linked, key=str) == [2, None] and (2, rows[4][1]) in [(r.doc_id, r.text) for r in unique] and len(unique) == 3


def test_catalog_has_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries()) == list(range(1, 11))


def test_rule_verdicts_match_their_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    for name, sql in catalog.oracle_sql().items():
        mine = catalog.queries()[name](spark, SF)
        want = db.sql(sql).fetchall()
        cols = [c[0] for c in db.sql(sql).description]
        assert sorted(map(tuple, mine.select(*cols).collect())) == sorted(want), name
