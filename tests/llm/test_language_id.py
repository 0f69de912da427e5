import numpy as np

from tallyforge.llm import language_id as li
from tallyforge.llm.common import doc_fold


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = doc_fold("doc_id", 3) == 1
    rows = li.predict(docs, li.fit(docs, ~held)).where(held).join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.96
    assert all(0 <= r.score <= 1 for r in rows)


def test_tables_give_the_convolution():
    rng = np.random.default_rng(0)
    net = li.Network(("a", "b"), {w: rng.normal(size=(w, li.CLASSES, li.FILTERS)).astype(np.float32) for w in li.WIDTHS}, rng.normal(size=48).astype(np.float32), rng.normal(size=(48, 2)).astype(np.float32), np.zeros(2, np.float32))
    windows = rng.integers(0, li.CLASSES, (3, li.WINDOW)).astype(np.uint8)
    pooled = []
    for i, w in enumerate(li.WIDTHS):
        seen = np.array([[sum(net.filters[w][j][x[p + j]] for j in range(w)) for p in range(li.WINDOW - w + 1)] for x in windows])
        pooled.append(seen.max(1) + net.bias[i * li.FILTERS : (i + 1) * li.FILTERS])
    logits = np.maximum(np.concatenate(pooled, 1), 0) @ net.weights
    want = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    assert np.allclose(net.log_probabilities(windows, net.pair_tables()), want, atol=1e-3)


def test_every_byte_is_in_a_window():
    text = bytes(range(97, 123)) * 40
    assert (li.cut(text, li.byte_classes()).ravel()[: len(text)] == np.frombuffer(text, np.uint8) - 97).all()


def test_odd_rows(spark, odd, none):
    net = li.fit(odd, doc_fold("doc_id", 3) >= 0)
    rows = {r.doc_id: r for r in li.predict(odd, net).collect() if r.doc_id is not None}
    assert rows[2].lang_pred == rows[3].lang_pred == rows[4].lang_pred == rows[7].lang_pred == "und" and rows[2].score == 0.0
    assert rows[5].lang_pred in ("de", "en")
    assert li.predict(none, net).count() == 0
    assert {r.lang_pred for r in li.predict(odd, li.fit(none, doc_fold("doc_id", 3) >= 0)).collect()} == {"und"}
