"""Operator 10, toxicity: maximum-scoring segments over token log-odds, calibrated as extreme values.

* Token scores: log-odds of toxic against clean labelled documents with a Dirichlet prior in proportion to the corpus
  counts; a token has a score if its odds stand ``z_least`` standard errors off even. All labelled rows are counted. Tasks
  hold the ``max_tokens`` surest tokens; all others, where there are more, come to the texts by a join, so that the bound
  changes no result.
* Passages: a linear-time scan finds all maximal-scoring runs of words (every other word costs ``drift``).
* Calibration: for scores of clean text, the number of passages of score S in n words is K n exp(-lambda S); lambda solves
  the moment equation over the clean token distribution, K comes from the clean labelled documents. A passage is
  significant if fewer than ``expect`` such would be expected; a document's evidence sums lambda S - ln(K n) over its
  significant passages, and a logistic curve of it, fitted on counts of labelled documents, gives the probability.

Edge cases: null and empty texts have no word and no passage and get the score of no evidence; without labels of both
kinds every score is the share of toxic ones (0 without labels); texts of any length are scanned whole; repeated rows
count as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import materialize, map_batches, text_parts

#: Up to so many labels (12 bytes each) they go to the documents by broadcast, beyond it by shuffle.
BROADCAST_LABELS = 2_000_000
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


@dataclass(frozen=True)
class Model:
    scores: dict[bytes, float]
    drift: float
    decay: float  # lambda
    rest: DataFrame | None = None  # token, score of all that ``scores`` has no room for


def token_counts(docs: DataFrame, labels: DataFrame, label: str, flush: int = 100_000) -> DataFrame:
    """token, n0, n1: occurrences in clean and in toxic labelled documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})

        def rows() -> pa.RecordBatch:
            tokens = [*counts[0].keys(), *(t for t in counts[1] if t not in counts[0])]
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), *(pa.array([c.get(t, 0) for t in tokens], pa.int64()) for c in counts)], ["token", "n0", "n1"])

        for batch in batches:
            kinds = batch.column(0).to_pylist()
            for part, texts in text_parts(batch):
                for y, text in zip(kinds[part], texts, strict=True):
                    mine = counts[y]
                    for w in text.lower().split():
                        t = w.strip(_MARKS)
                        mine[t] = mine.get(t, 0) + 1
                if len(counts[0]) + len(counts[1]) > flush:
                    yield rows()
                    counts[0].clear()
                    counts[1].clear()
        yield rows()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id").select("y", "text")
    return texts.transform(map_batches, run, "token binary, n0 long, n1 long").where("length(token) > 0").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def learn(counts: DataFrame, max_tokens: int = 50_000, prior: float = 0.05, z_least: float = 3.0, drift: float = 0.5) -> Model | None:
    """Log-odds with a prior of ``prior`` pseudo-counts for each count, for all tokens whose odds are sure."""
    counts = materialize(counts, "token_counts")
    all0, all1 = (int(v or 0) for v in counts.agg(F.sum("n0"), F.sum("n1")).first())
    if not all0 or not all1:
        return None
    n0, n1 = all0 + prior * (all0 + all1), all1 + prior * (all0 + all1)
    a = prior * (F.col("n0") + F.col("n1"))
    y0, y1 = F.col("n0") + a, F.col("n1") + a
    odds = F.log(y1 / (n1 - y1)) - F.log(y0 / (n0 - y0))
    z = odds / F.sqrt(1 / y0 + 1 / y1)
    rated = counts.select("token", (odds - drift).alias("score"), F.abs(z).alias("z"), (y0 / n0).alias("p0"))
    sure = materialize(rated.where(F.col("z") >= z_least), "sure_tokens")
    top = sure.orderBy(F.col("z").desc(), "token").limit(max_tokens).select("token", "score", "z").collect()
    # the moment equation sees scores to three decimals, so that what is gathered doesn't grow with the tokens
    shares = sure.groupBy(F.round("score", 3).alias("s")).agg(F.sum("p0").alias("p"), F.max("score").alias("most")).collect()
    if not any(r["most"] > 0 for r in shares):
        return None
    rest = None
    if len(top) == max_tokens:
        z_last, last = top[-1]["z"], F.lit(bytes(top[-1]["token"]))
        rest = sure.where((F.col("z") < z_last) | ((F.col("z") == z_last) & (F.col("token") > last))).select("token", "score")
        rest = None if rest.isEmpty() else rest
    s, p = np.array([*(r["s"] for r in shares), -drift]), np.array([r["p"] for r in shares])
    p = np.append(p, max(0.0, 1 - p.sum()))
    low, high = 0.0, 1.0
    if p @ s < 0:  # the root of sum p exp(lambda s) = 1 beyond 0
        while p @ np.exp(high * s) < 1 and high < 64:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if p @ np.exp(mid * s) < 1 else (low, mid)
    return Model({bytes(r["token"]): r["score"] for r in top}, drift, high, rest)


def maximal_runs(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring runs (start, end, score), in order; each word is looked at a bounded number of times."""
    gains = np.flatnonzero(scores > 0)
    if not len(gains):
        return []
    after = np.cumsum(scores, dtype=np.float64)
    runs: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum at its end
    for k in gains.tolist():
        start, left, right = k, float(after[k] - scores[k]), float(after[k])
        held: list[tuple[int, int, float, float]] = []
        while runs:
            if runs[-1][2] >= left:  # can't be the left end of a longer run with this one
                held.append(runs.pop())
            elif runs[-1][3] >= right:
                break
            else:
                start, _, left, _ = runs.pop()
                held.clear()
        runs += held[::-1]
        runs.append((start, k + 1, left, right))
    return [(a, b, r - l) for a, b, l, r in runs]


def with_rest(docs: DataFrame, model: Model, salts: int = 32) -> DataFrame:
    """doc_id, text and ``more``: token and score of the text's words that only ``model.rest`` has. Frequent tokens are
    spread over ``salts`` keys; a list is as long as a text has different words."""
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row_key")), "toxicity_texts")
    held = frozenset([*model.scores, b""])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch):
                own = [{w.strip(_MARKS) for w in text.lower().split()} - held for text in texts]
                keys = np.repeat(batch.column(0).slice(part.start, len(own)).to_numpy(), [len(o) for o in own])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(chain.from_iterable(own), pa.binary())], ["row_key", "token"])

    words = rows.select("row_key", "text").transform(map_batches, run, "row_key long, token binary").withColumn("salt", F.pmod(F.hash("row_key"), F.lit(salts)))
    rest = model.rest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    more = words.join(rest, ["token", "salt"]).groupBy("row_key").agg(F.collect_list(F.struct("token", "score")).alias("more"))
    return rows.join(more, "row_key", "left").select("doc_id", "text", "more")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, passages (word range and score of every maximal run)."""
    known, drift = model.scores, model.drift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Scores(dict):
            def __missing__(self, word: bytes) -> float:
                if len(self) > 80_000:
                    self.clear()
                self[word] = s = known.get(word.strip(_MARKS), -drift)
                return s

        table = Scores()
        for batch in batches:
            counts, found = [], []
            for part, texts in text_parts(batch):
                lists = batch.column(2).slice(part.start, len(texts)).to_pylist() if batch.num_columns > 2 else [None] * len(texts)
                for text, more in zip(texts, lists, strict=True):
                    words = text.lower().split()
                    counts.append(len(words))
                    scores = np.fromiter(map(table.__getitem__, words), np.float64, len(words))
                    if more:
                        own = {m["token"]: m["score"] for m in more}
                        scores = np.array([own.get(w.strip(_MARKS), s) for w, s in zip(words, scores.tolist(), strict=True)])
                    found.append([{"start": a, "end": b, "score": s} for a, b, s in maximal_runs(scores)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "passages"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") if model.rest is None else with_rest(docs, model)
    return texts.transform(map_batches, run, "doc_id long, n_words long, passages array<struct<start: long, end: long, score: double>>")


def _logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope by Newton steps on (evidence, clean, toxic) counts, with one pseudo-document of each kind at either end."""
    x = np.array([r[0] for r in rows] + [0.0, max(1.0, max(r[0] for r in rows))])
    n0, n1 = np.array([r[1] for r in rows] + [1.0, 0.0]), np.array([r[2] for r in rows] + [0.0, 1.0])
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (n1 - (n0 + n1) * p) - 1e-3 * beta
        curve = (design * ((n0 + n1) * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -2, 2)
    return float(beta[0]), float(beta[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, may_learn: F.Column, label: str = "toxic", expect: float = 0.05, threshold: float = 0.5, max_tokens: int = 50_000) -> DataFrame:
    """doc_id, score, predicted, passages (the significant ones); ``may_learn`` tells by doc_id which labels may be read."""
    known = labels.where(may_learn)
    model = learn(token_counts(docs, known, label), max_tokens)
    kind = "array<struct<start: long, end: long, score: double>>"
    if model is None:
        share = known.agg(F.avg(label)).first()[0] or 0.0
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(float(share)).alias("score"), F.lit(int(share >= threshold)).alias("predicted"), F.array().cast(kind).alias("passages"))
    found = materialize(passages(docs, model), "passages")
    truth = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    seen = found.join(truth, "doc_id")
    least = 1.0  # score from which clean passages are counted for K
    words, hits = seen.where("y = 0").agg(F.sum("n_words"), F.sum(F.size(F.filter("passages", lambda p: p["score"] >= least)))).first()
    k = max(int(hits or 0), 1) / max(int(words or 0), 1) * math.exp(model.decay * least)
    gain = lambda p: F.lit(model.decay) * p["score"] - F.log(F.lit(k) * F.greatest("n_words", F.lit(1)))
    sure = found.withColumn("passages", F.filter("passages", lambda p: gain(p) > -math.log(expect)))
    rated = sure.withColumn("evidence", F.least(F.lit(200.0), F.aggregate(F.transform("passages", gain), F.lit(0.0), lambda a, b: a + b)))
    rows = rated.join(truth, "doc_id").groupBy((F.round(F.col("evidence") * 4) / 4).alias("e")).agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).collect()
    base, slope = _logistic([(r["e"], r["n0"], r["n1"]) for r in rows])
    score = 1 / (1 + F.exp(-(F.lit(base) + F.lit(slope) * F.col("evidence"))))
    return rated.select("doc_id", score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "passages")
