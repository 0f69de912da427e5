"""Operator 3, language ID: a byte convolutional network, trained in numpy, applied to fixed-length windows.

Bytes fall into 64 classes (letters without case, space, other ASCII, and the rest by value). Filters of widths 2, 3 and 4
slide over a window of ``WINDOW`` classes, each filter's largest response is kept, and a softmax layer gives the
languages. Training reads a bounded sample of labelled documents, ``per_language`` a language, of which a few windows
each; prediction covers every window of every text and averages the log-probabilities.

Applied to texts, a filter bank is a sum of looked-up rows: one table for each pair of neighbouring classes and one for
single ones, small enough for the processor's cache.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; texts shorter than a window are padded with
spaces; texts of any length are read whole; languages are the distinct non-null values of ``lang`` that may be learnt;
with none, every text is ``und``; repeated rows count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import map_batches, text_parts

WINDOW, WIDTHS, FILTERS, CLASSES = 128, (2, 3, 4), 16, 64
UNKNOWN = "und"


def byte_classes() -> np.ndarray:
    """a-z and A-Z 0-25, white space 26, other ASCII 27, the rest in 28-63."""
    out = np.full(256, 27, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 26
    for i in range(26):
        out[97 + i] = out[65 + i] = i
    out[128:] = 28 + np.arange(128, 256) % 36
    return out


@dataclass(frozen=True)
class Network:
    languages: tuple[str, ...]
    filters: dict[int, np.ndarray]  # width: (width, CLASSES, FILTERS)
    bias: np.ndarray  # all filters
    weights: np.ndarray  # (all filters, languages)
    offsets: np.ndarray

    def pair_tables(self) -> dict[int, list[np.ndarray]]:
        """For each width the rows to add: of the pair at 0, and of the pair or single class at 2."""
        out = {}
        for at, (w, f) in enumerate(self.filters.items()):
            first = (f[0][:, None] + f[1][None] + self.bias[at * FILTERS : (at + 1) * FILTERS]).reshape(-1, FILTERS)
            rest = [] if w == 2 else [f[2]] if w == 3 else [(f[2][:, None] + f[3][None]).reshape(-1, FILTERS)]
            out[w] = [np.ascontiguousarray(t, np.float32) for t in (first, *rest)]
        return out

    def log_probabilities(self, windows: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """(windows, languages) of (windows, WINDOW) classes."""
        pairs = windows[:, :-1].astype(np.int32) * CLASSES + windows[:, 1:]
        pooled = []
        for w, t in tables.items():
            n = WINDOW - w + 1
            seen = t[0][pairs[:, :n]]
            if w == 3:
                seen += t[1][windows[:, 2:]]
            elif w == 4:
                seen += t[1][pairs[:, 2:]]
            pooled.append(seen.max(1))
        logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.weights + self.offsets
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def train(windows: np.ndarray, targets: np.ndarray, languages: tuple[str, ...], epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 5) -> Network:
    """Adam on the cross-entropy; through max pooling a filter learns from the place of its largest response."""
    rng = np.random.default_rng(seed)
    n_all = FILTERS * len(WIDTHS)
    params = {f"f{w}": rng.normal(0, 0.15, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}
    params |= {"b": np.zeros(n_all, np.float32), "w": rng.normal(0, 0.2, (n_all, len(languages))).astype(np.float32), "o": np.zeros(len(languages), np.float32)}
    first, second, step = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
    columns = np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            x, y = windows[order[at : at + batch]].astype(np.int64), targets[order[at : at + batch]]
            places, pooled = [], []
            for i, w in enumerate(WIDTHS):
                seen = sum(params[f"f{w}"][j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
                best = seen.argmax(1)
                places.append(best)
                pooled.append(np.take_along_axis(seen, best[:, None], 1)[:, 0] + params["b"][i * FILTERS : (i + 1) * FILTERS])
            hidden = np.maximum(np.concatenate(pooled, 1), 0)
            logits = hidden @ params["w"] + params["o"]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ params["w"].T) * (hidden > 0)
            grads = {"w": hidden.T @ p + 1e-4 * params["w"], "o": p.sum(0), "b": back.sum(0)}
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(params[f"f{w}"])
                mine = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(x, places[i] + j, 1), columns[None]), mine)
                grads[f"f{w}"] = g
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = (params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, {w: params[f"f{w}"] for w in WIDTHS}, params["b"], params["w"], params["o"])


def cut(text: bytes, classes: np.ndarray) -> np.ndarray:
    """The windows that cover a text, the last padded with spaces."""
    codes = classes[np.frombuffer(text, np.uint8)]
    n = max(1, -(-len(codes) // WINDOW))
    out = np.full(n * WINDOW, 26, np.uint8)
    out[: len(codes)] = codes
    return out.reshape(n, WINDOW)


def sample(docs: DataFrame, may_learn: F.Column, per_language: int, per_text: int) -> list[tuple[str, str]]:
    """(lang, passage) pairs: about ``per_language`` documents a language by a hash of id, text and place, so that rows alike in
    id or text are drawn apart; ``per_text`` passages of a window's length each."""
    drawn = docs.select("doc_id", "lang", "text", F.xxhash64(F.lit(11), "doc_id", "text", F.monotonically_increasing_id()).alias("draw"))
    usable = drawn.where(may_learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    u = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30)
    starts = [F.greatest(F.lit(1), (F.length("text") * (i + 0.5) / per_text).cast("int") - WINDOW // 2) for i in range(per_text)]
    passages = F.array(*[F.substring("text", s, F.lit(WINDOW)) for s in starts])
    chosen = usable.join(F.broadcast(counts), "lang").where(u * F.col("n") < 1.25 * per_language).select("lang", u.alias("u"), passages.alias("p")).collect()
    left: dict[str, int] = {}
    out = []
    for r in sorted(chosen, key=lambda r: (r["lang"], r["u"])):
        left[r["lang"]] = left.get(r["lang"], 0) + 1
        if left[r["lang"]] <= per_language:
            out += [(r["lang"], p) for p in r["p"]]
    return out


def fit(docs: DataFrame, may_learn: F.Column, per_language: int = 250, per_text: int = 3) -> Network | None:
    rows = sample(docs, may_learn, per_language, per_text)
    if not rows:
        return None
    languages = tuple(sorted({lang for lang, _ in rows}))
    classes = byte_classes()
    windows = np.concatenate([cut(p.encode()[:WINDOW], classes) for _, p in rows])
    return train(windows, np.array([languages.index(lang) for lang, _ in rows]), languages)


def predict(docs: DataFrame, network: Network | None, at_once: int = 64) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    if network is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, tables = byte_classes(), network.pair_tables()
        for batch in batches:
            langs, scores = [], []
            for _, texts in text_parts(batch, 1 << 20):
                windows = [cut(t, classes) for t in texts]
                edges = np.concatenate([[0], np.cumsum([len(w) for w in windows])])
                flat = np.concatenate(windows)
                logp = np.concatenate([network.log_probabilities(flat[i : i + at_once], tables) for i in range(0, len(flat), at_once)])
                mean = np.add.reduceat(logp, edges[:-1], 0) / np.diff(edges)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                langs += [network.languages[i] for i in best.tolist()]
                scores += p[np.arange(len(p)), best].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), batch.column(2)], ["doc_id", "lang_pred", "score", "lettered"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lettered).transform(map_batches, run, "doc_id long, lang_pred string, score double, lettered boolean")
    return out.select("doc_id", F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"))
