"""Operator 12, hard-negative mining: Four-Russians scoring of whole-number vectors.

Scores are exact inner products. The anchors' components are taken eight at a time, and for each group the sums of all 256
subsets are tabled; a candidate's components are cut into bit planes, so that the eight bits of a group and plane are one
byte, which picks a sum from the group's table. Plane by plane, from the sign's down, the sum so far is doubled and the
picked sums are added: shifts, adds and lookups give the whole product.

Anchors are the query set, met by all rows in blocks: they are written once to the shared folder, and each task holds its
part of the rows as bit planes (of bounded bytes) and reads the anchors block by block. Of a block it keeps, for each
anchor, only the best ``positives`` rows, and in a second pass, for each anchor and positive, the best ``negatives`` rows
in the positive's range; what tasks found meets by anchor, so no key gathers more than that from each task. No row is left
out of any product, and nothing goes through the driver.

Edge cases: rows with a null label or vector, or a null component, take no part; vectors of unlike length count as filled
up with zeros, an empty vector scores zero; a row without id is no anchor and comes after rows of equal score; rows that
repeat an id are rows of their own, but an anchor's positives have other ids than its own; scores are 64-bit and wrap
around beyond that; fewer rows than asked for are returned as they are; an empty table, or one without anchors, gives no
row; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import map_batches, materialize, scratch_dir

FOUND = "anchor long, anchor_id long, slot int, positive_id long, positive_score long, id long, score long"
#: Anchors of a block, and candidates whose scores with a block are held at once.
BLOCK, CHUNK = 256, 4096
NO_ID = np.iinfo(np.int64).max  # stands for null: it comes last


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """By group of eight components and subset (a byte; bit j is component j): the sum of each anchor's components in it."""
    n, dims = anchors.shape
    groups = -(-dims // 8)
    wide = np.zeros((n, groups * 8), kind)
    wide[:, :dims] = anchors
    parts = wide.reshape(n, groups, 8).transpose(1, 2, 0)
    sums = np.zeros((groups, 256, n), kind)
    for j in range(8):
        sums[:, 1 << j : 2 << j] = sums[:, : 1 << j] + parts[:, j : j + 1]
    return sums


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """By bit (lowest first, the last is the sign) and group of eight components: a byte a vector."""
    n, dims = vectors.shape
    groups = -(-dims // 8)
    wide = np.zeros((n, groups * 8), np.int64)
    wide[:, :dims] = vectors
    most = int(max(vectors.max(initial=0), -1 - vectors.min(initial=0)))
    return np.stack([np.packbits(((wide >> p) & 1).astype(np.uint8).reshape(n, groups, 8), axis=2, bitorder="little")[:, :, 0].T for p in range(most.bit_length() + 1)])


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The inner product of each candidate (row) with each anchor (column)."""
    total = np.zeros((planes.shape[2], sums.shape[2]), sums.dtype)
    picked = np.empty_like(total)
    for plane in range(len(planes) - 1, -1, -1):
        np.left_shift(total, 1, out=total)
        add = np.subtract if plane == len(planes) - 1 else np.add  # the sign's plane counts below zero
        for group in range(len(sums)):
            np.take(sums[group], planes[plane, group], axis=0, out=picked)
            add(total, picked, out=total)
    return total


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows, filled up with zeros to ``dims`` or to the longest."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), max(dims, int(lengths.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - offsets[row]] = values
    return out


class _Best:
    """The best ``k`` (score, id) of each slot; rows come by ascending id, so of equal scores the first stays."""

    def __init__(self, slots: int, k: int):
        self.k, self.least = k, np.full(slots, np.iinfo(np.int64).min)
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * slots

    def add(self, slot: int, ids: np.ndarray, found: np.ndarray, which: np.ndarray) -> None:
        """``which`` marks the rows that may count."""
        full = len(self.held[slot][0]) == self.k
        at = np.flatnonzero(which & (found > self.least[slot]) if full else which)
        if not len(at):
            return
        value = np.concatenate([self.held[slot][0], found[at]])
        names = np.concatenate([self.held[slot][1], ids[at]])
        if len(value) > self.k:
            # no more than need be is sorted: what reaches the k-th score, of which the first of equal ones stay
            reach = np.flatnonzero(value >= np.partition(value, len(value) - self.k)[len(value) - self.k])
            best = reach[np.argsort(~value[reach], kind="stable")[: self.k]]  # ~ turns the order round without overflow
            value, names = value[best], names[best]
        self.held[slot] = value, names
        if len(value) == self.k:
            self.least[slot] = value.min()


def _blocks(path: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a written table, at most ``size`` at a time, by any store that pyarrow opens."""
    fs, base = pyarrow.fs.FileSystem.from_uri(path)
    for info in sorted(fs.get_file_info(pyarrow.fs.FileSelector(base)), key=lambda i: i.path):
        if info.type == pyarrow.fs.FileType.File and info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as f, pq.ParquetFile(f) as table:
                yield from table.iter_batches(batch_size=size)


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _meet(rows: DataFrame, anchors: str, k: int, low: int | None, high: int | None) -> DataFrame:
    """Rows against the anchors written at ``anchors``. Without bounds: each anchor's best ``k`` of its own label. With
    bounds in percent: for each of its positives, the best ``k`` of other labels whose score is within them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = pa.Table.from_batches(held).combine_chunks()
        ids = part["id"].fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, labels = ids[order], part["label"].to_numpy()[order]
        vectors = _matrix(part["vector"].combine_chunks(), 0)[order]
        dims, most = vectors.shape[1], int(max(vectors.max(initial=0), -1 - vectors.min(initial=0)))
        planes = bit_planes(vectors)
        del part, held, vectors
        for block in _blocks(anchors, BLOCK):
            queries = _matrix(block.column("vector"), dims)[:, :dims]  # what only an anchor has meets zeros
            small = (most + 1) * int(np.abs(queries.astype(float)).max(initial=0) + 1) * max(dims, 1) < 1 << 30
            sums = subset_sums(queries, np.int32 if small else np.int64)
            key, name, own = (block.column(c).to_pylist() for c in ("anchor", "anchor_id", "label"))
            slots = [(a, None, None, None) for a in range(len(key))]
            if low is not None:
                slots = [(a, i, p["id"], p["score"]) for a, ps in enumerate(block.column("positives").to_pylist()) for i, p in enumerate(ps)]
            best = _Best(len(slots), k)
            for first in range(0, len(ids), CHUNK):
                some = slice(first, first + CHUNK)
                table = scores(sums, planes[:, :, some]).T.astype(np.int64)
                for slot, (a, _, _, score) in enumerate(slots):
                    found = table[a]
                    if score is None:
                        best.add(slot, ids[some], found, (labels[some] == own[a]) & (ids[some] != name[a]))
                    else:
                        least, last = -(-low * score // 100), high * score // 100
                        if least <= last:
                            best.add(slot, ids[some], found, (labels[some] != own[a]) & (found >= least) & (found <= last))
            n = [len(best.held[s][0]) for s in range(len(slots))]
            at = np.repeat(np.arange(len(slots)), n).tolist()
            if at:
                names = np.concatenate([h[1] for h in best.held])
                columns = [[key[slots[s][0]] for s in at], [name[slots[s][0]] for s in at], *([slots[s][i] for s in at] for i in (1, 2, 3))]
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(names, mask=names == NO_ID), pa.array(np.concatenate([h[0] for h in best.held]))], FOUND.replace(" long", "").replace(" int", "").split(", "))

    found = map_batches(rows, run, FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: F.Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, part_bytes: int = 32 << 20) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels
    whose score is ``low`` to ``high`` percent of the positive's.

    ``rows`` has id, label and vector (array of bigint); ``is_anchor`` tells anchors by those columns. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score. ``part_bytes`` bounds the vectors that a task holds.
    """
    whole = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    base = materialize(rows.where(whole).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<bigint>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")), "vectors")
    anchors, path = _written(base.where("is_anchor").select(F.monotonically_increasing_id().alias("anchor"), F.col("id").alias("anchor_id"), "label", "vector"), "anchors")
    size = base.agg(F.coalesce(F.sum(F.size("vector") * 8 + 24), F.lit(0)).alias("b")).first()["b"]
    parts = max(base.sparkSession.sparkContext.defaultParallelism, -(-int(size) // part_bytes))
    spread = base.select("id", "label", "vector").repartition(parts, F.xxhash64("id", F.monotonically_increasing_id()))
    near = _meet(spread, path, positives, None, None)
    listed = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))  # at most ``positives`` an anchor
    _, path = _written(anchors.join(listed, "anchor").select("anchor", "anchor_id", "label", "vector", F.transform("positives", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives")), "positives")
    far = _meet(spread, path, negatives, low, high)
    return far.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """The registered query's rows: components as floor(256 * x), labels moved on by one where vec_id is divisible by 7; rows
    with a component that is null or not finite take no part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return embeddings.where(F.col("embedding").isNotNull() & ~odd).select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("vector"))


ORACLE_SQL = """
with e as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c as (select id, label, unnest(v) as x, generate_subscripts(v, 1) as i from e),
s as (
  select a.id as anchor_id, a.label as own, b.id, b.label, cast(sum(a.x * b.x) as bigint) as score
  from c a join c b on a.i = b.i where a.id % 100 = 0 group by all),
p as (
  select anchor_id, own, id as positive_id, score as positive_score from s where label = own and id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as int) as rank,
       id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and s.label <> p.own
where 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""
