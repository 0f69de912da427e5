"""Operator 6, near-duplicates: minhash with tensored banding, exact verification, connected components.

1. One pass computes each text's shingle set, its size, an order-free 128-bit fingerprint and two small collections of
   keys (``per_collection`` keys of ``rows`` minhashes each). Equal sets form a class, a node of the graph from here on.
2. Tensoring: table (i, j) is keyed by the pair (i-th key of the first collection, j-th of the second), so m * m tables of
   2 * rows minhashes cost 2 * m * rows minhashes. Keys that nobody shares are dropped before pairs are formed.
3. Each bucket of a table compares its members with one centre (linear in the bucket); pairs are confirmed on full sets. A
   centre's text is sent once for every ``PER_HUB`` of its members, however many it has.
4. Buckets whose members are still in different components are compared completely, but for pairs already connected, in
   blocks of bounded count and size that are cut by component: a pair is looked at once, in the first bucket that it
   shares, and two blocks of one component never meet. So no cap is put on candidates.
5. Components by alternating large-star and small-star steps over the confirmed links. Classes that share a document's id
   are linked as well, so an id is in one component even where rows of different texts repeat it.

A pair at the threshold s shares no bucket with probability at most 2 * (1 - s ** rows) ** per_collection (4e-4 here at
0.8, 1e-5 at 0.87). Everything between steps lies in narrow tables in the shared folder; texts move only for candidates.

Edge cases: null, empty and white-space texts have an empty set and are linked with nothing; a text with fewer words than
a shingle has its whole sequence as its one shingle; rows that repeat a doc_id are one node, linked with all that any of
their texts is linked with; a row without doc_id is kept, unlinked, with a null component; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import map_batches, materialize, text_parts
from tallyforge.llm.shingles import WordHashes, fingerprints, hashed_sets, minhash_keys, shingle_set

PER_COLLECTION, ROWS, ORDERS, BLOCK, PER_HUB = 12, 3, 4, 256, 256
#: Up to so many rows of a narrow table (at most 24 bytes each) it is joined by broadcast, beyond it by shuffle.
BROADCAST_IDS = 2_000_000
#: The same for what is kept of the members of buckets with several components (about 60 bytes a row).
BROADCAST_MEMBERS = 500_000


def signatures(docs: DataFrame, width: int, per_collection: int = PER_COLLECTION, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """doc_id, h (of the text), n (set size), f1, f2 (fingerprint), keys (two collections; empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            for part, texts in text_parts(batch):
                sets = hashed_sets(texts, width, table)
                f1, f2 = fingerprints(sets)
                full = [s for s in sets if len(s)]
                keys = minhash_keys(full, 2, per_collection, rows, seed) if full else np.empty((0, 2 * per_collection), np.uint64)
                ends = np.concatenate([[0], np.cumsum([2 * per_collection * bool(len(s)) for s in sets])])
                ids, marks = (batch.column(c).slice(part.start, part.stop - part.start) for c in (0, 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, marks, pa.array([len(s) for s in sets], pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists], ["doc_id", "h", "n", "f1", "f2", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), "text").transform(map_batches, run, "doc_id long, h long, n long, f1 long, f2 long, keys array<long>")


def text_hash() -> F.Column:
    return F.xxhash64("text")


def classes(sig: DataFrame) -> DataFrame:
    """rep (the class's number), doc_id and h (its row of the smallest id), n, f1, f2, keys of every set that is not empty."""
    of = sig.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.first("keys").alias("keys"))
    return materialize(of.select(F.monotonically_increasing_id().alias("rep"), "least.doc_id", "least.h", "n", "f1", "f2", "keys"), "reps")


def repeated_ids(sig: DataFrame) -> DataFrame:
    """The ids that more than one row with a set has."""
    return materialize(sig.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "repeated_ids")


def same_document(sig: DataFrame, reps: DataFrame, repeated: DataFrame) -> DataFrame:
    """Links (x, y) between the classes that rows of one doc_id have."""
    sets = sig.where("n > 0").select("doc_id", "f1", "f2", "n").join(sized(repeated), "doc_id").distinct()
    of = materialize(sets.join(reps.select("rep", "f1", "f2", "n"), ["f1", "f2", "n"]).select("doc_id", "rep"), "classes_of_ids")
    hubs = materialize(of.groupBy("doc_id").agg(F.min("rep").alias("x")), "hubs_of_ids")
    return of.join(sized(hubs), "doc_id").where("x != rep").select("x", F.col("rep").alias("y"))


def sized(table: DataFrame) -> DataFrame:
    """A narrow written table, marked for broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


@dataclass(frozen=True)
class Texts:
    """The documents' texts by class: each class has that of its row of the smallest id. ``unique``: no doc_id is repeated."""

    docs: DataFrame
    reps: DataFrame
    unique: bool

    def of(self, wanted: DataFrame) -> DataFrame:
        """rep, text of the classes in ``wanted`` (rep, each once; written)."""
        rows = self.reps.select("rep", "doc_id", "h")
        if wanted.count() <= BROADCAST_IDS:
            rows = F.broadcast(rows.join(F.broadcast(wanted), "rep"))
        else:
            rows = materialize(rows.join(wanted, "rep"), "wanted_rows")
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), "text")
        texts = texts.join(rows, ["doc_id", "h"]).select("rep", "text")
        return texts if self.unique else texts.dropDuplicates(["rep"])


def tables(reps: DataFrame, per_collection: int = PER_COLLECTION) -> DataFrame:
    """rep, n, i, a (first collection's number and key), t (table key), order: rows of buckets of two or more."""
    keys = reps.select("rep", "n", F.posexplode("keys").alias("at", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    kept = keys.join(shared, "key")
    first, second = F.col("at") < per_collection, F.col("at") >= per_collection
    sides = kept.groupBy("rep", "n").agg(
        F.collect_list(F.when(first, F.struct(F.col("at").alias("i"), F.col("key").alias("a")))).alias("left"),
        F.collect_list(F.when(second, F.struct(F.col("at").alias("j"), F.col("key").alias("b")))).alias("right"),
    )
    cells = sides.select("rep", "n", F.explode("left").alias("l"), "right").select("rep", "n", "l", F.explode("right").alias("r"))
    rows = cells.select("rep", "n", "l.i", "l.a", F.xxhash64("l.a", "r.b").alias("t"), ((F.col("l.i") + F.col("r.j")) % ORDERS).alias("order"))
    rows = materialize(rows, "cells")
    return rows.join(rows.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t"), "t")


def star_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """x, y: each member with its bucket's centre y, the least by one of a few fixed orders; sizes too far apart can't link."""
    rank = F.xxhash64("order", "rep")
    centres = buckets.groupBy("t").agg(F.min_by(F.struct("rep", "n"), rank).alias("c"))
    both = buckets.join(centres, "t").where((F.col("rep") != F.col("c.rep")) & (F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * percent))
    pairs = both.groupBy(F.least("rep", "c.rep").alias("low"), F.greatest("rep", "c.rep").alias("high")).agg(F.min("c.rep").alias("y"))
    return pairs.select(F.when(F.col("y") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("x"), "y")


def confirm(pairs: DataFrame, texts: Texts, width: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose full shingle sets overlap by ``percent`` or more, compared as words, not hashes.

    Pairs are dealt by y and a slot of at most about ``PER_HUB`` pairs. The text of y leads each slot, so it is sent once
    a slot, and only one text of a slot is held while the others pass by.
    """
    pairs = materialize(pairs, "pairs")
    wanted = materialize(pairs.select(F.col("x").alias("rep")).union(pairs.select("y")).distinct(), "wanted")
    found = materialize(texts.of(wanted), "texts")
    hubs = materialize(pairs.groupBy("y").agg(F.ceil(F.count("*") / PER_HUB).alias("slots")).where("slots > 1"), "hubs")
    slot = F.coalesce(F.pmod(F.xxhash64("x"), F.col("slots")), F.lit(0)).alias("slot")
    few = hubs.count() <= BROADCAST_IDS
    dealt = pairs.join(F.broadcast(hubs) if few else hubs, "y", "left").select("x", "y", slot)
    dealt = dealt if few else materialize(dealt, "dealt")
    members = dealt.join(found.withColumnRenamed("rep", "x"), "x").select("y", "slot", "x", "text")
    leaders = dealt.select("y", "slot").distinct().join(found.withColumnRenamed("rep", "y"), "y").select("y", "slot", F.lit(None).cast("long").alias("x"), "text")
    rows = leaders.union(members).repartition("y", "slot").sortWithinPartitions("y", "slot", F.asc_nulls_first("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[tuple[bytes, ...]] = set()
        for batch in batches:
            out: list[tuple[int, int]] = []
            ys, xs = (batch.column(c).to_pylist() for c in (0, 2))
            for part, some in text_parts(batch, 1 << 20):
                for y, x, text in zip(ys[part], xs[part], some, strict=True):
                    if x is None:
                        held = shingle_set(text, width)
                        continue
                    s = shingle_set(text, width)
                    both = len(s & held)
                    if 100 * both >= percent * (len(s) + len(held) - both):
                        out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in (0, 1)], ["x", "y"])

    return rows.transform(map_batches, run, "x long, y long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of an edge."""

    def stars(e: DataFrame, large: bool, few: bool) -> DataFrame:
        # e has (u, v) with v < u; the large star sees both directions, the small star only smaller neighbours
        seen = e.union(e.select("v", "u")) if large else e
        low = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # broadcast, or written, so that the edges of a node with many can be dealt to several tasks of the join
        low = low if few else materialize(low, "least_neighbours")
        near = seen.join(F.broadcast(low) if few else low, "u")
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        out = out.where("u != v").distinct()
        return out if few else materialize(out, "half_stars")

    e = materialize(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            break
        few = 2 * now[0] <= BROADCAST_IDS  # nodes are no more than twice the edges
        state, e = tuple(now), materialize(stars(stars(e, True, few), False, few), "stars")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())


def _rest_of_bucket(percent: int, per_collection: int):
    """Links between members of different components within two blocks of a bucket."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "rep"], ignore_index=True)
        own = int(pdf["bi"].iloc[0]) == int(pdf["bj"].iloc[0])
        i = int(pdf["i"].iloc[0])
        reps, n, comp = (pdf[c].to_numpy() for c in ("rep", "n", "comp"))
        keys = np.stack([np.frombuffer(k, np.int64) for k in pdf["packed"]])
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        vocab, where = np.unique(np.concatenate(sets), return_inverse=True)
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        often = np.flatnonzero(np.bincount(where) > 1)  # a shingle of one member adds to no intersection
        left = np.arange(len(reps)) if own else np.flatnonzero(pdf["side"].to_numpy() == 0)
        right = left if own else np.flatnonzero(pdf["side"].to_numpy() == 1)
        shared = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, len(often), 4096):
            cols = np.full(len(vocab), -1, np.int64)
            cols[often[at : at + 4096]] = np.arange(len(often[at : at + 4096]))
            inside = cols[where] >= 0
            m = np.zeros((len(sets), min(4096, len(often) - at)), np.float32)
            m[rows[inside], cols[where[inside]]] = 1
            shared += m[left] @ m[right].T
        ok = (100 * shared >= percent * (n[left][:, None] + n[right][None] - shared)) & (comp[left][:, None] != comp[right][None])
        for k in range(i):  # an earlier bucket has the pair
            ok &= keys[left, k][:, None] != keys[right, k][None]
        ok &= np.any([keys[left, k][:, None] == keys[right, k][None] for k in range(per_collection, 2 * per_collection)], axis=0)
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        out = []
        for a, b in np.argwhere(ok).tolist():
            x, y = left[a], right[b]
            if (ra := root(int(comp[x]))) != (rb := root(int(comp[y]))):
                joined[max(ra, rb)] = min(ra, rb)
                out.append((min(reps[x], reps[y]), max(reps[x], reps[y])))
        return pd.DataFrame(out, columns=["x", "y"], dtype=np.int64)

    return links


def remaining_pairs(buckets: DataFrame, reps: DataFrame, comps: DataFrame, texts: Texts, width: int, percent: int, per_collection: int = PER_COLLECTION, block: int = BLOCK) -> DataFrame:
    """Links in buckets that still hold more than one component, each bucket cut into blocks that meet pairwise.

    A block has at most about ``block`` members and 1024 shingles for each of those. A component that fills half a block or
    more has blocks of its own, so a bucket of one large component and some strays takes work in proportion to its size.
    """
    state = comps.select(F.col("node").alias("rep"), "comp")
    rows = materialize(buckets.join(state, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "rows")
    active = rows.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("t")
    members = materialize(rows.join(active, "t").select("rep", "n", "comp", "i", "a").distinct(), "members")
    few = members.count() <= BROADCAST_MEMBERS
    side = lambda df, name: F.broadcast(df) if few else materialize(df, name)
    wanted = materialize(members.select("rep").distinct(), "member_reps")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            for part, some in text_parts(batch, 1 << 20):
                sets = pa.array([s.tobytes() for s in hashed_sets(some, width, table)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), sets], ["rep", "shingles"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([np.array(k, np.int64).tobytes() for k in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys], ["rep", "packed"])

    sets = texts.of(wanted).transform(map_batches, shingled, "rep long, shingles binary")
    keys = reps.select("rep", "keys").join(sized(wanted), "rep").transform(map_batches, packed, "rep long, packed binary")
    facts = materialize(sets.join(keys, "rep"), "facts")
    # at most a row for each component and bucket; joined by broadcast, or written first, so that hot keys can be split
    shares = members.groupBy("i", "a", "comp").agg(F.sum(1 / F.lit(block) + F.col("n") / F.lit(block * 1024)).alias("share"))
    shares = shares if few else materialize(shares, "shares")
    rest = side(shares.where("share < 0.5").groupBy("i", "a").agg(F.sum("share").alias("rest")), "rest")
    plans = side(shares.join(rest, ["i", "a"], "left"), "plans")
    large = F.xxhash64(F.lit(1), "comp", F.pmod(F.xxhash64("rep"), F.ceil("share")))
    small = F.xxhash64(F.lit(0), F.pmod(F.xxhash64("comp"), F.ceil("rest")))
    placed = members.join(plans, ["i", "a", "comp"]).select("rep", "n", "comp", "i", "a", F.when(F.col("share") >= 0.5, large).otherwise(small).alias("b"))
    placed = materialize(placed, "placed")
    blocks = materialize(placed.groupBy("i", "a", "b").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "blocks")
    one, two = (blocks.select("i", "a", *[F.col(c).alias(c + k) for c in ("b", "lo", "hi")]) for k in ("i", "j"))
    met = one.join(two, ["i", "a"]).where("bi <= bj and least(loi, loj) < greatest(hii, hij)").select("i", "a", "bi", "bj")
    met = sized(materialize(met, "met"))
    ends = met.select("i", "a", F.col("bi").alias("b"), "bi", "bj", F.lit(0).alias("side"))
    ends = ends.union(met.where("bi != bj").select("i", "a", F.col("bj").alias("b"), "bi", "bj", F.lit(1).alias("side")))
    cells = placed.join(ends, ["i", "a", "b"]).drop("b")
    full = (cells if few else materialize(cells, "cells_of_blocks")).join(facts, "rep")
    return full.groupBy("i", "a", "bi", "bj").applyInPandas(_rest_of_bucket(percent, per_collection), "x long, y long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    sig = materialize(signatures(docs, width), "sig")
    reps, repeated = classes(sig), repeated_ids(sig)
    unique = repeated.isEmpty()
    texts = Texts(docs, reps, unique)
    buckets = materialize(tables(reps), "tables")
    links = materialize(confirm(star_pairs(buckets, percent), texts, width, percent), "links")
    if not unique:
        links = links.union(materialize(same_document(sig, reps, repeated), "links_of_ids"))
    comps = materialize(components(links), "comps")
    more = materialize(remaining_pairs(buckets, reps, comps, texts, width, percent), "more_pairs")
    if not more.isEmpty():
        links = links.union(materialize(confirm(more, texts, width, percent), "more_links"))
        comps = materialize(components(links), "comps")
    # the smallest doc_id of a component, then of each class, then of each row
    led = materialize(reps.select("rep", "doc_id", "f1", "f2", "n").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "led")
    least = materialize(led.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least_ids")
    led = led.join(sized(least), "comp").select("f1", "f2", "n", "component_id")
    rows = sig.select("doc_id", "n", "f1", "f2")
    out = rows.join(led, ["f1", "f2", "n"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
