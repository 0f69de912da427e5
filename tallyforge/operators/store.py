"""Idempotent upsert into versioned, bucketed Parquet tables.

A table is cut into buckets by Spark's own bucket hash of its key, so that Spark joins it by that key as it lies: rows that
come in are dealt by the same hash, and the stored side has no exchange. An upsert reads and writes only the buckets that
receive rows, below the new version's folder, and then one manifest that names for each bucket the version that holds
it; untouched buckets are carried on by reference. Readers resolve the newest manifest once, so a half-written version is
never seen, a job that runs again after a failure starts from the last whole one, and nothing reads and overwrites the
same path. What the last two manifests don't name is removed.

The number of buckets doubles when they hold more than ``2 * PER_BUCKET`` rows each, in one pass without an exchange: a
bucket's rows go to itself and to the new bucket that takes over half of them.

Each row is stored with a digest of its content. Whether an incoming row is new, changed or as stored is told by the keys
and digests that the join meets anyway, counted while the new version is written.

Keys are not null.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators.observed import counted, observe
from tallyforge.sources.paths import PARQUET, exists, remove

#: Makes rows that were moved in a shorter form whole.
Whole = Callable[[DataFrame], DataFrame]
#: Columns that say when and by which run a row came, not what it holds.
STAMPS = ("processed_at", "detected_at", "id_run")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows with one key, that with the greatest ``order``. A partial maximum precedes the shuffle."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(whole, F.col(order)).alias("__w")).select("__w.*")


def merge(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``new`` in place of those that have their keys."""
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new)


def _holds_null(c: F.Column, kind: T.DataType) -> F.Column:
    """Whether a value, or a field of a struct, is null."""
    out = c.isNull()
    for f in kind if isinstance(kind, T.StructType) else ():
        out = out | _holds_null(c[f.name], f.dataType)
    return out


def _flat(kind: T.DataType) -> bool:
    return all(_flat(f.dataType) for f in kind) if isinstance(kind, T.StructType) else not isinstance(kind, (T.ArrayType, T.MapType, T.VariantType))


def _hashed(c: F.Column, kind: T.DataType) -> list[F.Column]:
    """What a digest of ``c`` takes in. A hash passes over nulls and the ends of lists, so these are told apart beside the value;
    as text, which is slow to make, only go lists that hold nulls, lists in lists and maps."""
    if isinstance(kind, T.StructType):
        return [c.isNull(), *(x for f in kind for x in _hashed(c[f.name], f.dataType))]
    if isinstance(kind, T.ArrayType) and _flat(kind.elementType):
        return [c.isNull(), F.size(c), c, F.when(F.exists(c, lambda x: _holds_null(x, kind.elementType)), F.to_json(F.struct(c)))]
    return [c.isNull(), c] if _flat(kind) else [F.to_json(F.struct(c))]


def content_hash(rows: DataFrame, but: tuple[str, ...] = STAMPS) -> F.Column:
    return F.xxhash64(*[x for f in rows.schema if f.name not in but for x in _hashed(F.col(f.name), f.dataType)])


def upsert_counts(target: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """inserted (keys new to the target), updated (all other incoming rows), unchanged (stored rows whose content, stamps
    aside, is what the key's last incoming row has), of any two frames. ``Table.upsert`` counts the same as it writes."""
    last = last_wins(incoming, keys, order)
    old = target.select(*keys, content_hash(target).alias("__old"))
    both = last.select(*keys, content_hash(last).alias("__new")).join(old, keys, "left")
    sums = both.agg(F.count_if(F.col("__old").isNull()).alias("inserted"), F.count_if(F.col("__old") == F.col("__new")).alias("unchanged"))
    total = incoming.agg(F.count("*").alias("n"))
    return sums.crossJoin(total).select("inserted", (F.col("n") - F.col("inserted")).alias("updated"), "unchanged")  # one row each


#: Rows a bucket of a table whose number of buckets is not given.
PER_BUCKET = 500_000
#: Manifests whose versions stay readable.
KEPT = 2
#: An upsert that touches less than one bucket in so many moves their rows rather than start a task for every bucket.
FEW = 16
BUCKET, DIGEST, GONE = "__bucket", "__digest", "__gone"


@dataclass
class Manifest:
    """A version, its number of buckets, for each bucket with rows the version that holds it and how many, and the schema."""

    version: int
    cut: int
    held: dict[int, tuple[int, int]]
    schema: T.StructType

    def rows(self, but: set[int] = frozenset()) -> int:
        return sum(n for b, (_, n) in self.held.items() if b not in but)


class Table:
    """A keyed table below ``path``. ``buckets`` fixes their number; otherwise it follows the rows, ``PER_BUCKET`` each.
    ``by``, the first of the keys, deals rows to buckets where not all of them do."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int | None = None, by: list[str] | None = None):
        self.spark, self.path, self.keys, self.buckets, self.by = spark, path, keys, buckets, by or keys
        self._found: set[int] | None = None  # the buckets of an upsert that found all as it was

    def _manifests(self) -> list[Manifest]:
        """The newest first."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return []
        rows = self.spark.read.json(f"{self.path}/manifest/*", schema="version long, cut int, held string, fields string").orderBy(F.desc("version")).limit(KEPT + 1).collect()
        return [Manifest(r["version"], r["cut"], {int(b): tuple(x) for b, x in json.loads(r["held"]).items()}, T.StructType.fromJson(json.loads(r["fields"]))) for r in rows]

    def _newest(self) -> Manifest:
        """Version 0 before the first write."""
        return next(iter(self._manifests()), Manifest(0, self.buckets or 0, {}, T.StructType()))

    def manifest(self) -> dict[str, int] | None:
        now = self._newest()
        return {"version": now.version, **{str(b): v for b, (v, _) in now.held.items()}} if now.version else None

    def _folder(self, version: int, bucket: int) -> str:
        return f"{self.path}/data/v={version}/{BUCKET}={bucket}"

    def _stored(self, schema: T.StructType, held: dict[int, tuple[int, int]]) -> DataFrame:
        places = [self._folder(v, b) for b, (v, _) in held.items()]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def _rows(self, now: Manifest, buckets: set[int] | None = None) -> DataFrame:
        held = now.held if buckets is None else {b: x for b, x in now.held.items() if b in buckets}
        return self._stored(now.schema, held).drop(DIGEST)

    def read(self, empty: DataFrame | None = None) -> DataFrame | None:
        """The table, or no rows of ``empty``'s schema where nothing was written yet."""
        now = self._newest()
        if now.held or now.version and empty is None:
            return self._rows(now)
        return None if empty is None else empty.limit(0)

    def read_by(self, wanted: DataFrame, empty: DataFrame) -> DataFrame:
        """The stored rows whose ``by`` columns are among those of ``wanted``; only their buckets are read. No rows of
        ``empty``'s schema where nothing was written yet."""
        now = self._newest()
        if not now.held:
            return empty.limit(0)
        return self._rows(now, self._touched(wanted, now.cut)).join(wanted.select(*self.by).distinct(), self.by, "left_semi")

    @contextmanager
    def found_by(self, wanted: DataFrame, empty: DataFrame) -> Iterator[DataFrame]:
        """What ``read_by`` gives, to be used meanwhile: most buckets are joined as they lie, so that of them nothing is moved."""
        now = self._newest()
        touched = self._touched(wanted, now.cut) if now.held else set()
        held = {b: x for b, x in now.held.items() if b in touched}
        if not held or len(touched) * FEW < now.cut:
            yield self.read_by(wanted, empty)
        else:
            with self.bucketed(now.schema, now.cut, held) as stored:
                yield stored.drop(DIGEST).join(wanted.select(*self.by).repartition(now.cut, *self.by), self.by, "left_semi")

    def written(self) -> DataFrame | None:
        """The rows of the buckets that the newest version wrote; after an upsert that found its rows as they were, those of the
        buckets that hold them."""
        now = self._newest()
        if self._found is not None:
            return self._rows(now, self._found)
        return self._rows(now, {b for b, (v, _) in now.held.items() if v == now.version}) if now.version else None

    def _bucket(self, cut: int) -> F.Column:
        return F.pmod(F.hash(*self.by), F.lit(cut)).cast("int")  # what Spark buckets by

    def _touched(self, rows: DataFrame, cut: int) -> set[int]:
        return {r["b"] for r in rows.select(self._bucket(cut).alias("b")).distinct().collect()}  # at most ``cut`` rows

    @contextmanager
    def bucketed(self, schema: T.StructType, cut: int, held: dict[int, tuple[int, int]]) -> Iterator[DataFrame]:
        """Stored buckets as a table that Spark knows to be bucketed by the key; it is known by name only meanwhile."""
        name, columns = f"tf_{uuid.uuid4().hex}", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        keys = ", ".join(f"`{k}`" for k in self.by)
        self.spark.sql(f"create table {name} ({columns}, `{BUCKET}` int) using parquet partitioned by (`{BUCKET}`) clustered by ({keys}) into {cut} buckets location '{self.path}/none'")
        try:
            places = [f"partition (`{BUCKET}` = {b}) location '{self._folder(v, b)}'" for b, (v, _) in held.items()]
            for at in range(0, len(places), 1000):
                self.spark.sql(f"alter table {name} add {' '.join(places[at : at + 1000])}")
            yield self.spark.table(name).drop(BUCKET)
        finally:
            self.spark.sql(f"drop table {name}")

    @contextmanager
    def _joined_as_dealt(self) -> Iterator[None]:
        """Meanwhile sides dealt alike by some of a join's keys are not dealt again by all of them."""
        name = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(self.by == self.keys).lower())
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def _stage(self, rows: DataFrame, version: int, order: str | None, delete: DataFrame | None, whole: Whole | None = None) -> tuple[DataFrame, int]:
        """The incoming rows, one a key, with their digests, and keys to be deleted; written once, so that what follows does
        not evaluate them again. And how many rows came."""
        rows, seen = observe(rows, n=F.count(F.lit(1)))
        last = last_wins(rows, self.keys, order) if order else rows
        last = whole(last) if whole else last
        staged = last.withColumns({DIGEST: content_hash(last), GONE: F.lit(False)})
        if delete is not None:
            gone = delete.select(*self.keys).distinct().join(last.select(*self.keys), self.keys, "left_anti").withColumn(GONE, F.lit(True))
            staged = staged.unionByName(gone, allowMissingColumns=True)
        path = f"{self.path}/staged/v={version}"
        staged.write.mode("overwrite").parquet(path, **PARQUET)
        return self.spark.read.schema(staged.schema).parquet(path), counted(seen).get("n", 0)

    def merged(self, stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, Observation]:
        """Stored rows but those whose keys come in, and the incoming ones; and what counts the keys that are new and the rows
        that come with the content they have."""
        rest = [c for c in stored.columns if c not in self.keys]
        old = stored.select(*self.keys, F.struct(*rest).alias("__old"))
        new = incoming.select(*self.keys, F.struct(*rest).alias("__new"), GONE)
        came = F.col("__new").isNotNull() & ~F.col(GONE)
        same = F.col(f"__old.{DIGEST}") == F.col(f"__new.{DIGEST}")
        both, seen = observe(old.join(new, self.keys, "full"), inserted=F.count_if(came & F.col("__old").isNull()), unchanged=F.count_if(came & same))
        row = F.coalesce(F.col("__new"), F.col("__old")).alias("__row")
        return both.where(~F.coalesce(F.col(GONE), F.lit(False))).select(*self.keys, row).select(*self.keys, "__row.*").select(*stored.columns), seen

    def merged_by(self, stored: DataFrame, incoming: DataFrame, cut: int) -> tuple[DataFrame, Observation]:
        """What ``merged`` gives, dealt by ``by``, of which not all keys are part: rows of a key meet in an aggregation, which takes
        them as they are dealt, where a join would deal them by all keys and they would be moved again to be written.
        For tables whose buckets double."""
        rest = [c for c in stored.columns if c not in self.keys]
        sides = [(stored.withColumn(GONE, F.lit(False)), False), (incoming, True)]
        old, new = (side.select(*self.keys, F.struct(*rest).alias("__row"), GONE, F.lit(came).alias("__came")) for side, came in sides)
        digest = lambda came: F.max(F.when(F.col("__came") == came, F.col(f"__row.{DIGEST}")))
        both = old.unionByName(new).repartition(cut, *self.by).groupBy(*self.keys).agg(
            F.max_by(F.struct("__row", GONE), F.col("__came")).alias("__last"), F.max("__came").alias("__new"), F.min("__came").alias("__only"), digest(True).alias("__d1"), digest(False).alias("__d0")
        )
        came = F.col("__new") & ~F.col(f"__last.{GONE}")
        both, seen = observe(both, inserted=F.count_if(came & F.col("__only")), unchanged=F.count_if(came & (F.col("__d0") == F.col("__d1"))))
        return both.where(~F.col(f"__last.{GONE}")).select(*self.keys, "__last.__row.*").select(*stored.columns), seen

    def _write(self, rows: DataFrame, version: int, cut: int) -> dict[int, tuple[int, int]]:
        path, name = f"{self.path}/data/v={version}", f"tf_{uuid.uuid4().hex}"
        remove(self.spark, path)  # of an upsert that failed
        rows.withColumn(BUCKET, self._bucket(cut)).write.partitionBy(BUCKET).bucketBy(cut, *self.by).sortBy(*self.keys).options(**PARQUET).option("path", path).saveAsTable(name)
        self.spark.sql(f"drop table {name}")  # the files stay
        counts = self.spark.read.schema(f"`{BUCKET}` int").parquet(path).groupBy(BUCKET).count().collect()  # at most ``cut`` rows
        return {r[BUCKET]: (version, r["count"]) for r in counts}

    def _commit(self, new: Manifest) -> None:
        before = self._manifests()
        row = self.spark.createDataFrame([(new.version, new.cut, json.dumps(new.held), new.schema.json())], "version long, cut int, held string, fields string")
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/n={new.version}")
        remove(self.spark, f"{self.path}/staged/v={new.version}")
        named = {(b, v) for m in (new, *before[: KEPT - 1]) for b, (v, _) in m.held.items()}
        for old in before[KEPT - 1 :]:
            for v in {v for v, _ in old.held.values()} - {v for _, v in named}:
                remove(self.spark, f"{self.path}/data/v={v}")
            for b, (v, _) in old.held.items():
                if (b, v) not in named:
                    remove(self.spark, self._folder(v, b))
            remove(self.spark, f"{self.path}/manifest/n={old.version}")

    def _cut(self, n: int) -> int:
        return self.buckets or max(1, -(-n // PER_BUCKET))

    def _replace(self, staged: DataFrame, version: int) -> int:
        staged = staged.where(~F.col(GONE)).drop(GONE)
        n = staged.count()
        cut = self._cut(n)
        self._commit(Manifest(version, cut, self._write(staged.repartition(cut, *self.by), version, cut) if n else {}, staged.schema))
        return n

    def _deal(self, rows: DataFrame, cut: int, order: str | None, whole: Whole | None = None) -> tuple[DataFrame, Observation]:
        """The rows dealt to ``cut`` buckets, moved once, one a key, then made whole, with their digests; and what counts those that
        came."""
        rows, seen = observe(rows, n=F.count(F.lit(1)))
        dealt = rows.repartition(cut, *self.by)
        last = last_wins(dealt, self.keys, order) if order else dealt
        last = whole(last) if whole else last
        return last.withColumn(DIGEST, content_hash(last)), seen

    def _fill(self, rows: DataFrame, version: int, cut: int, order: str | None = None, whole: Whole | None = None) -> tuple[int, int]:
        """A version of these rows only: how many came and how many are held."""
        made, seen = self._deal(rows, cut, order, whole)
        held = self._write(made, version, cut)
        self._commit(Manifest(version, cut, held, self._stored(made.schema, held).schema))  # all nullable, as files are read
        return counted(seen).get("n", 0), sum(n for _, n in held.values())

    def replace(self, rows: DataFrame, about: int | None = None, whole: Whole | None = None) -> None:
        """A new version with these rows only, and the number of buckets that they call for. Who knows ``about`` how many there
        are spares that the rows are written once more to be counted. ``whole``: see ``upsert``."""
        self._found, version = None, self._newest().version + 1
        if about:
            self._fill(rows, version, self._cut(about), whole=whole)
        else:
            self._replace(self._stage(rows, version, None, None, whole)[0], version)

    def _compared(self, rows: DataFrame, now: Manifest, order: str | None) -> tuple[int, int, int]:
        """How many rows came, how many keys they have, and how many of these are stored with the same content and stamps. Only
        keys, digests and stamps are moved."""
        marks = [DIGEST, *(c for c in STAMPS if c in rows.columns and c not in self.keys)]
        narrow = rows.withColumn(DIGEST, content_hash(rows)).select(*dict.fromkeys([*self.keys, *([order] if order else []), *marks])).repartition(now.cut, *self.by)
        mark = F.struct(*marks)
        last = narrow.groupBy(*self.keys).agg((F.max_by(mark, F.col(order)) if order else F.first(mark)).alias("__new"), F.count(F.lit(1)).alias("__n"))
        with self.bucketed(now.schema, now.cut, now.held) as stored:
            both = last.join(stored.select(*self.keys, mark.alias("__old")), self.keys, "left")
            got = both.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("__new").eqNullSafe(F.col("__old")))).first()
        return tuple(got)

    def upsert(self, rows: DataFrame, order: str | None = None, delete: DataFrame | None = None, whole: Whole | None = None) -> dict[str, int]:
        """Put ``rows`` in place of those with their keys; of rows with one key that with the greatest ``order``. Keys of
        ``delete`` that ``rows`` lacks go. Buckets that neither touches are not read. ``whole`` makes the rows, which are moved as
        they come, into those to be stored; it leaves keys and ``order`` as they are.

        Returns inserted (keys that were not there), updated (all other incoming rows), unchanged (stored rows that came
        with the content they have, stamps aside) and keys (that came).
        """
        self._found, now = None, self._newest()
        version = now.version + 1
        if now.held:  # as the table has them
            rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in now.schema if f.name != DIGEST])
        if delete is None and self.by == self.keys:
            done = self._upsert_whole(rows, now, order, whole)
            if done is not None:
                return done
        staged, came = self._stage(rows, version, order, delete, whole)
        if not now.held:
            n = self._replace(staged, version)
            return {"inserted": n, "updated": came - n, "unchanged": 0, "keys": n}
        touched = self._touched(staged, now.cut)
        if not touched:
            remove(self.spark, f"{self.path}/staged/v={version}")
            return {"inserted": 0, "updated": 0, "unchanged": 0, "keys": 0}
        keys = staged.where(~F.col(GONE)).count()
        cut, most = now.cut, now.rows() + keys
        while self.buckets is None and most > 2 * PER_BUCKET * cut:
            cut *= 2
        if cut > now.cut:
            touched = set(now.held) | touched
        old = {b: x for b, x in now.held.items() if b in touched}
        kept = {b: x for b, x in now.held.items() if b not in touched}
        if len(touched) * FEW < now.cut:
            # a bucketed scan has a task for each bucket of the table; of a few buckets the rows are moved instead
            stored = self._stored(now.schema, old)
            merged, seen = self.merged(stored, staged)
            written = self._write(merged.repartition(len(touched), self._bucket(cut)), version, cut)
        elif self.by != self.keys and cut > now.cut:
            merged, seen = self.merged_by(self._stored(now.schema, old), staged, cut)
            written = self._write(merged, version, cut)
        else:
            with self.bucketed(now.schema, now.cut, old) as stored, self._joined_as_dealt():
                merged, seen = self.merged(stored, staged.repartition(now.cut, *self.by))
                written = self._write(merged, version, cut)
        self._commit(Manifest(version, cut, kept | written, now.schema))
        found = counted(seen)
        return {"inserted": found["inserted"], "updated": came - found["inserted"], "unchanged": found["unchanged"], "keys": keys}

    def _upsert_whole(self, rows: DataFrame, now: Manifest, order: str | None, whole: Whole | None = None) -> dict[str, int] | None:
        """An upsert that takes nothing away, of most buckets: rows are moved once, to their buckets, and written there. Where all
        are stored as they come, as after a run that is repeated, nothing is written. None if few buckets or none are touched."""
        version = now.version + 1
        if not now.held:
            n = rows.count()
            if not n:
                return None
            came, held = self._fill(rows, version, self._cut(n), order, whole)
            return {"inserted": held, "updated": came - held, "unchanged": 0, "keys": held}
        touched = self._touched(rows, now.cut)
        if not touched or len(touched) * FEW < now.cut:
            return None
        came, keys, same = self._compared(whole(rows) if whole else rows, now, order)
        if same == keys:
            self._found = touched
            return {"inserted": 0, "updated": came, "unchanged": same, "keys": keys}
        cut, most = now.cut, now.rows() + keys
        while self.buckets is None and most > 2 * PER_BUCKET * cut:
            cut *= 2
        if cut > now.cut:
            touched = set(now.held) | touched
        with self.bucketed(now.schema, now.cut, {b: x for b, x in now.held.items() if b in touched}) as stored:
            merged, seen = self.merged(stored, self._deal(rows, now.cut, order, whole)[0].withColumn(GONE, F.lit(False)))
            written = self._write(merged, version, cut)
        self._commit(Manifest(version, cut, {b: x for b, x in now.held.items() if b not in touched} | written, now.schema))
        found = counted(seen)
        return {"inserted": found["inserted"], "updated": came - found["inserted"], "unchanged": found["unchanged"], "keys": keys}


def store_run(classified_valid: DataFrame, classified_bad: DataFrame, valid: Table, bad: Table, whole: Whole | None = None) -> dict[str, int]:
    """Write a run's outputs: by business key, and by (run, row). Running it again changes no row count. Returns the counters
    of both tables, those of the second as ``quarantine_...``. ``whole`` is for accepted rows that are moved in another form."""
    counts = valid.upsert(classified_valid, order="source_row_number", whole=whole)
    more = bad.upsert(classified_bad, order="source_row_number")
    return counts | {f"quarantine_{k}": n for k, n in more.items() if k != "keys"}
