"""The batch job: an order file to the raw store, classified once, checked, upserted, counted and logged; and the job that
brings views and reports up to date.

Below ``root``: ``raw``, ``landed`` (what file a run id stands for), ``classified`` (a folder a run, slim), ``orders`` and
``quarantine`` (keyed tables), ``views``, ``reports`` and ``metrics`` (a row an attempt). A run that is repeated, after a
failure or by choice, changes no row count.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import checks, classify, reports, store, views
from tallyforge.operators.observed import counted, observe
from tallyforge.sources import order_files
from tallyforge.sources.paths import PARQUET, exists, n_bytes, remove
from tallyforge.sources.scratch import job_scratch

METRICS = (
    "id_run string, attempt string, processed_at string, source_file string, source_bytes long, engine string, status string, n_raw long, n_valid long, n_corrected long, "
    "n_quarantined long, balanced boolean, rules map<string, long>, errors map<string, long>, counters map<string, long>, quarantine_counters map<string, long>, "
    "seconds double, rows_per_second double"
)


def tables(spark: SparkSession, root: str, buckets: int | None = None) -> tuple[store.Table, store.Table]:
    """The stored orders by their id, and the quarantined rows by run and row number."""
    return store.Table(spark, f"{root}/orders", ["id_order"], buckets), store.Table(spark, f"{root}/quarantine", ["id_run", "source_row_number"], buckets)


def land(spark: SparkSession, csv: str, root: str, id_run: str, stamp: str) -> DataFrame:
    """The file's rows in the raw store. A run that has landed is not landed again; another file under its id is an error."""
    name, size, log = csv.rstrip("/").rpartition("/")[2], n_bytes(spark, csv), f"{root}/landed/{id_run}"
    if exists(spark, log):
        landed = spark.read.schema("source_file string, source_bytes long").json(log).first()
        if tuple(landed) != (name, size):
            raise ValueError(f"run {id_run} stands for {landed[0]} of {landed[1]} bytes, not for {name} of {size}")
    else:
        remove(spark, f"{root}/raw/id_run={id_run}")  # of a landing that failed
        order_files.ingest(spark, csv, f"{root}/raw", id_run, stamp)
        spark.createDataFrame([(name, size)], "source_file string, source_bytes long").coalesce(1).write.mode("overwrite").json(log)
    return order_files.read_raw(spark, f"{root}/raw", id_run)


@dataclass
class Settled:
    """A run's classified rows, written slim, and what was counted meanwhile."""

    slim: DataFrame
    counts: dict[str, int]

    @property
    def table(self) -> DataFrame:
        return classify.whole(self.slim)

    def numbers(self, kind: str) -> dict[str, int]:
        return {k.removeprefix(f"{kind} "): int(n) for k, n in sorted(self.counts.items()) if k.startswith(f"{kind} ") and n}


def settle(raw: DataFrame, path: str, stamp: str, contract: str = "fail") -> Settled:
    """Classify ``raw`` once, below ``path``; rows by class, rule and error are counted while they are written. They are written
    slim, as they will be moved, and are read by ``classify.whole``.

    ``contract``: with ``fail`` a row that breaks the contract is an error, with ``quarantine`` it is a quarantined row.
    """
    if contract not in ("fail", "quarantine"):
        raise ValueError("contract is fail or quarantine")
    rows, unsound = classify.classify(raw, stamp), None
    if contract == "quarantine":
        rows = checks.quarantine_broken(rows)
    else:
        rows, unsound = checks.contract_violations(rows), (F.size("violations") > 0) & (F.col("classification") != "quarantined")
    rows, seen = observe(rows, **checks.tallies(unsound))
    rows = classify.slim(rows.drop("violations"))
    rows.write.mode("overwrite").parquet(path, **PARQUET)
    settled = Settled(raw.sparkSession.read.schema(rows.schema).parquet(path), counted(seen))
    counts = settled.counts
    if counts.get("n_unsound"):
        checks.enforce(classify.validated(settled.table))
    n = raw.count()
    if counts.get("n_raw", 0) != n or n != sum(counts.get(f"n_{c}", 0) for c in ("valid", "corrected", "quarantined")):
        checks.require_balance(raw, settled.slim)
    return settled


def keep(settled: Settled, good: store.Table, bad: store.Table, id_run: str) -> dict[str, int]:
    """Upsert a run's rows into both tables and check that they are there. Returns the counters of both."""
    n = store.store_run(classify.validated(settled.slim), classify.quarantined(settled.slim), good, bad, classify.whole)
    c = settled.counts
    checks.require_stored(id_run, c.get("n_valid", 0) + c.get("n_corrected", 0), n.pop("keys"), c.get("n_quarantined", 0), good.written(), bad.written())
    return n


def log(spark: SparkSession, path: str, id_run: str, stamp: str, source: tuple[str, int], settled: Settled, stored: dict[str, int], seconds: float) -> Row:
    """Append the attempt's row of metrics and return it."""
    c, part = settled.counts, "quarantine_"
    n = [int(c.get(k, 0)) for k in ("n_raw", "n_valid", "n_corrected", "n_quarantined")]
    counters = [{k.removeprefix(part): v for k, v in stored.items() if k.startswith(part) == bad} for bad in (False, True)]
    row = (id_run, uuid.uuid4().hex, stamp, *source, "spark", "SUCCESS", *n, n[0] == sum(n[1:]), settled.numbers("rule"), settled.numbers("error"), *counters, float(seconds), n[0] / max(seconds, 1e-9))
    logged = spark.createDataFrame([row], METRICS)
    logged.coalesce(1).write.mode("append").parquet(path)
    return logged.first()


def run(spark: SparkSession, csv: str, root: str, id_run: str, stamp: str, contract: str = "fail") -> Row:
    """Process one file and return its row of metrics. ``contract``: ``fail`` stops before anything is stored if a row breaks
    it, ``quarantine`` puts such rows among the quarantined."""
    began = time.monotonic()
    with job_scratch(spark):
        raw = land(spark, csv, root, id_run, stamp)
        settled = settle(raw, f"{root}/classified/{id_run}", stamp, contract)
        stored = keep(settled, *tables(spark, root), id_run)
    return log(spark, f"{root}/metrics", id_run, stamp, (csv.rstrip("/").rpartition("/")[2], n_bytes(spark, csv)), settled, stored, time.monotonic() - began)


def refresh(spark: SparkSession, root: str, name: str, at: str, mode: str = "incremental", top: int = 10) -> dict:
    """Bring the views up to date with the stored orders and publish the five reports as set ``name``."""
    orders = tables(spark, root)[0].read()
    if orders is None:
        raise ValueError("no orders are stored yet")
    with job_scratch(spark):
        done = views.Views(spark, f"{root}/views").refresh(orders, mode, at)
        return done | {"reports": reports.publish(orders, f"{root}/reports", name, top)}
