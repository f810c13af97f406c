"""The periodic refresh as one streaming query (K1, K3, K4, K6-K9).

Every micro-batch updates the registry, the raw store, the recent and latest
tables, the alerts and the escalation log. Each step writes under the batch
number or compares with what is already stored, so a batch that is run again
after a failure leaves the same state.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from dockwatch.functions import textfn as tx, timefn as tf
from dockwatch.operators.dedupe import last_per_slot, latest_records
from dockwatch.operators.ordering import numbered
from dockwatch.plans import alerts as al, history as hi
from dockwatch.schemas import (LATEST, NEW_STATION_BASE, RAW_KEEP_DAYS, RAW_SNAPSHOT, SNAPSHOT,
                               STATION)
from dockwatch.session import stage
from dockwatch.sinks.log import FOLD_EVERY, fold, open_epochs, read_log, write_epoch
from dockwatch.sinks.notifications import append_notifications, fold_notifications
from dockwatch.sinks.tables import (drop_expired_days, drop_path, publish, publish_days, read_days,
                                    read_published)
from dockwatch.streaming.ingest import landed_files, typed

COUNTS = ("bikes", "docks_avail", "docks_total")


@dataclass(frozen=True)
class Store:
    """Where the refresh keeps its tables."""
    root: str

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"


def with_station_ids(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Ids by name; unknown names get new ids from 900000 up, in name order (K8)."""
    known = registry.groupBy("name").agg(F.min("station_id").alias("station_id"))
    fresh = rows.select("name").distinct().join(known, "name", "left_anti")
    top = registry.agg(F.greatest(F.coalesce(F.max("station_id"), F.lit(NEW_STATION_BASE - 1)),
                                  F.lit(NEW_STATION_BASE - 1))).scalar()
    given = numbered(fresh, [F.col("name").asc()], "n").select(
        "name", (F.col("n") + top).alias("station_id"))
    return rows.join(known.unionByName(given), "name")


def land(rows: DataFrame, epoch: int, store: Store) -> None:
    """Raw rows of one batch under their day and batch number (K4)."""
    out = rows.withColumns({"day": F.col("ts").cast("date"), "epoch": F.lit(epoch)})
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "epoch").parquet(store.at("raw")))


def recent(raw: DataFrame) -> DataFrame:
    """Snapshot rows of the raw store: newest fetch per station and slot (K2)."""
    won = last_per_slot(raw, ["station_id", "ts"], "fetched_at", list(COUNTS))
    return won.select("station_id", "ts", *[F.col(x).cast("short").alias(x) for x in COUNTS])


def latest(raw: DataFrame) -> DataFrame:
    """Newest fetch per station with its attributes (K3); also folds new rows into old."""
    cols = ["station_id", "ts", *COUNTS, "name", "district", "lon", "lat", "fetched_at"]
    won = latest_records(raw.select(*cols), ["station_id"], ["fetched_at", *COUNTS])
    return won.withColumns({x: F.col(x).cast("short") for x in COUNTS}).select(*cols)


_SEEN = "station_id long, level string"
REJECT = T.StructType([T.StructField("reason", T.StringType()), T.StructField("record", T.StringType())])


def _seen_before(spark: SparkSession, store: Store, epoch: int) -> DataFrame | None:
    """Alert levels kept by the newest earlier round, None if there was none."""
    last = max((e for e in open_epochs(spark, store.at("seen")) if e < epoch), default=None)
    if last is None:
        return None
    return spark.read.schema(_SEEN).parquet(f"{store.at('seen')}/epoch={last}")


def notify(alert_rows: DataFrame, epoch: int, store: Store) -> None:
    """Log what rose since the round before and keep this round's levels (K6).

    Only the levels of the round before are ever read, so older ones go.
    """
    spark = alert_rows.sparkSession
    before = _seen_before(spark, store, epoch)
    events, state = al.escalations(alert_rows, before)
    append_notifications(events, store.at("events"), epoch)
    state.write.mode("overwrite").parquet(f"{store.at('seen')}/epoch={epoch}")
    for old in [e for e in open_epochs(spark, store.at("seen")) if e < epoch][:-1]:
        drop_path(spark, f"{store.at('seen')}/epoch={old}")
    fold_notifications(spark, store.at("events"), FOLD_EVERY)


def reject(spark: SparkSession, parts: dict[str, DataFrame], epoch: int, store: Store, today: str) -> None:
    """Keep what does not count, with the reason: unreadable, ahead of the clock, or too late."""
    rows = [df.select(F.lit(why).alias("reason"), tx.as_json(*df.columns).alias("record"),
                      F.lit(today[:10]).cast("date").alias("day")) for why, df in parts.items()]
    write_epoch(reduce(DataFrame.unionByName, rows), store.at("rejects"), epoch)
    fold(spark, store.at("rejects"), REJECT, FOLD_EVERY)


def rejected(spark: SparkSession, store: Store) -> DataFrame:
    """reason, record, day and epoch of everything that did not count."""
    return read_log(spark, store.at("rejects"), REJECT)


def reject_counts(spark: SparkSession, store: Store) -> DataFrame:
    """How many records of each batch did not count, by reason."""
    return rejected(spark, store).groupBy("epoch", "reason").agg(F.count("*").alias("n"))


def refresh_batch(store: Store, prefix: str = "", fixes: dict[str, str] | None = None,
                  after: Callable[[SparkSession, int], None] | None = None,
                  keep_days: int | None = RAW_KEEP_DAYS,
                  now: str | None = None) -> Callable[[DataFrame, int], None]:
    """The work of one micro-batch; ``after`` can add scoring (K9).

    Retention and the rejection of readings from the future go by ``now`` (the clock if
    none is given), never by the newest reading. A reading may run ahead by a day of
    grace, for zones; but what counts as the newest slot never lies after ``now``, so a
    clock that runs ahead hides no other station.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        today = now or dt.date.today().isoformat()
        day = dt.date.fromisoformat(today[:10])
        ok, bad = typed(batch, prefix, fixes)
        ahead = F.col("fetched_at") >= F.lit((day + dt.timedelta(days=2)).isoformat()).cast("timestamp_ntz")
        parts = {"unreadable": bad, "ahead": ok.filter(ahead)}
        ok = ok.filter(~ahead)
        if keep_days is not None:
            old = F.col("fetched_at").cast("date") < F.lit((day - dt.timedelta(days=keep_days)).isoformat()).cast("date")
            parts["late"] = ok.filter(old)
            ok = ok.filter(~old)
        reject(spark, parts, epoch, store, today)
        registry = read_published(spark, store.at("registry"), STATION)
        rows = with_station_ids(ok, registry).withColumn("ts", tf.slot_start(F.col("fetched_at")))
        rows = stage(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                                   for f in RAW_SNAPSHOT.fields]), "batch")
        if not rows.take(1):
            return
        if rows.join(registry, "station_id", "left_anti").take(1):
            publish(hi.append_unseen(registry, rows), store.at("registry"))      # K7
        land(rows, epoch, store)
        # Only the days this batch touches are merged again.
        days = [r[0] for r in rows.select(F.col("ts").cast("date")).distinct().collect()]
        raw = spark.read.parquet(store.at("raw")).filter(F.col("day").isin(days))
        publish_days(recent(raw).withColumn("day", F.col("ts").cast("date")), store.at("recent"),
                     keep_days, today)
        if keep_days is not None:
            drop_expired_days(spark, store.at("raw"), today, keep_days)              # B9
        old_latest = read_published(spark, store.at("latest"), LATEST)
        publish(latest(old_latest.unionByName(rows.select(*old_latest.columns))), store.at("latest"))
        stations = read_published(spark, store.at("registry"), STATION)
        # Two days always hold the six hours that alerts look back.
        lately = read_days(spark, store.at("recent"), SNAPSHOT, newest=2, upto=today)
        if len(today) > 10:
            lately = lately.filter(F.col("ts") <= F.lit(today).cast("timestamp_ntz"))
        raised = stage(al.alerts(lately, stations), "alerts")
        publish(raised, store.at("alerts"))
        notify(raised, epoch, store)
        if after is not None:
            after(spark, epoch)

    return run


def refresh_stream(spark: SparkSession, source: str, store: Store, checkpoint: str,
                   prefix: str = "", fixes: dict[str, str] | None = None,
                   every: str | None = "10 minutes", files_per_trigger: int | None = None,
                   after: Callable[[SparkSession, int], None] | None = None,
                   keep_days: int | None = RAW_KEEP_DAYS, now: str | None = None) -> StreamingQuery:
    """Start the refresh; ``every=None`` works off what has landed and stops (K1)."""
    w = (landed_files(spark, source, files_per_trigger).writeStream
         .foreachBatch(refresh_batch(store, prefix, fixes, after, keep_days, now))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if every is None else w.trigger(processingTime=every)
    return w.start()


def upsert_latest(target: str) -> Callable[[DataFrame, int], None]:
    """A sink that folds new slot readings into a latest table (K3 on its own)."""

    def run(batch: DataFrame, epoch: int) -> None:
        schema = batch.schema
        old = read_published(batch.sparkSession, target, schema)
        both = old.unionByName(batch)
        publish(latest_records(both, ["station_id"], ["ts", *COUNTS]), target)

    return run
