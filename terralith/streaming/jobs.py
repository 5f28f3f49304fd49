"""Structured Streaming jobs: continuous ingest, daily counts, pending alerts, audit append."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from terralith.operators import audit, notifications, rules


def _start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _write_batch(out: DataFrame, batch_id: int, store: str) -> None:
    """A batch has its own partition, so that one replayed after a failure replaces itself."""
    (out.withColumn("batch_no", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(store))


def stateful(spark: SparkSession) -> None:
    """Keyed state is kept by RocksDB on the executors; a stream takes the provider that is set when it starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FirstOfHash(StatefulProcessor):
    """Which uploads of a content hash are taken; the state is the id of the first copy that is alive.

    The first upload of a hash in a batch is taken while no live copy is known; a copy that failed or was rejected is
    none, so the hash is taken again later.
    """

    def __init__(self, order: str, id_type: str):
        self.order, self.id_type = order, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", f"doc_id {self.id_type}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.live.get()[0] if self.live.exists() else None
        uploads = pd.concat(list(rows)).sort_values(self.order, kind="stable", ignore_index=True)
        first = uploads.iloc[0]
        taken = known is None
        existing = known if known is not None else first["doc_id"]
        outcome = ["skipped"] * len(uploads)
        if taken:
            outcome[0] = "taken"
            if first["status"] != "failed" and first["record_status"] != "rejected":
                id_of = int if self.id_type in ("bigint", "int") else str
                self.live.update((id_of(first["doc_id"]),))
        yield uploads.assign(existing_doc_id=pd.Series([existing] * len(uploads), dtype=object),
                             outcome=pd.Series(outcome, dtype=object))

    def close(self) -> None:
        pass


def ingest(uploads: DataFrame, store: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None,
           skipped: str | None = None, order: str = "seq") -> StreamingQuery:
    """Take each content hash once, however late its upload comes; a hash whose copies all failed is taken again.

    What is known of a hash is keyed state, so a batch reads neither the store nor any index of it: its cost is that of
    its own uploads, whatever came before. Uploads that are not taken go to the table ``skipped`` with their reason. No
    watermark: nothing is dropped for being late, and the state holds one id per hash.
    """
    stateful(uploads.sparkSession)
    id_type = uploads.schema["doc_id"].dataType
    kind = T.StructType([*uploads.schema.fields, T.StructField("existing_doc_id", id_type), T.StructField("outcome", T.StringType())])
    judged = uploads.groupBy("file_hash").transformWithStateInPandas(
        FirstOfHash(order, id_type.simpleString()), outputStructType=kind, outputMode="Append", timeMode="None")

    def handle(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        if skipped:
            _write_batch(held.where("outcome = 'skipped'").drop("outcome").withColumn(
                "reason", F.lit("duplicate_file_hash")), batch_id, skipped)
        fresh = held.where("outcome = 'taken'").select(*uploads.columns)
        _write_batch(process(fresh) if process else fresh, batch_id, store)
        held.unpersist()

    return _start(judged, handle, checkpoint)


def compact(spark: SparkSession, store: str, before: int, into: str) -> None:
    """Batches under ``before`` of a store as one partition, batch_no = -1, of the table ``into``; later ones as they are.

    The old store stays as it is until readers have moved on; row counts are compared before this returns.
    """
    rows = spark.read.parquet(store)
    merged = rows.withColumn("batch_no", F.when(F.col("batch_no") < before, F.lit(-1)).otherwise(F.col("batch_no")))
    merged.repartition("batch_no").write.partitionBy("batch_no").parquet(into)
    if spark.read.parquet(into).count() != rows.count():
        raise RuntimeError(f"{into} does not hold what {store} holds")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def daily_counts(documents: DataFrame, event_time: str = "created_at", delay: str = "2 days") -> DataFrame:
    """Documents per day, with late rows accepted up to ``delay``."""
    return (documents.withWatermark(event_time, delay).groupBy(F.window(event_time, "1 day"))
            .agg(F.count("*").alias("documents"))
            .select(F.to_date("window.start").alias("day"), "documents"))


def heads_of(store: str) -> str:
    """The table of heads beside an audit log: one row per batch, in a partition of its own."""
    return f"{store.rstrip('/')}-heads"


def append_audit(entries: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Chain each micro-batch after the head of the batch before it, which is one row of ``heads_of(store)``.

    The log itself is not read again, however many batches it has. A batch replayed after a failure replaces its own
    entries and its own head. The source bounds a batch (``maxFilesPerTrigger``).
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, heads = batch.sparkSession, heads_of(store)
        last = _last_head(spark, heads, batch_id)
        _write_batch(audit.append(batch, last.entry_hash if last else audit.GENESIS_HASH), batch_id, store)
        written = spark.read.parquet(f"{store}/batch_no={batch_id}") if _exists(spark, f"{store}/batch_no={batch_id}") else None
        head = written.agg(F.max("id").alias("id"), F.max_by("entry_hash", "id").alias("entry_hash")) if written else None
        if head is None and last is not None:       # a batch without entries hands the head on
            head = spark.createDataFrame([(last.id, last.entry_hash)], "id long, entry_hash string")
        if head is not None:
            _write_batch(head.coalesce(1), batch_id, heads)

    return _start(entries, handle, checkpoint)


def _last_head(spark: SparkSession, heads: str, batch_id: int):
    """The head before a batch: that of the batch before it; if that one wrote none, of the last batch that did."""
    before = f"{heads}/batch_no={batch_id - 1}"
    if _exists(spark, before):
        return spark.read.parquet(before).select("id", "entry_hash").first()
    if not _exists(spark, heads):
        return None
    return spark.read.parquet(heads).where(F.col("batch_no") < batch_id).orderBy(F.desc("batch_no")).select(
        "id", "entry_hash").first()


def _alerts(record_id: str, since_ms: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"record_id": pd.Series([record_id] * len(since_ms), dtype=object),
                         "pending_since": pd.to_datetime(pd.Series(since_ms, dtype="int64"), unit="ms")})


class PendingTimer(StatefulProcessor):
    """One timer per record: opens when the record turns pending, is cancelled by any other status."""

    def __init__(self, hours: int):
        self.wait_ms = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "ms long")

    def _cancel(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.since.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Events in their order. One that ends a wait which was over already alerts as the timer would have done."""
        events = pd.concat(list(rows))
        events["ts"] = events["ts"].dt.floor("ms")              # what state and timers keep of a moment
        events = events.sort_values(["ts", "seq"] if "seq" in events else ["ts"], kind="stable")
        since = self.since.get()[0] if self.since.exists() else None
        before, due = since, []
        for ts, status in zip(events["ts"], events["status"]):
            at = ts.value // 1_000_000
            if since is not None and since >= 0 and at >= since + self.wait_ms:
                due.append(since)
                since = -1                                  # alerted: silent until another status comes
            if status != "pending_review":
                since = None
            elif since is None:
                since = at
        if since != before:
            self._cancel()
            if since is not None:
                self.since.update((since,))
                if since >= 0:
                    self.handle.registerTimer(since + self.wait_ms)
        yield _alerts(key[0], due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since = self.since.get()[0] if self.since.exists() else -1
        if since >= 0:
            self.since.update((-1,))
            yield _alerts(key[0], [since])

    def close(self) -> None:
        pass


def pending_alerts(status_changes: DataFrame, hours: int = 48, delay: str = "1 hour") -> DataFrame:
    """Alert once for every time that a record stays pending for ``hours``; input (record_id, status, ts and, where events
    of one record may fall into one millisecond, seq as their order).

    Which alerts there are does not depend on how the events are dealt into batches.
    """
    stateful(status_changes.sparkSession)
    return (status_changes.withWatermark("ts", delay).groupBy("record_id").transformWithStateInPandas(
        statefulProcessor=PendingTimer(hours), outputStructType="record_id string, pending_since timestamp",
        outputMode="Append", timeMode="EventTime"))


def severe_alerts(findings: DataFrame, records: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Reviewer events for records with a high or critical finding: a stream of findings joined with the table of records.

    The findings of a record come in one batch, as the job that makes them writes them; each batch that has some announces
    it. A batch replayed after a failure replaces its own events. Who is addressed is a join of the events with the
    users of that time (``notifications.fan_out``), so the store does not multiply by the number of users.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        totals = rules.rollup(batch).drop("record_id")
        rolled = records.drop("discrepancy_count", "highest_severity").join(totals, "id")
        _write_batch(notifications.high_severity_events(rolled), batch_id, store)

    return _start(findings, handle, checkpoint)
