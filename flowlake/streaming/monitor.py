"""Streaming operators ST1-ST11 on Structured Streaming.

* intake (ST1): landed packet rows (parquet/json/csv) or landed capture
  files (``binaryFile``, decoded by the capture decoder);
* windowed counters (ST3): event-time windows with a watermark in update mode,
  so state stays bounded; running totals (ST4, A32) are per-batch counters,
  summed on read, without any state;
* flow sessions (ST11): ``session_window`` per flow id;
* analysis per micro-batch (ST2, ST5, ST6, ST8, K7, X2): ``foreachBatch``
  scores the batch with a fitted detector and the threat rules, and appends
  alert rows to a folder per ``batch_id``; a retried batch replaces its own
  folder, also when it has no alert any more, so alerts are written once;
* replay (ST7): landed files of numbered 1,000-row batches with ``trigger(availableNow=True)``, a
  detector trained on them first; the clock of live analysis (ST2) is ``run_every``.

The reference watches processing time only; here every window is in event
time and rows later than the watermark (default 10 minutes) are dropped.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlake.operators import counters as counter_ops
from flowlake.operators import threat
from flowlake.schemas import PACKET_SCHEMA
from flowlake.session import ensure_checkpoint_dir

ALERT_SCHEMA = ("batch_id long, alert_type string, severity string, details string, n long, "
                "examples array<struct<packet_id: long, src_ip: string, dst_ip: string, score: double>>")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint folder (shared storage)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "flowlake-stream", f"{name}-{uuid.uuid4().hex[:12]}")


def packet_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema=None,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """ST1: landed packet rows as a stream (explicit schema, no inference)."""
    r = spark.readStream.format(fmt).schema(schema or PACKET_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def capture_stream(spark: SparkSession, path: str) -> DataFrame:
    """ST1: landed capture files, decoded per micro-batch."""
    from flowlake.sources import capture

    # metadata columns only: the contents are read in byte ranges by the decoder.
    # A stream has no last file to number, so ids hash the path and the packet's number.
    files = (spark.readStream.format("binaryFile")
                  .schema("path string, modificationTime timestamp, length long, content binary")
                  .option("pathGlobFilter", "*.*cap*").load(path)
                  .select("path", F.lit(0).cast("long").alias("file_no")))
    out = capture.decode_files(files, 128 * 1024 * 1024, spread=False)
    return out.withColumn("packet_id", F.xxhash64("source_file", "packet_id").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))


def windowed_counts(stream: DataFrame, ts: str = "ts", window: str = "300 seconds",
                    slide: str | None = None, watermark: str = "10 minutes", by: tuple = ()) -> DataFrame:
    """ST3: packets and bytes per event-time window (sliding when ``slide``)."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (event_time(stream, ts).withWatermark(ts, watermark)
                  .groupBy(w.alias("window"), *by)
                  .agg(F.count(F.lit(1)).alias("packets"),
                       F.sum(F.coalesce(F.col("packet_size"), F.lit(0))).cast("long").alias("bytes")))


def stream_counters(stream: DataFrame, ts: str = "ts", window: str | None = None,
                    watermark: str = "10 minutes") -> DataFrame:
    """ST4 / A32: (kind, key) counters.  Without ``window`` the totals run for
    the whole stream (use complete mode); with it the counts are per
    event-time window and the watermark bounds the state."""
    if window is None:
        return counter_ops.counters(stream)
    rows = counter_ops.counter_rows(event_time(stream, ts).withWatermark(ts, watermark), keep=(ts,))
    return (rows.groupBy(F.window(ts, window).alias("window"), "kind", "key")
                .agg(F.count(F.lit(1)).alias("packets"), F.sum("__size").cast("long").alias("bytes")))


def flow_sessions(stream: DataFrame, ts: str = "ts", gap: str = "60 seconds", watermark: str = "10 minutes",
                  flow: str = "flow_id") -> DataFrame:
    """ST11: per-flow sessions closed by more than a gap (a row just ``gap`` later still joins); state bounded by the watermark."""
    return (event_time(stream, ts).withWatermark(ts, watermark)
                  .groupBy(F.session_window(ts, gap).alias("session"), F.col(flow))
                  .agg(F.count(F.lit(1)).alias("packets"),
                       F.sum(F.coalesce(F.col("packet_size"), F.lit(0))).cast("long").alias("bytes")))


def batch_alerts(batch: DataFrame, batch_id: int, detector=None, malicious: DataFrame | None = None,
                 tor: DataFrame | None = None, id_col: str = "packet_id", examples: int = 5) -> DataFrame:
    """ST5 / ST6: anomaly alert when the detector flags rows, threat alert
    when any row scores high; one row per alert with up to ``examples``
    anomalous packets (first by id, T11)."""
    spark = batch.sparkSession
    parts = []
    if detector is not None and "isolation_forest" in detector.models:
        X = detector.features(batch)
        pred = detector.models["isolation_forest"].predict(X, keep=(id_col,))
        an = batch.join(pred.where(F.col("isolation_forest") == -1).select(id_col, "iforest_score"), id_col)
        parts.append(_alert_rows(an, batch_id, "anomaly", "Detected %d anomalous packets", id_col,
                                 F.col("iforest_score"), examples))
    if malicious is not None and tor is not None:
        scored = threat.threat_scores(batch, malicious, tor)
        high = scored.where(F.col("threat_level") == "high")
        parts.append(_alert_rows(high, batch_id, "threat", "Detected %d high severity threats", id_col,
                                 F.col("threat_score").cast("double"), examples))
    if not parts:
        return spark.createDataFrame([], ALERT_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _alert_rows(rows: DataFrame, batch_id: int, kind: str, text: str, id_col: str, score, examples: int) -> DataFrame:
    """One alert row when ``rows`` is not empty: count plus the first
    ``examples`` rows by id (a bounded top-k, never the whole group)."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    ex = (rows.select(F.col(id_col).alias("packet_id"), "src_ip", "dst_ip", score.alias("score"))
              .orderBy("packet_id").limit(examples)
              .agg(F.array_sort(F.collect_list(F.struct("packet_id", "src_ip", "dst_ip", "score"))).alias("examples")))
    return (n.crossJoin(ex).where(F.col("n") > 0)
             .select(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(kind).alias("alert_type"),
                     F.lit("high").alias("severity"), F.format_string(text, F.col("n")).alias("details"),
                     "n", "examples"))


def event_time(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp; a timestamp without zone is cast
    (sessions run in UTC, so the wall clock is kept)."""
    from pyspark.sql import types as T
    if isinstance(stream.schema[ts].dataType, T.TimestampNTZType):
        return stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return stream


def alert_writer(alerts_path: str, detector=None, malicious=None, tor=None, counters_path: str | None = None,
                 report_every: int = 10, on_alerts: Callable[[DataFrame, int], None] | None = None):
    """foreachBatch function: alerts appended per batch (idempotent by
    batch_id), running counters merged, a traffic report every N batches."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        alerts = batch_alerts(batch, batch_id, detector, malicious, tor)
        write_batch(alerts, alerts_path, batch_id)
        if on_alerts is not None:
            on_alerts(read_alerts(spark, alerts_path).where(F.col("batch_id") == batch_id), batch_id)
        if counters_path:
            write_batch(counter_ops.counters(batch), counters_path, batch_id)
            if report_every and batch_id % report_every == 0:
                write_batch(counter_ops.traffic_report(counter_totals(spark, counters_path)), counters_path + "_reports", batch_id)
    return handle


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Replace one batch's rows of a table with a folder per batch.  A batch that has no
    row, or none any more when it is retried, leaves an empty folder of the right schema."""
    rows.drop("batch_id").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """K7: the alert table (explicit schema: it may hold no alert at all)."""
    return spark.read.schema(ALERT_SCHEMA).parquet(path)


def counter_totals(spark: SparkSession, counters_path: str) -> DataFrame:
    """ST4: totals over all batches so far; each batch's counters replace their own when retried."""
    return (spark.read.schema("kind string, key string, packets long, bytes long").parquet(counters_path)
                 .groupBy("kind", "key").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes")))


def counter_writer(counters_path: str):
    """foreachBatch function for running counters: no state in the stream, however many keys it meets."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(counter_ops.counters(batch), counters_path, batch_id)
    return handle


def update_to_table(agg: DataFrame, path: str, checkpoint: str) -> None:
    """Run an aggregation in update mode: each batch adds the rows it changed, and
    the watermark evicts closed windows from the state."""
    q = (agg.writeStream.outputMode("update").foreachBatch(lambda b, n: write_batch(b, path, n))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest(spark: SparkSession, path: str, schema, keys: list) -> DataFrame:
    """The newest row of each key in a table made by ``update_to_table``."""
    rows = spark.read.schema(schema).parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")


def run_available_now(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """ST7: process everything landed so far, then stop."""
    q = (df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start())
    q.awaitTermination()


def run_every(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds",
              until: Callable[[dict], bool] | None = None) -> list[dict]:
    """ST2: analyse what has arrived on a clock.  ``until`` looks at the progress of each finished batch; the query
    stops cleanly once it says so (never, if it is missing).  Returns the progress of the finished batches."""
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    seen: dict[int, dict] = {}
    try:
        while q.isActive:
            for p in q.recentProgress:
                if p["numInputRows"]:
                    seen[p["batchId"]] = dict(p)
            if until is not None and any(until(p) for p in seen.values()):
                break
            q.awaitTermination(0.2)
    finally:
        q.stop()
    return [seen[k] for k in sorted(seen)]


def recent_writer(path: str, n: int = 10_000, order_cols=("ts", "packet_id")):
    """ST3: foreachBatch function that keeps the last ``n`` rows in ``order_cols`` order over all batches so far.

    A batch's folder holds the last rows of its own and of the folder before it, so a retried batch replaces its own
    and the state is ``n`` rows, in two folders; older ones are deleted."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id:
            batch = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/batch_id={batch_id - 1}"))
        batch.orderBy(*[F.desc(c) for c in order_cols]).limit(n).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return handle


def recent_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """ST3: the rows that ``recent_writer`` holds now."""
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    last = rows.agg(F.max("batch_id")).first()[0]
    return rows.where(F.col("batch_id") == last).drop("batch_id")


# ---- replay (ST5, ST7) ---------------------------------------------------------


def land_batches(packets: DataFrame, path: str, order_cols=("ts", "packet_id"), size: int = 1000, batches_per_file: int = 100) -> None:
    """Write packets as the landed files of a replay: ``replay_batch`` numbers ``size`` rows each in order,
    and a file holds whole batches, so a stream over the files never cuts one."""
    from flowlake.operators.order import batch_numbers
    rows = batch_numbers(packets, list(order_cols), size, out="replay_batch")
    chunk = F.floor(F.col("replay_batch") / batches_per_file)
    rows.withColumn("__chunk", chunk).repartition("__chunk").sortWithinPartitions("replay_batch").write.partitionBy("__chunk").parquet(path)


def alerts_by_batch(rows: DataFrame, detector=None, malicious: DataFrame | None = None, tor: DataFrame | None = None,
                    id_col: str = "packet_id", batch: str = "replay_batch", examples: int = 5) -> DataFrame:
    """ST5 / ST6 for many batches at once: the alerts that ``batch_alerts`` gives for each, ``batch_id`` being the
    replay's batch number.  Batches hold a bounded number of rows, so their examples are ranked in one window."""
    def per_batch(found: DataFrame, kind: str, text: str, score) -> DataFrame:
        w = Window.partitionBy(batch).orderBy("packet_id", "src_ip", "dst_ip")
        r = found.select(batch, F.col(id_col).alias("packet_id"), "src_ip", "dst_ip", score.alias("score")).withColumn("__r", F.row_number().over(w))
        ex = F.array_sort(F.collect_list(F.when(F.col("__r") <= examples, F.struct("packet_id", "src_ip", "dst_ip", "score"))))
        return r.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), ex.alias("examples")).select(
            F.col(batch).cast("long").alias("batch_id"), F.lit(kind).alias("alert_type"), F.lit("high").alias("severity"),
            F.format_string(text, F.col("n")).alias("details"), "n", "examples")
    parts = []
    if detector is not None and "isolation_forest" in detector.models:
        pred = detector.models["isolation_forest"].predict(detector.features(rows), keep=(id_col,))
        found = rows.join(pred.where(F.col("isolation_forest") == -1).select(id_col, "iforest_score"), id_col)
        parts.append(per_batch(found, "anomaly", "Detected %d anomalous packets", F.col("iforest_score")))
    if malicious is not None and tor is not None:
        high = threat.threat_scores(rows, malicious, tor).where(F.col("threat_level") == "high")
        parts.append(per_batch(high, "threat", "Detected %d high severity threats", F.col("threat_score").cast("double")))
    if not parts:
        return rows.sparkSession.createDataFrame([], ALERT_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def replay(spark: SparkSession, landed: str, schema, alerts_path: str, checkpoint: str, detector=None, config=None,
           malicious: DataFrame | None = None, tor: DataFrame | None = None, features=None, id_col: str = "packet_id",
           files_per_trigger: int = 8):
    """ST7: replay landed packets in order of their batches and write the alerts of every batch.

    Without a ``detector`` one is trained on all landed rows first (on ``features`` columns, with ``config``).  A micro-batch
    takes ``files_per_trigger`` files of whole batches; its alerts replace their own folder when it is retried, and a run
    that was stopped goes on where its checkpoint stands.  Returns the detector, for the next run."""
    from flowlake.operators.detect.detector import AnomalyDetector
    if detector is None and features is not None:
        rows = spark.read.schema(schema).parquet(landed)
        detector = AnomalyDetector(config).fit(rows.select(id_col, *features), id_col)
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landed)

    def sink(batch: DataFrame, n: int) -> None:
        found = alerts_by_batch(batch, detector, malicious, tor, id_col)
        found.withColumnRenamed("batch_id", "replay_batch").write.mode("overwrite").parquet(f"{alerts_path}/run={n}")
    run_available_now(files, sink, checkpoint)
    return detector


def read_replay_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts of a replay: one row for each batch and kind."""
    schema = ALERT_SCHEMA.replace("batch_id", "replay_batch", 1)
    return spark.read.schema(schema).parquet(path).withColumnRenamed("replay_batch", "batch_id").drop("run")


# ---- sessions (ST11) -----------------------------------------------------------

_MERGE_LOCALLY = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def sessions_to_table(agg: DataFrame, out_path: str, checkpoint: str) -> int:
    """ST11: run ``flow_sessions`` over what the source has, in append mode.

    A session is written once, when the watermark has passed its end, and leaves the state, so the state holds the open
    sessions alone.  Rows are merged into sessions inside each partition before the shuffle, so a hot flow sends its
    sessions and not its rows.  A retried batch replaces its own folder.  Returns the rows that were dropped for coming
    later than the watermark allows (counted after that merge); 0 says that nothing is lost."""
    spark = agg.sparkSession
    before = spark.conf.get(_MERGE_LOCALLY, "false")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={n}")
    spark.conf.set(_MERGE_LOCALLY, "true")
    try:
        q = (agg.writeStream.outputMode("append").foreachBatch(write)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(_MERGE_LOCALLY, before)
    late: dict[int, int] = {}
    done = False
    while not done:
        done = q.awaitTermination(1)
        for p in q.recentProgress:
            late[p["batchId"]] = sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])
    return sum(late.values())


def open_sessions(spark: SparkSession, checkpoint: str, flow: str = "flow_id", batch: int | None = None) -> DataFrame:
    """ST11 / ST9: the sessions that no gap has closed yet, read from the state of the last finished batch."""
    reader = spark.read.format("statestore")
    state = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    window, key, packets, size = state.schema["value"].dataType.names
    return state.select(F.col("value")[window].alias("session"), F.col("value")[key].alias(flow),
                        F.col("value")[packets].alias("packets"), F.col("value")[size].alias("bytes"))


def all_sessions(spark: SparkSession, out_path: str, checkpoint: str, flow: str = "flow_id") -> DataFrame:
    """ST11: closed and open sessions as of the last finished batch.  Folders of a batch that wrote its sessions but did
    not finish are left out: its sessions are still open in the state that is read."""
    last = spark.read.format("state-metadata").load(checkpoint).agg(F.max("maxBatchId")).first()[0]
    closed = spark.read.option("basePath", out_path).parquet(out_path).where(F.col("batch_id") <= last).drop("batch_id")
    return (closed.withColumn("closed", F.lit(True))
                  .unionByName(open_sessions(spark, checkpoint, flow, last).withColumn("closed", F.lit(False))))


def complete_to_table(agg: DataFrame, out_path: str, checkpoint: str) -> None:
    """Run an aggregation in complete mode, each batch overwriting a table."""
    def write(batch: DataFrame, _bid: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)
    q = (agg.writeStream.outputMode("complete").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def current_stats(spark: SparkSession, counters_path: str, alerts_path: str, last: int = 20) -> dict:
    """ST9: totals so far and the most recent anomaly alerts."""
    recent = (read_alerts(spark, alerts_path).where(F.col("alert_type") == "anomaly").orderBy(F.desc("batch_id")).limit(last))
    return {"totals": counter_totals(spark, counters_path), "recent_anomaly_alerts": recent}
