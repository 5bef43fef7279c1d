"""Claims, records and events as streams.

Every job is a Structured Streaming query with a checkpoint, so it goes on
where it stopped when an executor or the driver is lost.  Jobs that keep state
per claim take rows in the order of ``pos`` inside a micro-batch.  A row is a
replay only if the very same row was among the claim's last REMEMBERED ones;
rows that tie or come late are appended in the order of their arrival, never
dropped.  How many rows of one claim meet in
one task is bounded by the size of a micro-batch (``maxFilesPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallygrain import constants as C
from tallygrain.operators import kpi, maintain, memory as M, neardup
from tallygrain.operators.guard import judge
from tallygrain.operators.photoindex import PhotoIndex
from tallygrain.operators.trail import payload_column, sealable, sha2_text
from tallygrain.operators.vectors import with_intervals
from tallygrain.plans.verify import ClaimTables, verify_claims
from tallygrain.schemas import RUNS
from tallygrain.session import work_dir


RETRIES = 2  # of a micro-batch that failed for reasons which no claim causes
# signs of such reasons in an error's text: storage, missing tables and files, lost executors
ENVIRONMENT = (
    "No space left on device", "FileNotFoundException", "FAILED_READ_FILE", "PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "ExecutorLostFailure",
    "OutOfMemoryError", "SparkContext was shut down", "Connection refused", "java.io.IOException",
)
REMEMBERED = 10_000  # rows of a claim whose replay is recognised


def _unseen(rows: pd.DataFrame, seen: bytes) -> tuple[pd.DataFrame, bytes]:
    """Rows in the order of (pos, id) without replays, and the ids to remember."""
    known = np.frombuffer(seen, np.int64)
    rows = rows.drop_duplicates("row_id").sort_values(["pos", "row_id"])
    rows = rows[~np.isin(rows["row_id"].to_numpy(np.int64), known)]
    return rows, np.concatenate([known, rows["row_id"].to_numpy(np.int64)])[-REMEMBERED:].tobytes()


def read_files(spark: SparkSession, path: str, schema: Any, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).parquet(path)
    )


def _with(schema: T.StructType, partition: str) -> T.StructType:
    """A table's schema with its partition column."""
    return T.StructType([*schema.fields, T.StructField(partition, T.LongType())])


def drain(stream: DataFrame, purpose: str, folder: str | None = None) -> DataFrame:
    """Run an append stream over everything available and read its table."""
    spark = stream.sparkSession
    folder = folder or work_dir(spark, purpose)
    (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def drain_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], folder: str, mode: str = "append"
) -> None:
    (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


# --- sealing ----------------------------------------------------------------

SEALED = (
    "claim_id string, seq long, pos long, state_hash string, prev_record_hash string, record_hash string, "
    "status string, ts long, recorded_by string, note string"
)


def seal_stream(records: DataFrame) -> DataFrame:
    """Chain each claim's records as they arrive; state is (head hash, length, ids of the last rows)."""

    def step(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        head, length, seen = state.get if state.exists else (C.ZERO_HASH, 0, b"")
        rows, seen = _unseen(pd.concat(list(batches)), bytes(seen))
        prevs, hashes = [], []
        for payload in rows["payload"]:
            prevs.append(head)
            head = sha2_text(head + "|" + payload)
            hashes.append(head)
        if len(rows):
            out = rows.drop(columns=["payload", "row_id"])
            out["seq"] = range(length, length + len(rows))
            out["prev_record_hash"], out["record_hash"] = prevs, hashes
            state.update((head, length + len(rows), seen))
            yield out[[c.strip().split(" ")[0] for c in SEALED.split(",")]]

    ready = sealable(records).select(
        "claim_id", "pos", "state_hash", "status", "ts", "recorded_by", "note", payload_column().alias("payload")
    ).withColumn("row_id", F.xxhash64("pos", "payload"))
    return ready.groupBy("claim_id").applyInPandasWithState(
        step, SEALED, "head string, length long, seen binary", "append", GroupStateTimeout.NoTimeout
    )


# --- transition guard ---------------------------------------------------------

GUARDED = "claim_id string, pos long, kind string, requested string, previous string, code string, status string"


def guard_stream(requests: DataFrame) -> DataFrame:
    """Accept or refuse requests (claim_id, pos, kind, requested, note) in order.

    ``kind`` is verdict (computed), human or pay.  State is (status, ids of the
    last rows); a late request is judged when it arrives.
    """

    def step(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        status, seen = state.get if state.exists else ("SUBMITTED", b"")
        rows, seen = _unseen(pd.concat(list(batches)), bytes(seen))
        out = []
        for pos, kind, requested, note in zip(rows["pos"], rows["kind"], rows["requested"], rows["note"]):
            code, before = judge(status, kind, requested, note), status
            if code == "OK":
                status = "PAID" if kind == "pay" else requested
            out.append((key[0], pos, kind, requested, before, code, status))
        if out:
            state.update((status, seen))
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in GUARDED.split(",")])

    rows = requests.select("claim_id", "pos", "kind", "requested", "note")
    rows = rows.withColumn("row_id", F.xxhash64("pos", "kind", "requested", F.coalesce("note", F.lit(""))))
    return rows.groupBy("claim_id").applyInPandasWithState(
        step, GUARDED, "status string, seen binary", "append", GroupStateTimeout.NoTimeout
    )


# --- velocity, audit, key figures ----------------------------------------------

def _per_window(requests: DataFrame, source: str, ts: str, seconds: int) -> DataFrame:
    counts = requests.groupBy(F.col(source), F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return counts.select(source, F.col("w.start").alias("window_start"), "n")


def velocity(requests: DataFrame, source: str, ts: str, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Requests per source and window; compare ``n`` with the limit.  Rows that
    come later than the watermark are lost."""
    return _per_window(requests.withWatermark(ts, late), source, ts, seconds)


def too_fast(
    requests: DataFrame, source: str, ts: str, limit: int = C.INTAKES_PER_MINUTE, seconds: int = 60, late: str | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Windows over the limit, those that are still open as well.

    Each micro-batch writes its counts, and a window's counts are summed over all
    of them, so rows count in whatever order they come.  With ``late`` the counts
    are those of ``velocity``, which keeps less and loses rows that come later;
    the last count of a window holds.  A job that gives ``folder`` again goes on
    where it stopped.
    """
    spark = requests.sparkSession
    folder = folder or work_dir(spark, "velocity")
    counts = velocity(requests, source, ts, seconds, late) if late else _per_window(requests, source, ts, seconds)

    def save(batch: DataFrame, epoch: int) -> None:
        rows = batch if late else _per_window(batch, source, ts, seconds)
        rows.write.mode("overwrite").parquet(f"{folder}/counts/epoch={epoch}")

    drain_batches(counts if late else requests, save, folder, mode="update" if late else "append")
    saved = spark.read.schema(_with(counts.schema, "epoch")).parquet(f"{folder}/counts")
    total = F.max_by("n", "epoch") if late else F.sum("n")
    return saved.groupBy(source, "window_start").agg(total.alias("n")).where(F.col("n") > limit)


def audit_stream(records: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each (claim, hash, status, time) once, within the watermark."""
    return records.withWatermark(ts, late).dropDuplicatesWithinWatermark(["claim_id", "state_hash", "status", ts])


def audit_forever(records: DataFrame, folder: str) -> DataFrame:
    """The same without a time limit: each batch is checked against the table."""
    spark = records.sparkSession
    keys = ["claim_id", "state_hash", "status", "ts"]

    def add(batch: DataFrame, epoch: int) -> None:
        fresh = maintain.distinct_audit(batch)
        if epoch > 0:
            # earlier epochs only, so that a repeated batch writes the same rows
            stored = (
                spark.read.schema(_with(fresh.schema, "epoch"))
                .parquet(f"{folder}/table")
                .where(F.col("epoch") < epoch)
            )
            fresh = fresh.join(stored.select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/table/epoch={epoch}")

    drain_batches(records, add, folder)
    return spark.read.schema(_with(records.schema, "epoch")).parquet(f"{folder}/table").drop("epoch")


def live_kpi(claims: DataFrame, now: Column, folder: str | None = None) -> DataFrame:
    """Key figures kept up to date by a stream, the median duration among them.

    Each micro-batch adds its figures to those before, and its durations to a table
    of how often each occurs; so the state is one row and as many as there are
    different durations, and a repeated batch writes the same version again.
    """
    spark = claims.sparkSession
    folder = folder or work_dir(spark, "kpi")

    def version(rows: DataFrame, name: str, epoch: int, add: Callable[[DataFrame], DataFrame]) -> None:
        if epoch >= 0:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{folder}/{name}/version={epoch - 1}"))
        add(rows).write.mode("overwrite").parquet(f"{folder}/{name}/version={epoch}")

    def durations(rows: DataFrame) -> DataFrame:
        return rows.groupBy("duration_ms").agg(F.sum("n").alias("n"))

    def save(batch: DataFrame, epoch: int) -> None:
        version(batch.agg(*kpi.kpi_columns(now)), "figures", epoch, kpi.merged_kpi)
        version(batch.select(F.col("duration_ms").cast("long").alias("duration_ms"), F.lit(1).cast("long").alias("n")), "durations", epoch, durations)

    # figures of no claims, so that a stream without a batch has some
    none = spark.createDataFrame([], claims.schema)
    save(none, -1)
    drain_batches(claims, save, folder)
    shape = _with(none.agg(*kpi.kpi_columns(now)).schema, "version")
    saved = spark.read.schema(shape).parquet(f"{folder}/figures")
    latest = saved.agg(F.max("version")).first()[0]
    counts = spark.read.schema("duration_ms long, n long").parquet(f"{folder}/durations/version={latest}")
    figures = saved.where(F.col("version") == latest).drop("version")
    return figures.withColumn("verification_p50_ms", kpi.counted_median(counts, "duration_ms", "n"))


# --- intake, late evidence, memory ---------------------------------------------

def verify_on_intake(
    intake: DataFrame,
    tables: ClaimTables | Callable[[], ClaimTables],
    folder: str | None = None,
    index: PhotoIndex | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Verify each micro-batch of new claims.

    ``tables`` may be a function; it is called for every micro-batch, so that
    files, memory and policies that came since are seen.  A batch that fails for
    want of disk, tables or executors is tried again, and if that does not help
    the stream stops with the error and later starts at this batch; no claim is
    to blame.  Any other batch that fails is halved, whatever its size, until the
    claims that fail stand alone; they are noted and the stream goes on.  Returns
    the runs and the claims that failed.

    With ``index`` the pictures of a batch are added to it first and then compared
    with it alone, so a batch does not go through the whole archive; pictures that
    are in it before the stream starts count as well.  Without it they are compared
    with all stored evidence.
    """
    spark = intake.sparkSession
    folder = folder or work_dir(spark, "intake")
    shape = RUNS
    failed_schema = T.StructType([T.StructField("claim_id", T.StringType()), T.StructField("error", T.StringType())])

    def attempt(part: DataFrame, epoch: int, name: str, retries: int = RETRIES) -> None:
        at = f"epoch={epoch}/part={name}"
        try:
            batch = (tables() if callable(tables) else tables).only(part)
            if index is not None:
                batch = replace(batch, index=index.until(epoch))
            verify_claims(batch).select(*shape.names).write.mode("overwrite").parquet(f"{folder}/runs/{at}")
        except Exception as error:  # noqa: BLE001 - intake must not stop for one claim
            if any(sign in f"{type(error).__name__}: {error}" for sign in ENVIRONMENT):
                if not retries:
                    raise
                attempt(part, epoch, name, retries - 1)
                return
            if part.select("id").distinct().limit(2).count() > 1:
                # other hash bits at each level, so that any two claims part
                side = F.pmod(F.xxhash64("id", F.lit(len(name))), F.lit(2))
                attempt(part.where(side == 0), epoch, name + "0")
                attempt(part.where(side == 1), epoch, name + "1")
                return
            note = f"{type(error).__name__}: {error}"[:500]
            rows = part.select(F.col("id").alias("claim_id"), F.lit(note).alias("error"))
            rows.write.mode("overwrite").parquet(f"{folder}/failed/{at}")

    def handle(batch: DataFrame, epoch: int) -> None:
        if index is not None:
            now = tables() if callable(tables) else tables
            index.append(neardup.photo_hashes(now.only(batch).evidence), epoch)
        attempt(batch, epoch, "b")

    # both folders exist from the start, so they can be read when empty
    spark.createDataFrame([], failed_schema).write.mode("overwrite").parquet(f"{folder}/failed/epoch=-1/part=b")
    spark.createDataFrame([], shape).write.mode("overwrite").parquet(f"{folder}/runs/epoch=-1/part=b")
    drain_batches(intake, handle, folder)
    runs = spark.read.schema(shape).parquet(f"{folder}/runs").select(*shape.names)
    failed = spark.read.schema(failed_schema).parquet(f"{folder}/failed").select(*failed_schema.names)
    return runs, failed


def late_evidence(files: DataFrame, claims: DataFrame | Callable[[], DataFrame], folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Late files: rows appended to the evidence table and one ADDENDUM record per
    claim and batch; the records' claims are to be verified again.  ``claims``
    may be a function that reads the claims anew for every micro-batch."""
    spark = files.sparkSession
    folder = folder or work_dir(spark, "addenda")

    def present() -> DataFrame:
        return claims() if callable(claims) else claims

    empty_rows, empty_records = maintain.addenda(present(), spark.createDataFrame([], files.schema))

    def handle(batch: DataFrame, epoch: int) -> None:
        rows, records = maintain.addenda(present(), batch)
        rows.write.mode("overwrite").parquet(f"{folder}/evidence/epoch={epoch}")
        records.write.mode("overwrite").parquet(f"{folder}/records/epoch={epoch}")

    drain_batches(files, handle, folder)
    rows = spark.read.schema(empty_rows.schema).parquet(f"{folder}/evidence")
    return rows, spark.read.schema(empty_records.schema).parquet(f"{folder}/records")


def memory_upkeep(
    labelled: DataFrame, vectors: DataFrame, start: DataFrame, source: str, folder: str | None = None
) -> DataFrame:
    """Enrol decided claims (claim_id, label, at) as they come.

    The memory is small by its cap, so each batch writes a whole new version
    from the one before; a repeated batch writes the same version again.
    """
    spark = labelled.sparkSession
    folder = folder or work_dir(spark, "memory")
    start.write.mode("overwrite").parquet(f"{folder}/version=-1")

    def handle(batch: DataFrame, epoch: int) -> None:
        before = spark.read.schema(start.schema).parquet(f"{folder}/version={epoch - 1}")
        # of several decisions on a claim in one batch the newest counts
        last = maintain.newest(batch.select("claim_id", "label", "at"), ["claim_id"], [F.col("at"), F.col("label")])
        new = M.enrol(last, vectors, source, F.lit(None)).drop("at").join(last.select("claim_id", "at"), "claim_id")
        M.upsert_memory(before, new.select(*start.columns)).write.mode("overwrite").parquet(f"{folder}/version={epoch}")

    drain_batches(labelled, handle, folder)
    return _latest_version(spark, folder, start)


def memory_history(
    labelled: DataFrame, vectors: DataFrame, start: DataFrame, source: str, folder: str | None = None,
    per_label: int = C.MEMORY_PER_LABEL,
) -> DataFrame:
    """The memory with the interval of every entry, kept as decisions come.

    Returns memory rows with n, since and until as ``vectors.with_intervals`` gives
    them; ``knn_votes`` takes them as they are and shows each run the memory of its
    time, replaced entries as well.  An entry ends when a newer decision on its
    claim comes or ``per_label`` newer ones of its label stand.  A micro-batch reads
    and writes only the entries that stand; those that ended are appended once.  In
    a micro-batch replacement comes first, then the cap; a decision that comes late
    counts from its time, but does not bring back what ended.
    """
    spark = labelled.sparkSession
    folder = folder or work_dir(spark, "memory-history")
    begun = with_intervals(start, per_label).select(*start.columns, "n", "since", "until")
    shape = begun.schema

    saved = T.StructType([*shape.fields, T.StructField("version", T.LongType()), T.StructField("ended", T.BooleanType())])

    def entries() -> DataFrame:
        return spark.read.schema(saved).parquet(f"{folder}/entries")

    def write(rows: DataFrame, epoch: int) -> None:
        rows = rows.select(*shape.names, F.col("until").isNotNull().alias("ended"))
        rows.write.partitionBy("ended").mode("overwrite").parquet(f"{folder}/entries/version={epoch}")

    def numbers(epoch: int) -> DataFrame:
        return spark.read.schema("label string, next long").parquet(f"{folder}/numbers/version={epoch}")

    def handle(batch: DataFrame, epoch: int) -> None:
        standing = entries().where(~F.col("ended") & (F.col("version") == epoch - 1)).select(*shape.names)
        last = maintain.newest(batch.select("claim_id", "label", "at"), ["claim_id"], [F.col("at"), F.col("label")])
        new = M.enrol(last, vectors, source, F.lit(None)).drop("at").join(last.select("claim_id", "at"), "claim_id")
        rows, nexts = M.advance_intervals(standing, new.select(*start.columns), numbers(epoch - 1), per_label)
        write(rows, epoch)
        nexts.write.mode("overwrite").parquet(f"{folder}/numbers/version={epoch}")

    write(begun, -1)
    begun.groupBy("label").agg((F.max("n") + 1).alias("next")).write.mode("overwrite").parquet(f"{folder}/numbers/version=-1")
    drain_batches(labelled, handle, folder)
    latest = entries().agg(F.max("version")).scalar()
    return entries().where(F.col("ended") | (F.col("version") == latest)).select(*shape.names)


def _latest_version(spark: SparkSession, folder: str, start: DataFrame) -> DataFrame:
    saved = (
        spark.read.schema(_with(start.schema, "version"))
        .option("basePath", folder)
        .parquet(f"{folder}/version=*")
    )
    latest = saved.agg(F.max("version")).scalar()
    return saved.where(F.col("version") == latest).drop("version")
