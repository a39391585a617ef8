"""The same work on streams.

``downtime`` keeps state of its own per record; it travels to Python with the rows, in Arrow batches. The checkpoint folder must be one that all executors share.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAYS = (30, 60, 90)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where the driver and all executors can write: below the cluster's spark.checkpoint.dir; a temporary one only on a single machine that has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="streams-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote as a table; the folder keeps the checkpoint, so a later run goes on from there.

    Each batch is written to a folder of its own, replaced if the batch is run again.
    """
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/rows")


def state_rows(query) -> int:
    """How many rows of state a running or finished query holds, as its last progress says."""
    last = query.lastProgress
    return sum(op["numRowsTotal"] for op in last["stateOperators"]) if last else 0


#: No time yet; what is known of a record: its opening, its last resolve, and early resolves as "user:ms,...".
_NEVER = -(1 << 62)
_RECORD = "user_id long, started_ms long, resolved_ms long, early string"


def _pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per record: the opening waits for a resolve by its user, early resolves wait for the opening."""
    user, started, resolved, early = state.get if state.exists else (-1, _NEVER, _NEVER, "")
    waiting = {int(u): int(t) for u, t in (x.split(":") for x in early.split(",") if x)}
    known = started != _NEVER
    for frame in frames:
        for who, at, resolves in zip(frame["user_id"].tolist(), frame["at_ms"].tolist(), frame["resolves"].tolist(), strict=True):
            if resolves:
                waiting[who] = max(at, waiting.get(who, at))
            elif not known and (started == _NEVER or at < started):
                user, started = who, at
    before = resolved
    if started != _NEVER:
        resolved, waiting = max(resolved, waiting.get(user, _NEVER)), {}
    state.update((user, started, resolved, ",".join(f"{u}:{t}" for u, t in waiting.items())))
    if resolved > before:
        yield pd.DataFrame({"record_id": [key[0]], "user_id": [user], "started_ms": [started], "resolved_ms": [resolved]})


def downtime(opens: DataFrame, resolves: DataFrame) -> DataFrame:
    """record_id, user_id, started_at, resolved_at, downtime_minutes (half up) for each resolve by the record's own user.

    An open record stays in the state until its resolve arrives, whatever the delay, and a
    resolve until its opening arrives. A later resolve of the same record gives a new row, which
    replaces the earlier one (``latest_downtime``). Resolves by others change nothing. The
    state is a small row a record (``state_rows`` says how many); it has no time-out, since one
    would lose late resolves or corrections. Nulls in record, user or time
    can't be paired and are left out.
    """
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp")).alias("at_ms")
    one = opens.select("record_id", F.col("user_id").cast("long"), ms("started_at"), F.lit(False).alias("resolves"))
    two = resolves.select("record_id", F.col("user_id").cast("long"), ms("resolved_at"), F.lit(True).alias("resolves"))
    kind = dict(opens.dtypes)["record_id"]
    events = one.unionByName(two).dropna()
    paired = events.groupBy("record_id").applyInPandasWithState(_pair, f"record_id {kind}, user_id long, started_ms long, resolved_ms long", _RECORD, "update", GroupStateTimeout.NoTimeout)
    minutes = F.floor((F.col("resolved_ms") - F.col("started_ms")) / 60000 + 0.5).cast("long")
    return paired.select("record_id", "user_id", F.timestamp_millis("started_ms").alias("started_at"), F.timestamp_millis("resolved_ms").alias("resolved_at"), minutes.alias("downtime_minutes"))


def latest_downtime(rows: DataFrame) -> DataFrame:
    """The last row of each record."""
    return rows.groupBy("record_id").agg(*(F.max_by(c, "resolved_at").alias(c) for c in ("user_id", "started_at", "resolved_at", "downtime_minutes")))


def daily_panes(occurrences: DataFrame, late: str = "1 day") -> DataFrame:
    """ata_code, day, n: the faults of each closed day, once, in append mode.

    The state is one row a system and open day. A day is closed when the watermark (the latest
    fault less ``late``) passes its end; faults that come later than that are left out.
    """
    at = F.col("occurrence_date").cast("timestamp")
    panes = occurrences.withColumn("occurrence_date", at).withWatermark("occurrence_date", late).groupBy(F.window("occurrence_date", "1 day"), "ata_code").agg(F.count("*").alias("n"))
    return panes.select("ata_code", F.to_date("window.start").alias("day"), "n")


def recurrence(panes: DataFrame, days: tuple[int, ...] = DAYS) -> DataFrame:
    """ata_code, day, n30, n60, n90: for each day of a system with a fault, the faults of the days up to and including it.

    All lengths are sums of the same daily panes, so an event is counted once, not once for
    each window that it falls in, and the window holds a row a day. Panes are a table or a stream's output.
    """
    number = F.unix_date("day")
    span = lambda d: Window.partitionBy("ata_code").orderBy(number).rangeBetween(1 - d, 0)
    return panes.select("ata_code", "day", *(F.sum("n").over(span(d)).alias(f"n{d}") for d in days))


def ingest(files: DataFrame, path: str, checkpoint: str):
    """Adds each batch's new documents to the store; the checkpoint resumes where the last run stopped, and a batch that is run again writes nothing."""
    from maintspark.sources.tables import append_new

    def write(batch: DataFrame, number: int) -> None:
        # numbers of batches start anew with another checkpoint
        append_new(batch.sparkSession, batch, path, f"{uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex}-{number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
