"""Structured Streaming jobs (ST1, ST2).

ST1 scores only the rows it has not scored yet: a file-source stream joined to a
static table, written by a parquet sink with a checkpoint, run with
``trigger(availableNow=True)``. A re-run after an interruption resumes from the
checkpoint's offsets, and the sink's commit log keeps every batch exactly once. Rows that a producer
delivers again in other files are left out by key within a watermark (``without_replays``).

ST2 keeps the latest status and best-so-far value per property from a log stream
as a streaming aggregation (state in the checkpoint), published per micro-batch
with ``foreachBatch`` to a table that is overwritten atomically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def without_replays(stream: DataFrame, key: str | list[str], ts: str, delay: str) -> DataFrame:
    """ST1: the first row of every key; a row that is delivered again, in a file of any name, is left
    out. State is one entry a key whose time is within ``delay`` of the newest time seen and is
    dropped behind it, so it doesn't grow with the stream. ``delay`` must cover how late a first or a
    repeated delivery may be: rows behind the watermark count as replays. A row without a time has no
    place in it and may not be recognised when it comes again."""
    keys = [key] if isinstance(key, str) else list(key)
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def incremental_scoring(stream: DataFrame, static: DataFrame, on: str | list[str], score, out_path: str,
                        checkpoint: str, columns: list[str]) -> int:
    """ST1: stream-static join, score, append to parquet; returns the number of
    micro-batches run by this call (0 when everything was already scored)."""
    scored = stream.join(static, on, "left").withColumn("score", score).select(*columns, "score")
    q = (scored.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    n = len(q.recentProgress)
    return sum(1 for p in q.recentProgress if p.get("numInputRows", 0) > 0) if n else 0


def training_monitor(stream: DataFrame, group: str, ts: str, value: str, tiebreak: str, out_path: str,
                     checkpoint: str) -> None:
    """ST2: per property the number of log rows, the latest timestamp and value, and
    the best value so far; complete-mode state. Each batch writes a folder of its own, by its id, so
    a reader of ``latest_table`` sees the batch before until the new one is committed, and a batch
    that runs again replaces only itself. Folders older than the batch before are removed."""
    agg = stream.groupBy(F.col(group).alias("property")).agg(
        F.count(F.lit(1)).alias("n_events"), F.max(ts).alias("latest_ts"),
        F.max_by(value, F.struct(F.col(ts), F.col(tiebreak))).alias("latest_value"),
        F.max(value).alias("best_value"))

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        _remove_batches(batch.sparkSession, out_path, batch_id - 1)

    q = (agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
         .foreachBatch(publish).trigger(availableNow=True).start())
    q.awaitTermination()


def _batches(spark: SparkSession, out_path: str) -> dict[int, str]:
    """The committed batch folders by id, from the folder's listing; no file is opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "batch_id=*/_SUCCESS"))
    folders = [f.getPath().getParent() for f in found]
    return {int(f.getName().split("=")[1]): f.toString() for f in folders}


def _remove_batches(spark: SparkSession, out_path: str, before: int) -> None:
    """Removes the folders of batches with an id below ``before``. Callers pass an id at or below the
    batch that ran last before the current one: such a batch is committed and never runs again."""
    for number, folder in _batches(spark, out_path).items():
        if number < before:
            old = spark._jvm.org.apache.hadoop.fs.Path(folder)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def latest_table(spark: SparkSession, out_path: str) -> DataFrame:
    """The rows of the newest batch folder; no other folder is read."""
    batches = _batches(spark, out_path)
    if not batches:
        raise ValueError(f"no batch was published to {out_path}")
    return spark.read.parquet(batches[max(batches)])


#: Epochs behind the newest one that may still arrive or change; older ones are final.
LATENESS = 64
#: Every so many batches a batch folder holds the status of all properties.
COMPACT_EVERY = 10
STATE = ("done int, best_epoch int, best_val double, stop_epoch int, epochs_run long, last_epoch int, "
         "epochs array<int>, vals array<double>")


def _fold(status: tuple, pairs: list[tuple[int, float]], patience: int) -> tuple:
    """The patience rule over further epochs in order. Status: best epoch, best value, stop epoch,
    epochs run, newest epoch. Epochs behind the stop move the newest epoch only."""
    best_epoch, best, stop, run, last = status
    for e, v in pairs:
        last = e if last is None else max(last, e)
        if stop is not None:
            continue
        run += 1
        if best_epoch is None or v > best:
            best_epoch, best = e, v
        elif e - best_epoch >= patience:
            stop = e
    return best_epoch, best, stop, run, last


def _early_stop_fn(epoch: str, metric: str, patience: int, lateness: int):
    import pandas as pd

    def fn(key, batches, state):
        old = state.get if state.exists else (None, None, None, None, 0, None, [], [])
        done, status, held = old[0], tuple(old[1:6]), dict(zip(old[6], old[7]))
        for b in batches:
            for e, v in zip(b[epoch].astype(int).tolist(), b[metric].astype(float).tolist()):
                if done is None or e > done:
                    held[e] = v
        rows = sorted(held.items())
        now = _fold(status, rows, patience)  # what is known by now, with the epochs that may still change
        if rows:
            line = rows[-1][0] - lateness
            final = [p for p in rows if p[0] <= line]
            if final:
                status, done, rows = _fold(status, final, patience), final[-1][0], rows[len(final):]
        state.update((done, *status, [e for e, _ in rows], [v for _, v in rows]))
        yield pd.DataFrame({"property": [key[0]], "best_epoch": [now[0]], "best_val": [now[1]], "stop_epoch": [now[2]],
                            "epochs_run": [now[3]], "last_epoch": [now[4]]})

    return fn


def early_stop_monitor(stream: DataFrame, group: str, epoch: str, metric: str, patience: int,
                       out_path: str, checkpoint: str, lateness: int = LATENESS, compact_every: int = COMPACT_EVERY) -> None:
    """ST2 (stateful form): the patience rule of W6 kept incrementally per property with
    ``applyInPandasWithState``: best value and epoch (strict improvement), epochs run,
    and the epoch where early stopping fires (epochs after it are not counted).

    The state of a property is the rule's result over its final epochs and at most ``lateness`` epochs
    that may still change, so it doesn't grow with the run. Epochs may arrive in any order inside a
    batch, and up to ``lateness`` epochs behind the newest one of earlier batches (a repeated epoch
    replaces its value); an epoch at or behind the last final one counts as a replay and is left out.

    Each micro-batch writes its updated rows to a folder by its id; the latest row per property is the
    current status (``latest_status``). Every ``compact_every`` batches the folder holds all properties, and
    folders before the last such one are removed: its batch is committed, and a batch that runs
    again finds all that it reads."""
    out_schema = ("property string, best_epoch int, best_val double, stop_epoch int, epochs_run long, "
                  "last_epoch int")
    upd = stream.groupBy(group).applyInPandasWithState(
        _early_stop_fn(epoch, metric, patience, lateness), out_schema, STATE, "update", "NoTimeout")

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id % compact_every == compact_every - 1:
            older = {n: f for n, f in _batches(spark, out_path).items() if n < batch_id}
            if older:
                past = spark.read.option("basePath", out_path).schema(f"{out_schema}, batch_id long").parquet(*older.values())
                batch = _newest(past.unionByName(batch.withColumn("batch_id", F.lit(batch_id).cast("long"))))
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            _remove_batches(spark, out_path, batch_id - compact_every)

    q = (upd.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(publish).trigger(availableNow=True).start())
    q.awaitTermination()


def _newest(rows: DataFrame) -> DataFrame:
    cols = [c for c in rows.columns if c not in ("property", "batch_id")]
    latest = rows.groupBy("property").agg(F.max_by(F.struct(*cols), "batch_id").alias("s"))
    return latest.select("property", *[F.col(f"s.{c}").alias(c) for c in cols])


def latest_status(spark: SparkSession, out_path: str) -> DataFrame:
    """Current status per property: the row of the latest micro-batch."""
    return _newest(spark.read.parquet(out_path))
