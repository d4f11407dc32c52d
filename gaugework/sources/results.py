"""Result tables of a stream: executions, failures and the log of batches.

Each attempt at a batch writes its outcomes in one go to a folder of its own,
``outcomes/batch_id=N/attempt=A``, split by ``failed``, and then adds a line to the log in
``batches/batch_id=N`` that names the attempt. That line is one file that appears at once. Of a
batch's lines the newest counts, and readers see the attempts that those name and no others:
a batch that is run again is read as it was until its new line is there, and as
it is then, never in part. Folders of attempts that no line counts for are removed by
:func:`remove_superseded`.

The lines of every ``fold`` batches are folded into one table with those before, ``folded/upto=N``, and
the log is read as the newest whole one of these and the lines after it. Only batches that
can't run again are folded, so a folded line never changes. What a fold has taken up
stays until the next one, for reads that began before.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework import schemas

OUTCOMES = (
    "variable_id bigint, tag_id bigint, result double, error string, "
    "result_on timestamp, window_end timestamp, processed_on timestamp, "
    "created_by string, is_deleted boolean"
)

#: Batches between two folds of the log.
FOLD = 64
#: Lines of one file of the folded log.
LINES_PER_FILE = 1_000_000

FOLDED = schemas.COUNTED + ", attempt string, batch_id bigint"


def read_if_present(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or no rows when nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_outcomes(outcomes: DataFrame, out_path: str, batch_id: int) -> str:
    """Outcomes of an attempt at a batch; the attempt's name, for its line of the log."""
    attempt = uuid.uuid4().hex
    outcomes.withColumn("failed", F.col("error").isNotNull()).write.partitionBy("failed").parquet(
        f"{out_path}/outcomes/batch_id={batch_id}/attempt={attempt}"
    )
    return attempt


def write_batch(
    spark: SparkSession,
    out_path: str,
    batch_id: int,
    attempt: str,
    *,
    last_processed_id: int,
    readings: int,
    as_of: int | None,
    updated_at: datetime | None = None,
    service_name: str = "gaugework",
    fold: int = FOLD,
) -> None:
    """The line of the log that commits a batch; ``as_of`` is in microseconds.

    Its outcomes are counted from the files just written, of which only the footers are read.
    Every ``fold`` batches, the lines before this one are folded.
    """
    path = f"{out_path}/outcomes/batch_id={batch_id}/attempt={attempt}"
    line = f"{out_path}/batches/batch_id={batch_id}"
    before = read_if_present(spark, line, schemas.LINE).agg(F.max("turn")).first()[0]
    written = read_if_present(spark, path, OUTCOMES + ", failed boolean").groupBy("failed").count()
    count = {row.failed: row["count"] for row in written.collect()}
    spark.range(1).select(
        F.lit(service_name).alias("service_name"),
        F.lit(last_processed_id).cast("long").alias("last_processed_id"),
        (F.current_timestamp() if updated_at is None else F.lit(updated_at)).alias("updated_at"),
        F.timestamp_micros(F.lit(as_of).cast("long")).alias("as_of"),
        F.lit(readings).cast("long").alias("readings"),
        F.lit(count.get(False, 0)).cast("long").alias("successes"),
        F.lit(count.get(True, 0)).cast("long").alias("failures"),
        F.lit(attempt).alias("attempt"),
        F.lit(0 if before is None else before + 1).alias("turn"),
    ).coalesce(1).write.mode("append").parquet(line)
    if batch_id > 0 and batch_id % fold == 0:
        fold_log(spark, out_path, batch_id - 1)


def folded_upto(spark: SparkSession, out_path: str) -> int:
    """The last batch of the newest whole table of folded lines, -1 without one."""
    folder = f"{out_path}/folded"
    whole = [upto for upto in _numbers(spark, folder, "upto") if exists(spark, f"{folder}/upto={upto}/_SUCCESS")]
    return max(whole, default=-1)


def fold_log(spark: SparkSession, out_path: str, upto: int) -> None:
    """Fold the lines of the batches up to ``upto``, none of which can run again.

    Lines and tables that the fold before has taken up are removed.
    """
    before = folded_upto(spark, out_path)
    if before >= upto:
        return
    lines = log_lines(spark, out_path).filter(F.col("batch_id") <= upto)
    files = upto // LINES_PER_FILE + 1
    lines = lines.coalesce(1) if files == 1 else lines.repartitionByRange(files, "batch_id")
    lines.write.mode("overwrite").parquet(f"{out_path}/folded/upto={upto}")
    for batch in _numbers(spark, f"{out_path}/batches", "batch_id"):
        if batch <= before:
            remove(spark, f"{out_path}/batches/batch_id={batch}")
    for old in _numbers(spark, f"{out_path}/folded", "upto"):
        if old < before:
            remove(spark, f"{out_path}/folded/upto={old}")


def log_lines(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest line of each committed batch, with the attempt it names."""
    upto = folded_upto(spark, out_path)
    lines = read_if_present(spark, f"{out_path}/batches", schemas.LINE + ", batch_id bigint")
    lines = lines.filter(F.col("batch_id") > upto)
    values = [name for name in lines.columns if name not in ("batch_id", "turn")]
    newest = lines.groupBy("batch_id").agg(F.max_by(F.struct(*values), "turn").alias("line"))
    newest = newest.select("line.*", "batch_id")
    if upto < 0:
        return newest
    return spark.read.schema(FOLDED).parquet(f"{out_path}/folded/upto={upto}").unionByName(newest)


def batches(spark: SparkSession, out_path: str) -> DataFrame:
    """One row per committed batch: counts, high-water mark and clock."""
    return log_lines(spark, out_path).drop("attempt")


def _outcomes(spark: SparkSession, out_path: str) -> DataFrame:
    return read_if_present(
        spark, f"{out_path}/outcomes", OUTCOMES + ", batch_id bigint, attempt string, failed boolean"
    )


def _committed(spark: SparkSession, out_path: str, since: int = 0) -> DataFrame:
    """Outcomes of the attempts that count, of batches from ``since`` on."""
    last = batches(spark, out_path).agg(F.max("batch_id")).first()[0]
    there = F.col("batch_id").between(since, F.lit(-1 if last is None else last))
    counted = log_lines(spark, out_path).filter(there).select("batch_id", "attempt")
    return _outcomes(spark, out_path).filter(there).join(counted, ["batch_id", "attempt"], "left_semi")


def fired_outcomes(spark: SparkSession, out_path: str) -> DataFrame:
    """(variable_id, window_end, result, error, batch_id) of every window of the committed batches."""
    windows = _committed(spark, out_path).filter(F.col("window_end").isNotNull())
    return windows.select("variable_id", "window_end", "result", "error", "batch_id")


def remove_superseded(spark: SparkSession, out_path: str) -> int:
    """Remove the folders of attempts that no line counts for; how many there were.

    Not while a batch runs, as its attempt has no line yet, nor while older reads go on.
    """
    counted = log_lines(spark, out_path).select("batch_id", "attempt")
    folders = _outcomes(spark, out_path).select("batch_id", "attempt").distinct()
    gone = folders.join(counted, ["batch_id", "attempt"], "left_anti").collect()
    for row in gone:
        remove(spark, f"{out_path}/outcomes/batch_id={row.batch_id}/attempt={row.attempt}")
    return len(gone)


def _on_store(spark: SparkSession, path: str):
    """A path and the file system that it is on."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    folder, store = _on_store(spark, path)
    store.delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _on_store(spark, path)
    return store.exists(place)


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers N of the folders ``name=N`` at ``path``."""
    folder, store = _on_store(spark, path)
    if not store.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in store.listStatus(folder)]
    return sorted(int(found.partition("=")[2]) for found in names if found.startswith(f"{name}="))


def executions(spark: SparkSession, out_path: str, since: int = 0) -> DataFrame:
    """Successful evaluations of all committed batches, from ``since`` on."""
    return _committed(spark, out_path, since).filter(~F.col("failed")).select(
        "variable_id",
        "tag_id",
        "result",
        "result_on",
        "processed_on",
        "window_end",
        "created_by",
        F.col("processed_on").alias("created_on"),
        "is_deleted",
        "batch_id",
    )


def newest_executions(spark: SparkSession, out_path: str, limit: int) -> DataFrame:
    """Successful evaluations of the newest batches that have ``limit`` of them together.

    All of a batch are created at one time, so these hold the newest ``limit`` of all. The log
    says which batches they are, and no other batch's files are listed in the plan.
    """
    log = batches(spark, out_path).filter("successes > 0").orderBy(F.col("batch_id").desc())
    first, total = 0, 0
    for row in log.select("batch_id", "successes").limit(limit).collect():
        first, total = row.batch_id, total + row.successes
        if total >= limit:
            break
    return executions(spark, out_path, first)


def as_failures(outcomes: DataFrame) -> DataFrame:
    """Failed outcomes in the form of the dead-letter table."""
    return outcomes.select(
        "tag_id",
        "variable_id",
        F.col("error").alias("error_message"),
        F.col("processed_on").alias("failed_at"),
        F.lit(0).alias("retry_count"),
        F.lit(False).alias("is_resolved"),
        *(["batch_id"] if "batch_id" in outcomes.columns else []),
    )


def failures(spark: SparkSession, out_path: str) -> DataFrame:
    """Failed evaluations of all committed batches."""
    return as_failures(_committed(spark, out_path).filter("failed"))


def service_stats(spark: SparkSession, out_path: str) -> DataFrame:
    """One row of totals, from the log alone: readings, batches, successful evaluations, and the times."""
    return batches(spark, out_path).agg(
        F.coalesce(F.sum("readings"), F.lit(0)).alias("total_tags_processed"),
        F.count(F.lit(1)).alias("batches_processed"),
        F.min("updated_at").alias("first_batch_at"),
        F.max("updated_at").alias("last_batch_at"),
        F.coalesce(F.sum("successes"), F.lit(0)).alias("total_formulas_executed"),
    )
