"""New hands merged into stored totals, duplicates ignored."""

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyhand.functions import timecols
from tallyhand.operators.derive import derive_facts
from tallyhand.operators.records import fingerprint
from tallyhand.plans.catalogue import catalogue
from tallyhand.plans.opportunities import count_hands, with_month_and_groups
from tallyhand.schemas import HAND

_IDS = "hand_id string, run string, batch bigint, day string"
#: Where ids of hands without a time are kept.
NO_DAY = "unknown"


def state_root(spark: SparkSession, name: str, fallback: str) -> str:
    """Where a query keeps its progress: under the cluster's shared checkpoint folder.

    ``fallback`` is only for sessions without that setting, as in tests.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{(shared or fallback).rstrip('/')}/{name}"


def hand_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """JSON hands as they appear in a directory."""
    return spark.readStream.schema(HAND).option("maxFilesPerTrigger", max_files).json(path)


def with_identity(hands: DataFrame, text: str | None = None) -> DataFrame:
    """Add ``hand_id`` and the event time.

    The id is the fingerprint of the hand's text where a column holds it, else of all that
    was played; the file a hand came in is no part of it, so a second upload gets the same id.
    """
    played = F.to_json(F.struct("site", "tournament_id", "timestamp_utc", "button_seat", "hero", "players", "streets"))
    return hands.withColumn("hand_id", fingerprint(F.col(text) if text else played)).withColumn(
        "event_time", timecols.parse_stamp(F.col("timestamp_utc"))
    )


def live_counts(hands: DataFrame, metrics: list[dict] | None = None) -> DataFrame:
    """The running cube of a hand stream (``update`` or ``complete`` mode)."""
    return count_hands(with_month_and_groups(derive_facts(hands)), metrics or catalogue())


def merge_counts(
    counter: Callable[[DataFrame], DataFrame], cube_path: str, ids_path: str, run: str | None = None
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: count unseen hands and add them to the stored cube.

    Hands are unseen if no stored id is theirs, however old they are. Equal ids were played at
    one time, so ids are kept by day, and a batch reads those of the days it has hands of:
    what it reads does not grow with the history of other days. Every batch writes its
    ids and its delta under its run and number; a batch that is run again overwrites exactly
    those folders, so a retry after a lost executor or driver neither loses nor doubles a
    count. ``run`` is by default the id that the query's checkpoint holds: a lost checkpoint
    begins a new run beside the stored ones, and the ids keep it from counting twice. Readers
    add the deltas up (``read_counts``).
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = run or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        fresh = batch.dropDuplicates(["hand_id"])
        seen = _read_if_any(spark, ids_path, _IDS)
        if seen is not None:
            # no more days than the calendar has
            days = [r[0] for r in batch.select(_day(batch).alias("day")).distinct().collect()]
            earlier = (F.col("run") != name) | (F.col("batch") < batch_id)
            old = seen.where(F.col("day").isin(days) & earlier).select("hand_id")
            fresh = fresh.join(old, "hand_id", "left_anti")
        fresh.persist()  # read once for the counts and once for the ids
        counter(fresh).write.mode("overwrite").parquet(f"{cube_path}/run={name}/batch={batch_id}")
        _write_ids(fresh.select("hand_id", _day(batch).alias("day")), f"{ids_path}/run={name}/batch={batch_id}")
        fresh.unpersist()

    return add


def _day(hands: DataFrame) -> Column:
    """The UTC day of a hand's time, where there is one."""
    if "event_time" not in hands.columns:
        return F.lit(NO_DAY)
    return F.coalesce(F.date_format("event_time", "yyyy-MM-dd"), F.lit(NO_DAY))


def _write_ids(ids: DataFrame, path: str) -> None:
    ids.hint("rebalance", F.col("day")).write.mode("overwrite").partitionBy("day").parquet(path)


def _read_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def compact_ids(spark: SparkSession, ids_path: str, target: str) -> None:
    """All stored ids in few files, as one run before any other; to be used as ``ids_path`` from then on."""
    seen = spark.read.schema(_IDS).parquet(ids_path).select("hand_id", "day").distinct()
    _write_ids(seen, f"{target}/run=compacted/batch=0")


def read_counts(spark: SparkSession, cube_path: str) -> DataFrame:
    """The stored cube: all deltas added up."""
    rows = spark.read.parquet(cube_path)
    return rows.groupBy("month", "grp", "stat_id").agg(
        F.sum("opportunities").alias("opportunities"), F.sum("attempts").alias("attempts")
    )


def compact_counts(spark: SparkSession, cube_path: str, target: str, months: list[str] | None = None) -> None:
    """Rewrite the summed cube by month; with ``months`` only those partitions are replaced, else all."""
    cube = read_counts(spark, cube_path)
    if months is not None:
        cube = cube.where(F.col("month").isin(months))
    (
        cube.write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if months is None else "dynamic")
        .partitionBy("month")
        .parquet(target)
    )


def run_incremental(
    spark: SparkSession, source: str, cube_path: str, ids_path: str, checkpoint: str, metrics: list[dict] | None = None
) -> StreamingQuery:
    """Process everything that is new, once, and stop."""
    metrics = metrics or catalogue()
    counter = lambda df: count_hands(with_month_and_groups(derive_facts(df)), metrics)
    # one progress folder per source, metrics and target: none of them reuses another's offsets
    named = "\n".join([source, cube_path, ids_path, *sorted(str(m) for m in metrics)])
    name = f"incremental_counts_{hashlib.sha1(named.encode()).hexdigest()[:12]}"
    return (
        with_identity(hand_stream(spark, source))
        .writeStream.foreachBatch(merge_counts(counter, cube_path, ids_path))
        .option("checkpointLocation", state_root(spark, name, checkpoint))
        .trigger(availableNow=True)
        .start()
    )
