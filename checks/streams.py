"""Round trips: what sinks and the incremental job store, read back and compared."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import counts, facts, tables
from tallyhand.operators import cube as cubes
from tallyhand.plans import catalogue
from tallyhand.sources import readers, sinks
from tallyhand.streaming import incremental

QUERIES, ORACLES = {}, {}
METRICS = catalogue.catalogue()


def query(name, sql):
    def keep(fn):
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn

    return keep


def folder(spark: SparkSession) -> str:
    """A new folder where the session keeps shared files: a local one only where all tasks are local too."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        local = spark.sparkContext.master.split("[")[0] == "local"
        shared = "file://" + tempfile.mkdtemp(prefix="tallyhand-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/round-trip-{uuid.uuid4().hex}"


def _uploads(spark: SparkSession, sf_dir: str, root: str) -> list[DataFrame]:
    """Two uploads: every second hand, then all hands in files of other names."""
    tables.hands(spark, sf_dir).write.parquet(f"{root}/hands")
    hands = spark.read.parquet(f"{root}/hands")
    return [hands.where("h % 2 = 0").drop("h"), hands.withColumn("file_id", F.concat(F.lit("copy/"), "file_id")).drop("h")]


@query("stream_counts", facts.ORACLES["literal_catalogue_counts"])
def stream_counts(spark, sf_dir):
    """Counted as the uploads arrive; every second hand arrives twice and counts once."""
    root = folder(spark)
    for upload in _uploads(spark, sf_dir, root):
        upload.write.mode("append").json(f"{root}/source")
        incremental.run_incremental(spark, f"{root}/source", f"{root}/cube", f"{root}/ids", f"{root}/progress", METRICS).awaitTermination()
    return incremental.read_counts(spark, f"{root}/cube")


@query("stream_lost_checkpoint", facts.ORACLES["literal_catalogue_counts"])
def stream_lost_checkpoint(spark, sf_dir):
    """The second upload is counted by a query that has lost its progress and starts over."""
    root = folder(spark)
    add = lambda run: incremental.merge_counts(lambda df: facts_of(df), f"{root}/cube", f"{root}/ids", run)
    first, second = (incremental.with_identity(u) for u in _uploads(spark, sf_dir, root))
    add("one")(first, 0)
    add("two")(first.unionByName(second), 0)
    add("two")(second, 1)
    add("two")(second, 1)
    return incremental.read_counts(spark, f"{root}/cube")


def facts_of(hands: DataFrame) -> DataFrame:
    from tallyhand.operators.derive import derive_facts
    from tallyhand.plans.opportunities import count_hands, with_month_and_groups

    return count_hands(with_month_and_groups(derive_facts(hands)), METRICS)


@query("hits_round_trip", f"SELECT month, grp, stat_id, kind, count(*) AS hands FROM ({facts.ORACLES['stat_hits']}) GROUP BY ALL")
def hits_round_trip(spark, sf_dir):
    """The id index, written by month and group."""
    path = f"{folder(spark)}/hits"
    sinks.write_hits(facts.stat_hits(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("month", "grp", "stat_id", "kind").agg(F.count("*").alias("hands"))


@query(
    "history_round_trip",
    f"SELECT level, month, source, table_format, stat_id, opportunities, attempts, CAST(percentage AS DOUBLE) AS percentage, 'run-1' AS run FROM ({counts.ORACLES['opp_att_grouping_sets']})",
)
def history_round_trip(spark, sf_dir):
    """History rows of a run that was written twice."""
    path = f"{folder(spark)}/history"
    rows = cubes.history_rows(counts.sourced_cube(spark, sf_dir).withColumnRenamed("grp", "table_format"))
    for _ in range(2):
        sinks.write_history(rows, path, "run-1")
    return spark.read.parquet(path).withColumn("percentage", F.col("percentage").cast("double"))


@query("jsonl_round_trip", f"{facts.duck.BASE} SELECT site, count(*) AS hands FROM hd GROUP BY site")
def jsonl_round_trip(spark, sf_dir):
    """Hands as JSON lines, read with the explicit schema; no line is malformed."""
    path = f"{folder(spark)}/hands"
    tables.hands(spark, sf_dir).drop("h").write.json(path)
    return readers.hands_jsonl(spark, path).where("bad_line IS NULL").groupBy("site").agg(F.count("*").alias("hands"))
