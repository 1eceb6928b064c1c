"""Sinks. Output is partitioned by the columns readers filter on.

Before a partitioned write the rows are rebalanced by the partition columns: at run time
a partition holding a third of all rows is split over many tasks by its size, and a small
one does not leave a file per task.
"""

from pyspark.sql import DataFrame, functions as F

#: Rows of one file, at most.
FILE_ROWS = 5_000_000


def write_partitioned(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite", file_rows: int = FILE_ROWS, **options: str) -> None:
    """Parquet partitioned by ``keys``; further options go to the writer."""
    spread = df.hint("rebalance", *[F.col(k) for k in keys])
    spread.write.mode(mode).options(maxRecordsPerFile=file_rows, **options).partitionBy(*keys).parquet(path)


def write_enriched(enriched: DataFrame, path: str) -> None:
    """Enriched hands by month; ``month`` must be resolved."""
    write_partitioned(enriched, path, ["month"])


def write_hits(hits: DataFrame, path: str) -> None:
    """The id index, by month and group."""
    write_partitioned(hits, path, ["month", "grp"])


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "hand_id", buckets: int = 256) -> None:
    """A table by month, each month in buckets of ``key``: tables with as many buckets join on it without an exchange."""
    bucketed = df.withColumn("_bucket", F.pmod(F.hash(key), F.lit(buckets)))
    spread = bucketed.hint("rebalance", F.col("month"), F.col("_bucket")).drop("_bucket")
    spread.write.mode("overwrite").option("path", path).partitionBy("month").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def partition_summary(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("hands"))


def safe_name(col):
    """Group values as directory names: ``/``, ``\\`` and blanks become ``_``."""
    return F.regexp_replace(col, r"[/\\ ]", "_")


def write_by_group(df: DataFrame, key, path: str, name: str = "group_key") -> None:
    write_partitioned(df.withColumn(name, safe_name(key)), path, [name])


def write_by_fields(df: DataFrame, keys: dict, root: str) -> None:
    """One partitioned output for all fields, by field and value; ``keys`` maps a field name to its key Column.

    The rows are read once and each goes out once per field.
    """
    entries = F.array(*[F.struct(F.lit(field).alias("field"), safe_name(key).alias("group_key")) for field, key in keys.items()])
    write_partitioned(df.select("*", F.inline(entries)), root, ["field", "group_key"])


def write_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", "true").csv(path)


def write_history(rows: DataFrame, path: str, run: str) -> None:
    """The history rows of a run; written again, they replace those of the same run only."""
    kept = rows.withColumns({"percentage": F.col("percentage").cast("decimal(7,2)"), "run": F.lit(run)})
    write_partitioned(kept, path, ["run"], partitionOverwriteMode="dynamic")


def write_samples(ids: DataFrame, path: str) -> None:
    """The id lists of samples (``cube.sample_ids``), by name and month."""
    write_partitioned(ids, path, ["name", "month"])


def write_stat_texts(texts: DataFrame, path: str, stat: str = "stat_id", text: str = "text") -> None:
    """Hand texts per metric, separated by blank lines."""
    body = texts.select(safe_name(F.col(stat)).alias(stat), F.concat(F.trim(text), F.lit("\n")).alias("value"))
    # the writer ends each value with one more newline
    body.hint("rebalance", F.col(stat)).write.mode("overwrite").partitionBy(stat).text(path)


def compiled_text(files: DataFrame, cls: str, name: str, text: str) -> DataFrame:
    """(class, value): ``=== name ===`` and the content, one row per file.

    A class is one output directory; its files stay separate rows, so a class of any
    size is written in parallel.
    """
    value = F.concat(F.lit("=== "), F.col(name), F.lit(" ===\n"), F.col(text), F.lit("\n\n"))
    return files.where(F.length(text) > 0).select(F.col(cls).alias("class"), value.alias("value"))


def write_compiled(files: DataFrame, path: str, cls: str = "class", name: str = "name", text: str = "text") -> None:
    rows = compiled_text(files, cls, name, text)
    # the writer ends each value with a newline of its own
    rows = rows.withColumn("value", F.expr("substr(value, 1, length(value) - 1)"))
    rows.hint("rebalance", F.col("class")).write.mode("overwrite").partitionBy("class").text(path)
