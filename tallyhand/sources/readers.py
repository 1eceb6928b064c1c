"""Sources. All schemas are explicit; malformed rows are kept apart, not dropped."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tallyhand.functions.numbers import decimal_comma
from tallyhand.schemas import COUNT_CUBE, HAND

# Names of files that hold summaries, not hands.
SUMMARY_NAMES = ["summary", "resumo", "- summary"]


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, bytes, content) of every ``.txt`` and ``.xml`` below ``root``.

    Spark's file sources leave out files of zero bytes.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{txt,xml,TXT,XML}")
        .load(root)
    )
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), "content"
    )


def ignored_files(spark: SparkSession, root: str) -> DataFrame:
    """One row: files below ``root`` with another extension (their content is not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return files.where(~F.lower("path").rlike(r"\.(txt|xml)$")).agg(F.count(F.lit(1)).alias("ignored"))


def decode(content: Column) -> Column:
    """struct(text, encoding, status): UTF-8 when valid, else Latin-1.

    ``status`` is ``empty``, ``invalid`` (more than 30% junk) or ``ok``. Latin-1 gives every
    byte a character, so junk is what no log has: replacement and control characters, and
    where bytes are no UTF-8 also the half of the upper bytes that are no letters.
    """
    utf8 = F.is_valid_utf8(content.cast("string"))
    text = F.when(utf8, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    odd = F.when(utf8, F.regexp_replace(text, r"[^\uFFFD\x00-\x08\x0E-\x1F\x7F]", "")).otherwise(
        F.regexp_replace(text, r"[^\x00-\x08\x0E-\x1F\x7F-\xBF]", "")
    )
    junk = F.length(odd)
    status = (
        F.when(F.length(text) == 0, "empty").when(junk > F.length(text) * 0.3, "invalid").otherwise("ok")
    )
    return F.struct(
        text.alias("text"), F.when(utf8, "utf-8").otherwise("latin-1").alias("encoding"), status.alias("status")
    )


def not_summary_file(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(True)
    for word in SUMMARY_NAMES:
        out = out & ~low.contains(word)
    return out


def hands_jsonl(spark: SparkSession, path: str, schema: T.StructType = HAND) -> DataFrame:
    """Hands, one JSON object per line; lines that do not parse keep their text in ``bad_line``."""
    with_bad = T.StructType([*schema.fields, T.StructField("bad_line", T.StringType())])
    return (
        spark.read.schema(with_bad)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "bad_line")
        .json(path)
    )


def stored_cubes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Stored cubes in the given order, with ``file_order`` for "last file wins"."""
    out = None
    for i, path in enumerate(paths):
        part = spark.read.schema(COUNT_CUBE).parquet(path).withColumn("file_order", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def room_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A room's CSV: its header and its first data row in file order, all cells as text (decimal commas, ``NA``).

    Of several files the first by name counts. Each task gives its first row.
    """
    sheet = spark.read.option("header", "true").csv(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return first_row(sheet.select(*[F.col(f"`{c}`") for c in sheet.columns], place.alias("_place")), "_place")


def first_row(rows: DataFrame, order: str) -> DataFrame:
    """The row that comes first by ``order``, without that column; none of an empty table."""
    kept = [c for c in rows.columns if c != order]
    first = rows.agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in kept]), F.col(order)).alias("_row"), F.count(F.lit(1)).alias("_n"))
    return first.where("_n > 0").select("_row.*")


def numeric_cells(sheet: DataFrame) -> DataFrame:
    return sheet.select(*[decimal_comma(F.col(f"`{c}`")).alias(c) for c in sheet.columns])
