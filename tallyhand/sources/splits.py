"""Large text files read by byte range: what crosses the border of two ranges is put together again.

Spark's text source cuts a file into ranges and gives each line to one of them. Lines keep the
range they came from (``block``) and their order in it (``at``), so places in a file are running
sums over one row a range, and only lines before a range's first header travel to the range
that owns them. No step holds a file.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from tallyhand.functions import handtext as ht
from tallyhand.schemas import HAND

_HEADER = "(?i)^\\s*(?:" + "|".join(ht.HEADERS) + ")"


def text_lines(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, block, at, line) for every line of every file below ``root``, bytes as they are.

    The order of a file's lines is that of (block, at); ``at`` grows by one from line to line
    of a range. A file is as many tasks as it has ranges. ``pattern`` selects file names.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(root).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )


def _earlier(name: str, of: Column) -> Column:
    """What a file's earlier ranges hold; a window over one row a range."""
    return of.over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias(name)


def with_line_numbers(some: DataFrame, lines: DataFrame) -> DataFrame:
    """``some`` of the rows of ``lines``, with ``line_number`` (from 1) in their file.

    Ranges are counted with map-side sums, and the counts of earlier ranges added up.
    """
    counts = lines.groupBy("path", "block").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = counts.select("path", "block", "_first", F.coalesce(_earlier("_", F.sum("_n")), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("at") - F.col("_first") + 1
    return some.join(starts, ["path", "block"]).withColumn("line_number", number).drop("_first", "_before")


def hands_jsonl_lines(spark: SparkSession, root: str, schema: T.StructType = HAND) -> DataFrame:
    """Hands, one JSON object a line, with their place (path, block, at); ``bad_line`` keeps lines that do not parse.

    Blank lines are no hands. (path, block, at) is the order of input that first-wins
    deduplication and the carrying of months need.
    """
    with_bad = T.StructType([*schema.fields, T.StructField("bad_line", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"}
    lines = text_lines(spark, root).where(~F.col("line").rlike(r"^\s*$"))
    return lines.select("path", "block", "at", F.from_json("line", with_bad, options).alias("_h")).select("path", "block", "at", "_h.*")


def bad_lines(spark: SparkSession, root: str, schema: T.StructType = HAND) -> DataFrame:
    """(path, line_number, bad_line) of the lines that do not parse; only they are joined with the counts."""
    bad = hands_jsonl_lines(spark, root, schema).where("bad_line IS NOT NULL").select("path", "block", "at", "bad_line")
    return with_line_numbers(bad, text_lines(spark, root)).select("path", "line_number", "bad_line")


def hand_pieces(lines: DataFrame) -> DataFrame:
    """(path, block, piece, encoding, text): the text from each header line that follows a blank line up to the next.

    The range in which a piece begins owns it; ``piece`` counts them in the range, and 0 is what
    comes before a file's first header. Lines before a range's first header go to the last
    range before that owns a piece. Bytes that are no UTF-8 anywhere in a file make all of it
    Latin-1. A text moves once, and a second time only if it crosses a border; a piece is one
    row, as a hand is.
    """
    inside = Window.partitionBy("path", "block").orderBy("at")
    marked = lines.withColumns({
        "_blank": F.col("line").rlike(r"^\s*$"), "_opens": F.col("line").rlike(_HEADER), "_utf8": F.is_valid_utf8("line"),
    })
    after_blank = F.coalesce(F.lag("_blank").over(inside), F.lit(False)) & F.col("_opens")
    counted = marked.withColumn("_begins", after_blank.cast("long")).withColumn("_nth", F.sum("_begins").over(inside))

    # a range in one row: found by partial aggregates, without the lines' text
    at_end = F.max_by("_blank", "at").alias("last_blank")
    ranges = counted.groupBy("path", "block").agg(F.min_by("_opens", "at").alias("first_opens"), at_end, F.sum("_begins").alias("n"), F.bool_and("_utf8").alias("utf8"))
    file = Window.partitionBy("path")
    ordered = file.orderBy("block")
    ranges = ranges.select(
        "path", "block", "n",
        (F.col("first_opens") & F.coalesce(F.lag("last_blank").over(ordered), F.lit(False))).cast("long").alias("first"),
        F.min("block").over(file).alias("begin"),
        F.min(F.col("utf8").cast("int")).over(file).alias("utf8"),
    ).withColumn("total", F.col("n") + F.col("first"))
    owner = _earlier("owner", F.last(F.when(F.col("total") > 0, F.col("block")), ignorenulls=True))
    ranges = ranges.select("path", "block", "first", "total", "begin", "utf8", F.coalesce(owner, F.col("begin")).alias("owner"))

    placed = counted.join(ranges, ["path", "block"]).withColumn("piece", F.col("_nth") + F.col("first"))
    raw = F.when(F.col("utf8") == 1, F.col("line")).otherwise(F.decode(F.col("line").cast("binary"), "ISO-8859-1"))
    placed = placed.withColumn("line", raw)
    own = (F.col("piece") > 0) | (F.col("block") == F.col("begin"))
    joined = lambda by, held: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, "line"))), lambda x: x["line"]), "\n").alias(held)
    pieces = placed.where(own).groupBy("path", "block", "piece", "total", "utf8").agg(joined(["at"], "text"))
    heads = placed.where(~own).groupBy("path", F.col("owner").alias("block")).agg(joined(["block", "at"], "_more"))
    whole = pieces.join(heads, ["path", "block"], "left")
    goes_on = (F.col("piece") == F.col("total")) & F.col("_more").isNotNull()
    return whole.select(
        "path", "block", "piece", F.when(F.col("utf8") == 1, "utf-8").otherwise("latin-1").alias("encoding"),
        F.when(goes_on, F.concat("text", F.lit("\n"), "_more")).otherwise(F.col("text")).alias("text"),
    )
