"""From room files to totals, samples and counters: texts are read once, and every segment is accounted for."""

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, functions as F

from tallyhand.functions import handtext as ht
from tallyhand.functions.columns import count_true
from tallyhand.operators import classify, cube as cubes, segments
from tallyhand.plans.counters import count_text_hands
from tallyhand.sources.sinks import write_partitioned


class Rooms(NamedTuple):
    """What a job stored and what follows from it; all but ``records`` are aggregates of a few of its columns."""

    records: DataFrame
    totals: DataFrame
    samples: DataFrame
    sample_ids: DataFrame
    months: DataFrame
    counters: DataFrame
    parsed: int


def segment_records(files: DataFrame, file_id: str = "file_id", text: str = "text", source: str = "source") -> DataFrame:
    """(file_id, source, segment, grp, discard_reason, tournament_type, table_format, hand_id, month, text): one row a segment.

    Segments are the hands of a file and its tournament summaries. What the splitter drops is
    a record too: a summary with the reason ``tournament_summary``, a hand that lacks the
    essentials with ``other``; so nothing that was parsed is missing from the totals.
    """
    body = F.col(text)
    hands = F.transform(segments.hands_of(body), lambda h, i: F.struct(i.alias("segment"), h["text"].alias("text"), F.when(~h["valid"], "other").alias("dropped")))
    ends = F.transform(F.filter(segments.blocks(body), lambda b: ht.is_summary(b)), lambda b, i: F.struct((-1 - i).alias("segment"), b.alias("text"), F.lit("tournament_summary").alias("dropped")))
    rows = files.select(F.col(file_id).alias("file_id"), F.col(source).alias("source"), F.inline(F.concat(hands, ends)))
    judged = classify.classify_hands(rows, "text", "file_id")
    reason = F.coalesce("dropped", "discard_reason", F.when(F.col("grp").isNull(), "other"))
    return judged.select(
        "file_id", "source", "segment", F.when(reason.isNull(), F.col("grp")).alias("grp"), reason.alias("discard_reason"),
        "tournament_type", "table_format", "hand_id", F.coalesce("month", F.lit("unknown")).alias("month"), "text",
    )


def run_rooms(files: DataFrame, root: str, **columns: str) -> Rooms:
    """Cut, classify and store the files' segments by month, and derive all reports from what was stored.

    The one pass over the texts counts what it parsed, kept and discarded while it writes; the
    stored records must account for the same numbers, or the job fails. Counters read the
    texts of valid records only.
    """
    spark = files.sparkSession
    seen = Observation("rooms")
    valid = F.col("discard_reason").isNull()
    records = segment_records(files, **columns).observe(
        seen, F.count(F.lit(1)).alias("parsed"), count_true(valid).alias("valid"), count_true(~valid).alias("discarded")
    )
    write_partitioned(records, f"{root}/records", ["month"])
    stored = spark.read.schema(records.schema).parquet(f"{root}/records")
    found = seen.get
    held = stored.agg(F.count(F.lit(1)).alias("parsed"), count_true(valid).alias("valid"), count_true(~valid).alias("discarded")).first().asDict()
    if {**found} != held or held["parsed"] != held["valid"] + held["discarded"]:
        raise ValueError(f"parsed {found}, stored {held}")
    return Rooms(
        records=stored,
        totals=cubes.source_totals(stored),
        samples=cubes.global_samples(stored),
        sample_ids=cubes.sample_ids(stored),
        months=cubes.hands_per_month(stored.where(valid), missing="unknown"),
        counters=count_text_hands(stored.where(valid).select("month", "grp", "text"), ["month", "grp"]),
        parsed=held["parsed"],
    )
