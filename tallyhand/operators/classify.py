"""Hand records: class, table format, discard reason, identity."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhand.functions import handtext as ht
from tallyhand.functions import timecols, tourney
from tallyhand.functions.columns import count_true, let
from tallyhand.operators.records import fingerprint


def group_or_reason(text: Column, name: Column) -> Column:
    """struct(grp, discard_reason, tournament_type, table_format); exactly one of the first two is set.

    The checks run in a fixed order: cash game, mystery file, mystery text, fewer than
    four players, then the group.
    """
    given = tourney.class_from_text(F.concat(name, F.lit(" "), text))
    return let(given, lambda kind: let(ht.table_format(text), lambda size: _verdict(text, name, kind, size)))


def _verdict(text: Column, name: Column, kind: Column, size: Column) -> Column:
    reason = (
        F.when(ht.is_cash_game(text), "cash_game")
        .when(F.lower(name).contains("mystery") | (kind == "MYSTERIES"), "mystery")
        .when(size == "discard", "less_than_4_players")
        .when(~kind.isin("PKO", "NON-KO"), "other")
        .when((kind == "NON-KO") & ~size.isin("6-max", "9-max"), "invalid_format")
    )
    grp = F.when(kind == "PKO", "pko").when(size == "6-max", "nonko_6max").otherwise("nonko_9max")
    return let(
        reason,
        lambda why: F.struct(
            F.when(why.isNull(), grp).alias("grp"), why.alias("discard_reason"), kind.alias("tournament_type"), size.alias("table_format")
        ),
    )


def classify_hands(hands: DataFrame, text: str = "text", name: str = "file_id") -> DataFrame:
    """Add group or discard reason, id, timestamp and month to hand texts."""
    first_line = F.split(F.col(text), "\n", 2)
    stamp = F.coalesce(timecols.header_stamp(F.get(first_line, F.lit(0))), timecols.header_stamp(F.col(text)))
    verdict = hands.withColumn("_v", group_or_reason(F.col(text), F.col(name)))
    return verdict.select(
        *hands.columns,
        F.col("_v.grp").alias("grp"),
        F.col("_v.discard_reason").alias("discard_reason"),
        F.col("_v.tournament_type").alias("tournament_type"),
        F.col("_v.table_format").alias("table_format"),
        fingerprint(F.col(text)).alias("hand_id"),
        stamp.alias("stamp"),
        timecols.month_of(stamp).alias("month"),
    )


def class_totals(rows: DataFrame, cls: str) -> DataFrame:
    return rows.groupBy(cls).agg(F.count(F.lit(1)).alias("files"))


def manifest(files: DataFrame, text: str = "text", name: str = "name", network_rules: bool = True, encoding: str | None = None, chars: int | None = None) -> DataFrame:
    """Per file: class, reason, score, size and, where a column holds it, the encoding it was read in."""
    out = files.withColumn("_c", tourney.class_with_reason(F.col(text), F.col(name), network_rules, chars))
    return out.select(
        F.col(name).alias("input"),
        F.col("_c.class_name").alias("output_class"),
        F.col("_c.reason").alias("reason"),
        F.col("_c.score").alias("score"),
        F.octet_length(text).alias("bytes"),
        *([F.col(encoding).alias("encoding")] if encoding else []),
    )


def group_sample(records: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` records of each group in input order (a report, not a filter).

    The rank test sits right on the window, so each task keeps its own first ``n`` per
    group before the shuffle (WindowGroupLimit) and a hot group does not travel whole.
    """
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(*order))
    return records.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def file_totals(records: DataFrame, file_id: str = "file_id") -> DataFrame:
    """Per file: hands found, hands kept and their distribution over groups."""
    return records.groupBy(file_id).agg(
        F.count(F.lit(1)).alias("total_hands"),
        count_true(F.col("grp").isNotNull()).alias("classified_hands"),
        *[count_true(F.col("grp") == g).alias(g) for g in ("nonko_9max", "nonko_6max", "pko")],
    )
