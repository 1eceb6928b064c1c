"""Consistency checks. Each returns the rows that disagree, or one row of counters."""

from pyspark.sql import DataFrame, functions as F

from tallyhand.functions.columns import count_true
from tallyhand.operators.cube import DISCARD_REASONS
from tallyhand.operators.records import ids_in_many


def count_differences(expected: DataFrame, actual: DataFrame, keys: list[str], value: str = "hands") -> DataFrame:
    """Full outer comparison of two count tables; equal rows are left out."""
    e = expected.select(*keys, F.col(value).alias("expected"))
    a = actual.select(*keys, F.col(value).alias("actual"))
    both = e.join(a, keys, "full_outer").select(
        *keys, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")
    )
    return both.where(F.col("expected") != F.col("actual"))


def validate_partitions(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Recount the rows and compare with the stored counts."""
    return count_differences(stored, rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("hands")), keys)


def monthly_against_global(monthly: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of monthly counters next to the global ones, where they differ."""
    total = monthly.groupBy(*keys).agg(
        F.sum("opportunities").alias("opportunities_sum"), F.sum("attempts").alias("attempts_sum")
    )
    both = whole.select(*keys, "opportunities", "attempts").join(total, keys, "full_outer")
    for c in ("opportunities", "attempts", "opportunities_sum", "attempts_sum"):
        both = both.withColumn(c, F.coalesce(c, F.lit(0)))
    return both.where(
        (F.col("opportunities") != F.col("opportunities_sum")) | (F.col("attempts") != F.col("attempts_sum"))
    )


def month_id_report(monthly_ids: DataFrame, global_ids: DataFrame) -> DataFrame:
    """Ids counted in several months, ids the global set lacks, distinct ids on both sides: one shuffle by id."""
    m, g = F.lit(1), F.lit(0)
    sides = monthly_ids.select("hand_id", "month", m.alias("_m"), g.alias("_g")).unionByName(
        global_ids.select("hand_id", F.lit(None).cast("string").alias("month"), g.alias("_m"), m.alias("_g"))
    )
    ids = sides.groupBy("hand_id").agg(
        F.max("_m").alias("_m"), F.max("_g").alias("_g"), (F.min("month") != F.max("month")).alias("_many")
    )
    counts = ids.agg(
        count_true(F.col("_many")).alias("duplicate_ids"),
        count_true((F.col("_m") == 1) & (F.col("_g") == 0)).alias("extra_ids"),
        F.coalesce(F.sum("_m"), F.lit(0)).cast("bigint").alias("monthly_ids"),
        F.coalesce(F.sum("_g"), F.lit(0)).cast("bigint").alias("global_ids"),
    )
    return _as_rows(counts, "check", "ids")


def _as_rows(counts: DataFrame, name: str, value: str) -> DataFrame:
    """One row of counters as (name, value) rows."""
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in counts.columns])))


def expectation_differences(counters: DataFrame, expected: DataFrame) -> DataFrame:
    """Counters (name, value) that differ from the expectation table."""
    return count_differences(expected, counters, ["name"], "value")


def class_conflicts(records: DataFrame, key: str = "hand_id", cls: str = "grp") -> DataFrame:
    """Hands filed under more than one class."""
    return ids_in_many(records.where(F.col(cls).isNotNull()), key, cls)


def sums_within_total(records: DataFrame) -> DataFrame:
    """Class sums and month sums next to the total number of valid hands, from one scan."""
    grp, month = F.col("grp"), F.col("month")
    counts = records.groupingSets([[], [grp], [month]], grp, month).agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("_set") == 3, "total").when(F.col("_set") == 1, "classes").otherwise("months")
    return counts.groupBy(name.alias("sum_over")).agg(F.sum("n").alias("hands"))


def context_report(facts: DataFrame) -> DataFrame:
    """Counters of enriched hands whose facts do not fit together."""
    seen = F.col("saw_flop") & (F.coalesce("hero", F.lit("")) != "")
    return facts.agg(
        F.count(F.lit(1)).alias("hands"),
        count_true(F.coalesce("hero", F.lit("")) == "").alias("no_hero"),
        count_true(seen & F.col("hero_ip_flop").isNull()).alias("no_position_on_flop"),
        count_true(seen & (F.col("players_to_flop") == 2) & ~F.col("heads_up_flop")).alias("two_players_not_heads_up"),
        count_true(seen & (F.col("pot_type") == "SRP") & F.col("eff_stack_srp").isNull()).alias("no_stack_in_srp"),
    )


def unexplained(totals: DataFrame) -> DataFrame:
    """Sources whose valid and discarded hands do not add up to the total."""
    known = sum((F.col(r) for r in DISCARD_REASONS), F.col("valid_hands"))
    return totals.withColumn("residual", F.col("total_hands") - known).where(F.col("residual") != 0)
