"""Month-ordered operators over the count cube.

Windows here are keyed by (group, metric): a partition holds one row per month, so
it stays small even when the hands behind the counts do not. Month keys sort as
text; ``unknown`` sorts last.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhand.functions.columns import ratio_pct, steady_round, weighted_mean

# Weights of the newest 1, 2 or 3 months, newest first.
DECAY = {1: [1.0], 2: [0.5, 0.5], 3: [0.5, 0.3, 0.2]}
MAIN_DECAY = {1: [1.0], 2: [0.7, 0.3], 3: [0.5, 0.3, 0.2]}


def month_order(month: Column) -> Column:
    return F.when(month == "unknown", F.lit("9999-99")).otherwise(month)


def newest_first(month: Column) -> list[Column]:
    """Sort keys: known months descending, ``unknown`` last."""
    return [(month == "unknown").asc(), month.desc()]


def decay_weight(rank: Column, months: Column, table: dict[int, list[float]] = DECAY) -> Column:
    """Weight of the month at ``rank`` (1 = newest) when ``months`` are in use."""
    most = max(table)
    used = F.least(months, F.lit(most)).cast("int")
    weights = F.try_element_at(
        F.create_map(*[c for n, w in table.items() for c in (F.lit(n), F.array(*map(F.lit, w)))]), used
    )
    return F.get(weights, rank - 1)


def usable_months(
    cube: DataFrame, keys: list[str], min_opportunities: int = 10, keep: int = 3, table: dict = DECAY
) -> DataFrame:
    """The newest ``keep`` months per key with enough opportunities, ranked and weighted."""
    ranked = (
        cube.where(F.col("opportunities") >= min_opportunities)
        .withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first(F.col("month")))))
        .where(F.col("rank") <= keep)
    )
    months = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return ranked.withColumn("months_used", months).withColumn(
        "weight", decay_weight(F.col("rank"), F.col("months_used"), table)
    )


def decayed_mean(weighted: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Weighted mean of each value column over the usable months (0.0 when none)."""
    return weighted.groupBy(*keys).agg(
        *[F.coalesce(weighted_mean(F.col(v), F.col("weight")), F.lit(0.0)).alias(v) for v in values],
        F.max("months_used").cast("int").alias("months_used"),
    )


def ranked_months(cube: DataFrame, unknown_is_newest: bool = False, by: list[str] | None = None) -> DataFrame:
    """(month, rank, of) over the distinct months of a frame or of each ``by``, rank 1 = newest.

    The month keys are combined map-side into one short sorted array, so no row but
    the keys themselves travels. ``unknown`` ranks last unless asked otherwise.
    """
    keys = F.collect_set("month")  # leaves NULL out
    known = F.sort_array(F.filter(keys, lambda m: m != "unknown"), asc=False)
    rest = F.filter(keys, lambda m: m == "unknown")
    ordered = F.concat(rest, known) if unknown_is_newest else F.concat(known, rest)
    listed = cube.groupBy(*(by or [])).agg(ordered.alias("keys"))
    return listed.select(*(by or []), F.posexplode("keys").alias("rank", "month"), F.size("keys").alias("of")).select(
        *(by or []), "month", (F.col("rank") + 1).alias("rank"), "of"
    )


def joined_by(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what was found for their keys; a NULL key is a key like others."""
    named = found.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(named, same).drop(*[f"_{k}" for k in keys])


def with_month_rank(rows: DataFrame, by: list[str] | None = None, unknown_is_newest: bool = False) -> DataFrame:
    """Add ``rank`` (1 = newest) and ``of``: the place of a row's month among all months of its user.

    ``by`` names what has months of its own: a user, a source; without it the whole frame does.
    Rows without a month are left out. The distinct months of each user are one array from
    map-side sets, ranked inside its row and joined back; no window runs over cube rows.
    """
    return joined_by(rows, ranked_months(rows, unknown_is_newest, by), [*(by or []), "month"])


def weigh_months(
    rows: DataFrame, selected: str | None = None, table: dict[int, list[float]] = DECAY, by: list[str] | None = None
) -> DataFrame:
    """The rows of the selected month and of those before it that the table weighs, with ``rank`` and ``weight``.

    ``selected=None`` starts from each user's newest month; ``unknown`` sorts after all months.
    """
    pool = rows if selected is None else rows.where(
        month_order(F.col("month")) <= ("9999-99" if selected == "unknown" else selected)
    )
    ranked = with_month_rank(pool, by, unknown_is_newest=True).where(F.col("rank") <= max(table))
    return ranked.withColumn("weight", decay_weight(F.col("rank"), F.col("of"), table)).drop("of")


def weighted_rate(cube: DataFrame, keys: list[str], table: dict = DECAY, by: list[str] | None = None) -> DataFrame:
    """sum(att*w)/sum(opp*w) over as many of a user's newest months as the table has weights for."""
    rows = with_month_rank(cube, by).where(F.col("rank") <= max(table))
    rows = rows.withColumn("weight", decay_weight(F.col("rank"), F.col("of"), table))
    att, opp = F.sum(F.col("attempts") * F.col("weight")), F.sum(F.col("opportunities") * F.col("weight"))
    return rows.groupBy(*(by or []), *keys).agg(
        F.when(opp > 0, att / opp * 100.0).alias("pct"),
        F.floor(F.round(att, 8)).cast("bigint").alias("attempts"),
        F.floor(F.round(opp, 8)).cast("bigint").alias("opportunities"),
    )


def blend_months(weighted: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Weighted mean of monthly scores (``weigh_months``); weights are rescaled to the months that have a score."""
    return weighted.groupBy(*keys).agg(
        weighted_mean(F.col(value), F.col("weight")).alias(value), F.count(value).alias("months_used")
    )


def last_months(cube: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """Rows of a user's newest ``n`` months, with ``rank`` and ``of``."""
    return with_month_rank(cube, by, unknown_is_newest=True).where(F.col("rank") <= n)


def ramp_series(cube: DataFrame, n: int, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Series of a user's last ``n`` months with a weight that grows by month, plus the series totals."""
    keys = [*(by or []), *keys]
    rows = last_months(cube, n, by).withColumn("of", F.least("of", F.lit(n)))
    per_key = Window.partitionBy(*keys)
    opp, att = F.sum("opportunities").over(per_key), F.sum("attempts").over(per_key)
    return (
        rows.withColumn("ramp", F.round((F.col("of") - F.col("rank") + 1) / F.col("of"), 2))
        .withColumn("percentage", ratio_pct(F.col("attempts"), F.col("opportunities")))
        .withColumns(
            {"total_opportunities": opp, "total_attempts": att, "average_percentage": ratio_pct(att, opp)}
        )
        .select(
            *keys, "month", "opportunities", "attempts", "percentage", "ramp",
            "total_opportunities", "total_attempts", "average_percentage",
        )
    )


def trend(cube: DataFrame, n: int, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """First half of a user's last ``n`` months against the rest; keys with one month are dropped."""
    keys = [*(by or []), *keys]
    w = Window.partitionBy(*keys)
    rows = (
        last_months(cube, n, by)
        .withColumn("percentage", ratio_pct(F.col("attempts"), F.col("opportunities")))
        .withColumn("pos", F.row_number().over(w.orderBy("month")))
        .withColumn("of", F.count(F.lit(1)).over(w))
        .where(F.col("of") >= 2)
        .withColumn("first_half", F.col("pos") <= F.floor(F.col("of") / 2))
    )
    halves = rows.groupBy(*keys).agg(
        F.max("of").alias("months_analyzed"),
        F.avg(F.when(F.col("first_half"), F.col("percentage"))).alias("a"),
        F.avg(F.when(~F.col("first_half"), F.col("percentage"))).alias("b"),
        F.max_by("percentage", "month").alias("latest_value"),
        F.max("percentage").alias("peak_value"),
        F.min("percentage").alias("valley_value"),
    )
    change = F.col("b") - F.col("a")
    label = (
        F.when(F.abs(change) < 1.0, "stable")
        .when(change > 5.0, "improving")
        .when(change > 0, "slightly_improving")
        .when(change < -5.0, "declining")
        .otherwise("slightly_declining")
    )
    return halves.select(
        *keys, "months_analyzed", label.alias("trend"),
        steady_round(F.col("a"), 2).alias("first_period_avg"),
        steady_round(F.col("b"), 2).alias("second_period_avg"),
        steady_round(change, 2).alias("absolute_change"),
        F.when(F.col("a") != 0, steady_round(change / F.col("a") * 100.0, 2)).otherwise(F.lit(0.0)).alias("rate_of_change"),
        "latest_value", "peak_value", "valley_value",
    )


def carry_month_forward(
    rows: DataFrame, file: str, pos: str, month: str = "month", chunk: int = 100_000
) -> DataFrame:
    """Fill a missing month with the last resolved one of the same file, in file order.

    The order column must be unique within a file. A file is cut into chunks of
    consecutive positions: a chunk carries within itself, and only one row per chunk
    takes part in the carry between chunks, so one huge file never becomes one task.
    A row without a file or a position has no row before it and keeps the month it has.
    """
    known = F.col(file).isNotNull() & F.col(pos).isNotNull()
    # rows without a place are spread by what they have, so they do not gather in one task
    place = F.when(known, F.floor(F.col(pos) / chunk)).otherwise(-1 - F.pmod(F.xxhash64(file, pos, month), F.lit(1024)))
    cut = rows.withColumn("_chunk", place)
    tails = cut.where(known).groupBy(file, "_chunk").agg(
        F.max_by(month, F.when(F.col(month).isNotNull(), F.col(pos))).alias("_tail")
    )
    before = Window.partitionBy(file).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = tails.select(file, "_chunk", F.last("_tail", ignorenulls=True).over(before).alias("_head"))
    inside = Window.partitionBy(file, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = cut.withColumn("_seen", F.when(known, F.last(month, ignorenulls=True).over(inside)))
    return (
        carried.join(heads, [file, "_chunk"], "left")
        .withColumn(month, F.coalesce(month, "_seen", "_head"))
        .select(*rows.columns)
    )
