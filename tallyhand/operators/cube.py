"""Aggregations over the count cube and over hand records."""

from pyspark.sql import Column, DataFrame, functions as F

from tallyhand.functions import timecols
from tallyhand.functions.columns import count_true, ratio_pct
from tallyhand.functions.scoring import action_ratio, performance_ratio


def add_up(cube: DataFrame, keys: list[str], sources: str | None = None) -> DataFrame:
    """Sum counters per key; with ``sources`` also the sorted set of contributing sources."""
    aggs = [F.sum("opportunities").alias("opportunities"), F.sum("attempts").alias("attempts")]
    if sources:
        aggs.append(F.array_sort(F.collect_set(sources)).alias("sources"))
    return cube.groupBy(*keys).agg(*aggs)


def combine_groups(cube: DataFrame, members: list[str], name: str) -> DataFrame:
    """Cube rows of several groups added into one group."""
    return (
        add_up(cube.where(F.col("grp").isin(members)), ["month", "stat_id"])
        .select("month", F.lit(name).alias("grp"), "stat_id", "opportunities", "attempts")
    )


def counts_with_totals(rows: DataFrame, detail: list[str], total: list[str], count: str = "hands") -> DataFrame:
    """One table with the detail counts and the totals; ``level`` tells which, a NULL key may be either."""
    return rows.groupingSets([[F.col(c) for c in detail], [F.col(c) for c in total]], *[F.col(c) for c in detail]).agg(
        _level(), F.count(F.lit(1)).alias(count)
    )


def _level() -> Column:
    return F.when(F.grouping_id() == 0, "detail").otherwise("total").alias("level")


def history_rows(cube: DataFrame) -> DataFrame:
    """Rows per (month, source, format, stat) and per (format, stat); ``level`` tells which."""
    keys = ["month", "source", "table_format", "stat_id"]
    sets = [[F.col(k) for k in keys], [F.col("table_format"), F.col("stat_id")]]
    out = cube.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        _level(), F.sum("opportunities").alias("opportunities"), F.sum("attempts").alias("attempts")
    )
    return out.withColumn("percentage", ratio_pct(F.col("attempts"), F.col("opportunities")))


# The two metrics that are ratios, not percentages.
WIN_RATING, RIVER_AGGRESSION = "W$WSF Rating", "River Agg %"


def merge_sources(cube: DataFrame, keys: list[str]) -> DataFrame:
    """Add counters over sources and give each metric its own kind of value.

    Needs ``player_sum`` (players at the flop, summed) for the win rating.
    """
    merged = cube.groupBy(*keys).agg(
        F.sum("opportunities").alias("opportunities"),
        F.sum("attempts").alias("attempts"),
        F.sum("player_sum").alias("player_sum"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
    opp, att = F.col("opportunities"), F.col("attempts")
    value = (
        F.when(F.col("stat_id") == WIN_RATING, performance_ratio(att, opp, F.coalesce("player_sum", F.lit(0))))
        .when(F.col("stat_id") == RIVER_AGGRESSION, action_ratio(att, opp))
        .otherwise(ratio_pct(att, opp))
    )
    return merged.withColumn("percentage", value)


def vpip_from_parts(cube: DataFrame, keys: list[str], prefixes: list[str]) -> DataFrame:
    """``X VPIP`` rows from ``X 3bet`` and ``X Cold Call``: most opportunities, all attempts."""
    parts = cube.where(F.col("stat_id").isin([f"{p} {part}" for p in prefixes for part in ("3bet", "Cold Call")]))
    return (
        parts.withColumn("stat_id", F.concat(F.regexp_extract("stat_id", r"^(\S+) ", 1), F.lit(" VPIP")))
        .groupBy(*keys, "stat_id")
        .agg(F.max("opportunities").alias("opportunities"), F.sum("attempts").alias("attempts"))
    )


def distinct_hands(hits: DataFrame, postflop_stats: list[str]) -> DataFrame:
    """Exact distinct hands per group, over all metrics and over the post-flop ones.

    Duplicates are removed by key before counting, so a group holding most of the
    rows is spread over all tasks and each group then sums small partial counts.
    """
    once = hits.groupBy("grp", "hand_id").agg(
        F.max(F.when(F.col("stat_id").isin(postflop_stats), 1).otherwise(0)).alias("post")
    )
    return once.groupBy("grp").agg(
        F.count(F.lit(1)).alias("hand_count"), F.sum("post").cast("bigint").alias("postflop_hands_count")
    )


def distinct_counted(rows: DataFrame) -> DataFrame:
    """``distinct_hands`` from ``opportunities.counted_hands``: a few rows a hand in the place of one for each metric."""
    once = rows.groupBy("grp", "hand_id").agg(F.max(F.col("marked").cast("int")).alias("post"))
    return once.groupBy("grp").agg(
        F.count(F.lit(1)).alias("hand_count"), F.sum("post").cast("bigint").alias("postflop_hands_count")
    )


def keyword_stats(cube: DataFrame, keywords: list[str]) -> DataFrame:
    """Rows whose metric name contains any keyword, whatever the case."""
    name = F.lower("stat_id")
    cond = F.lit(False)
    for word in keywords:
        cond = cond | name.contains(word.lower())
    return cube.where(cond)


def across_groups(cube: DataFrame, keywords: list[str]) -> DataFrame:
    """Metrics whose name contains a keyword (case counts), added over all groups."""
    cond = F.lit(False)
    for word in keywords:
        cond = cond | F.col("stat_id").contains(word)
    return add_up(cube.where(cond), ["stat_id"])


def derive_telemetry(facts: DataFrame) -> DataFrame:
    """Distribution counters and means over enriched hands, one row.

    Zero and missing stacks do not enter the means.
    """

    def mean(col: str) -> Column:
        return F.coalesce(F.round(F.avg(F.when(F.col(col) != 0, F.col(col))), 2), F.lit(0.0)).alias(f"average_{col}")

    return facts.agg(
        F.count(F.lit(1)).alias("hands_processed"),
        *[count_true(F.col("hero_pos_group") == b).alias(f"position_{b.lower()}") for b in ("EP", "MP", "LP")],
        *[count_true(F.col("pot_type") == p).alias(f"pot_{p.lower()}") for p in ("SRP", "3bet", "4bet", "none")],
        F.round(count_true(F.col("heads_up_flop")) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 2).alias(
            "heads_up_percentage"
        ),
        mean("eff_stack_srp"),
        mean("eff_stack_vs_3bet"),
    )


# Discard reasons every report lists, in order of the checks.
DISCARD_REASONS = [
    "mystery", "less_than_4_players", "tournament_summary", "cash_game", "invalid_format", "other",
]


def discard_rollup(counts: DataFrame, supplied_total: DataFrame | None = None) -> DataFrame:
    """(reason, hands): every tracked reason, extra reasons, and ``total``.

    Hands without a reason count as ``other``.
    When the caller's total disagrees with the sum, the difference goes to ``other``.
    """
    spark = counts.sparkSession
    tracked = spark.createDataFrame([(r,) for r in DISCARD_REASONS], "reason string")
    named = counts.withColumn("reason", F.coalesce("reason", F.lit("other")))
    given = named.where(F.col("reason") != "total").groupBy("reason").agg(F.sum("hands").alias("hands"))
    rows = tracked.join(given, "reason", "full_outer").select("reason", F.coalesce("hands", F.lit(0)).alias("hands"))
    if supplied_total is not None:
        both = rows.select("hands", F.lit(0).cast("bigint").alias("supplied")).unionAll(
            supplied_total.select(F.lit(0).cast("bigint"), F.col("hands").cast("bigint"))
        )
        gap = both.agg(F.sum("hands").alias("found"), F.sum("supplied").alias("supplied")).select(
            F.lit("other").alias("reason"),
            F.when(F.col("supplied") != 0, F.col("supplied") - F.col("found")).otherwise(F.lit(0)).alias("gap"),
        )
        rows = rows.join(gap, "reason", "left").select("reason", (F.col("hands") + F.coalesce("gap", F.lit(0))).alias("hands"))
    sums = rows.groupingSets([[F.col("reason")], []], F.col("reason")).agg(F.sum("hands").cast("bigint").alias("hands"))
    return sums.withColumn("reason", F.coalesce("reason", F.lit("total")))


def source_totals(records: DataFrame, source: str = "source") -> DataFrame:
    """Per source: valid, total, every discard reason, and what is left unexplained."""
    reason = F.col("discard_reason")
    out = records.groupBy(source).agg(
        F.count(F.lit(1)).alias("total_hands"),
        count_true(reason.isNull()).alias("valid_hands"),
        *[count_true(reason == r).alias(r) for r in DISCARD_REASONS],
    )
    known = sum((F.col(r) for r in DISCARD_REASONS), F.col("valid_hands"))
    return out.withColumn("residual", F.col("total_hands") - known)


# How metric names spell positions and streets.
POSITION_MARKS = {
    "EP": ["EP", "UTG", "UTG1", "UTG2"],
    "MP": ["MP", "MP1", "MP2", "LJ"],
    "CO": ["CO", "HJ"],
    "BTN": ["BTN", "BU"],
    "BLINDS": ["SB", "BB"],
}
STREET_MARKS = ["FLOP", "TURN", "RIVER"]


def name_parts(stat: Column) -> dict[str, Column]:
    """Position, street and IP/OOP side read from a metric name."""
    up = F.upper(stat)
    position = None
    for label, marks in POSITION_MARKS.items():
        cond = up.rlike(f"_(?:{'|'.join(marks)})(?:_|$)")
        position = F.when(cond, label) if position is None else position.when(cond, label)
    street = None
    for mark in STREET_MARKS:
        cond = up.contains(f"_{mark}")
        street = F.when(cond, mark) if street is None else street.when(cond, mark)
    # names without a separator still carry their street when they are c-bets
    for mark in STREET_MARKS:
        street = street.when(position.isNull() & up.contains("CBET") & up.contains(mark), mark)
    side = F.when(up.contains("_IP") & ~up.contains("_SKIP"), "IP").when(up.contains("_OOP"), "OOP")
    return {"position": position, "street": street, "side": side}


def breakdown(cube: DataFrame, family_prefix: str) -> DataFrame:
    """Counts of a family by position, by street and by both (``level`` tells which)."""
    rows = cube.where(F.col("stat_id").startswith(family_prefix))
    rows = rows.withColumns({k: v for k, v in name_parts(F.col("stat_id")).items() if k != "side"})
    p, s = F.col("position"), F.col("street")
    out = rows.groupingSets([[p], [s], [p, s]], p, s).agg(
        F.grouping_id().alias("gid"),
        F.sum("opportunities").alias("opportunities"),
        F.sum("attempts").alias("attempts"),
        F.count(F.lit(1)).alias("stats"),
    )
    level = F.when(F.col("gid") == 1, "position").when(F.col("gid") == 2, "street").otherwise("both")
    return (
        out.select(level.alias("level"), "position", "street", "opportunities", "attempts", "stats")
        .where(
            ((F.col("level") == "position") & p.isNotNull())
            | ((F.col("level") == "street") & s.isNotNull())
            | (p.isNotNull() & s.isNotNull())
        )
        .withColumn("percentage", ratio_pct(F.col("attempts"), F.col("opportunities")))
    )


def months_manifest(records: DataFrame) -> DataFrame:
    """Files, valid and total hands per month and source and per month; ``level`` tells which."""
    per_file = records.groupBy("month", "source", "file_id").agg(
        F.count(F.lit(1)).alias("total"), count_true(F.col("discard_reason").isNull()).alias("valid")
    )
    m, s = F.col("month"), F.col("source")
    return per_file.groupingSets([[m, s], [m]], m, s).agg(
        _level(), F.count(F.lit(1)).alias("files"), F.sum("valid").alias("valid_hands"), F.sum("total").alias("total_hands")
    )


def hands_per_month(records: DataFrame, stamp: str | None = None, month: str = "month", missing: str | None = None) -> DataFrame:
    """(month, hands): a hand's month is that of its stamp, else the one it carries; without either it is left out or ``missing``."""
    given = timecols.month_key(F.col(month))
    key = F.coalesce(timecols.month_of(timecols.parse_stamp(F.col(stamp).cast("string"))), given) if stamp else given
    key = F.coalesce(key, F.lit(missing)) if missing else key
    return records.select(key.alias("month")).where(F.col("month").isNotNull()).groupBy("month").agg(F.count(F.lit(1)).alias("hands"))


def sample_ids(records: DataFrame) -> DataFrame:
    """(name, month, source, hand_id): the hands behind each number of ``global_samples``, each once.

    A valid hand is in its group, in ``group:postflop_all`` and in ``total``; a discarded one in
    its reason and in ``total``. The lists are rows, to be written by name (``sinks.write_samples``).
    """
    valid = F.col("discard_reason").isNull()
    own = F.when(valid, F.concat(F.lit("group:"), F.coalesce("grp", F.lit("")))).otherwise(F.concat(F.lit("discard:"), F.col("discard_reason")))
    names = F.array_compact(F.array(own, F.when(valid, F.lit("group:postflop_all")), F.lit("total")))
    return records.select(F.explode(names).alias("name"), "month", "source", "hand_id").dropDuplicates(["name", "hand_id"])


def manifest_rollup(hits: DataFrame) -> DataFrame:
    """Per source and per group: metrics with data and hand entries."""
    s, g = F.col("source"), F.col("grp")
    per_stat = hits.groupBy("source", "grp", "stat_id").agg(F.count(F.lit(1)).alias("hands"))
    by_source = per_stat.groupBy("source").agg(
        F.countDistinct("stat_id").alias("stats"), F.sum("hands").alias("hands")
    ).select(F.lit("source").alias("level"), s.alias("key"), "stats", "hands")
    by_group = per_stat.groupBy("grp").agg(
        F.countDistinct("stat_id").alias("stats"), F.sum("hands").alias("hands")
    ).select(F.lit("group").alias("level"), g.alias("key"), "stats", "hands")
    return by_source.unionByName(by_group)


def global_samples(records: DataFrame) -> DataFrame:
    """Totals per group, the all-hands sample and the discards, as (name, hands) rows.

    Records with a NULL ``discard_reason`` are valid and belong to one group.
    """
    group = F.when(F.col("discard_reason").isNull(), F.concat(F.lit("group:"), F.coalesce("grp", F.lit(""))))
    named = records.select(F.coalesce(group, F.concat(F.lit("discard:"), F.col("discard_reason"))).alias("name"))
    per_name = named.groupBy("name").agg(F.count(F.lit(1)).alias("hands"))
    totals = per_name.agg(
        F.sum(F.when(F.col("name").startswith("group:"), F.col("hands")).otherwise(0)).cast("bigint").alias("valid"),
        F.sum("hands").cast("bigint").alias("total"),
    )
    extra = totals.select(
        F.inline(
            F.array(
                F.struct(F.lit("group:postflop_all").alias("name"), F.coalesce("valid", F.lit(0)).alias("hands")),
                F.struct(F.lit("total").alias("name"), F.coalesce("total", F.lit(0)).alias("hands")),
            )
        )
    )
    return per_name.unionByName(extra)
