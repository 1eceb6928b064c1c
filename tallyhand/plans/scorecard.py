"""Scorecards: metric -> subgroup -> group -> overall.

Every step works on the count cube or on something smaller. Targets and weights
come in as DataFrames keyed by (grp, stat_id); the joins carry no hints, so the
optimizer broadcasts a side only when its size says so.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyhand.functions import scoring
from tallyhand.functions.columns import lookup, ratio_pct, steady_round, weighted_mean
from tallyhand.operators.months import DECAY, decayed_mean, usable_months
from tallyhand.plans import targets


def ideals_frame(spark: SparkSession, rows: list[tuple[str, str, float]] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or targets.catalogue_ideals(), "stat_id string, grp string, ideal double")


def stat_weights_frame(spark: SparkSession, table: dict[str, dict[str, float]] | None = None, mode: str = "off") -> DataFrame:
    rows = [
        (sub, stat, float(w))
        for sub, stats in (table or targets.STAT_WEIGHTS).items()
        for stat, w in targets.normalise_weights(stats, mode).items()
    ]
    return spark.createDataFrame(rows, "subgroup string, stat_id string, weight double")


def weights_frame(spark: SparkSession, key: str, table: dict[str, float], mode: str = "off") -> DataFrame:
    rows = [(k, float(v)) for k, v in targets.normalise_weights(table, mode).items()]
    return spark.createDataFrame(rows, f"{key} string, {key}_weight double")


def stat_level(
    cube: DataFrame,
    ideals: DataFrame,
    combined: dict[str, list[str]] | None = None,
    min_opportunities: int = targets.MIN_OPPORTUNITIES_MONTH,
    step: dict | None = None,
    scorer: str = "step",
    decay: dict = DECAY,
) -> DataFrame:
    """Time-decayed percentage and score per (grp, stat_id), also for combined groups.

    Single groups enter with percentages rounded to two places, as stored in the
    cube's reports; combined groups are computed from the summed counts. A group
    without an ideal of its own takes the combined group's, a combined group its first
    member's; a metric with an ideal for nobody relevant scores 100.
    """
    combined = targets.COMBINED if combined is None else combined
    opp, att = F.col("opportunities"), F.col("attempts")
    # a row counts for its own group and for those it is a member of, in one pass over the cube
    labels = F.array(
        F.struct(F.col("grp").alias("label"), F.lit(False).alias("_summed")),
        *[F.when(F.col("grp").isin(members), F.struct(F.lit(name).alias("label"), F.lit(True).alias("_summed"))) for name, members in combined.items()],
    )
    rows = (
        cube.select("month", "stat_id", "opportunities", "attempts", F.inline(F.array_compact(labels)))
        .groupBy("month", F.col("label").alias("grp"), "stat_id", "_summed")
        .agg(F.sum("opportunities").alias("opportunities"), F.sum("attempts").alias("attempts"))
        .withColumn("pct", F.when(~F.col("_summed"), ratio_pct(att, opp)).when(opp > 0, att / opp * 100.0).otherwise(F.lit(0.0)))
        .drop("_summed")
    )
    ranked = usable_months(rows, ["grp", "stat_id"], min_opportunities, table=decay)

    # one row of ideals per metric, so fallbacks are plain coalesces
    entries = ideals.groupBy("stat_id", "grp").agg(F.first("ideal").alias("ideal"))
    per_stat = entries.groupBy("stat_id").agg(F.map_from_entries(F.collect_list(F.struct("grp", "ideal"))).alias("by_grp"))
    of = lambda grp: F.try_element_at("by_grp", F.lit(grp))
    backup: Column = F.coalesce(*[of(name) for name in combined], F.lit(None).cast("double"))
    for name, members in combined.items():
        backup = F.when(F.col("grp") == name, of(members[0])).otherwise(backup)
    chain = F.coalesce(F.try_element_at("by_grp", F.col("grp")), backup)
    scored = (
        ranked.join(per_stat, "stat_id")
        .withColumn("ideal", F.coalesce(chain, F.col("pct")))
        .withColumn("score", scoring.SCORERS[scorer](F.col("pct"), F.col("ideal"), **(step or targets.STEP)))
    )
    out = decayed_mean(scored, ["grp", "stat_id"], ["pct", "score"])
    return out.select(
        "grp", "stat_id", steady_round(F.col("pct"), 2).alias("pct_time_decay"), steady_round(F.col("score"), 2).alias("score_time_decay"), "months_used"
    )


def explained(stats: DataFrame, ranges: DataFrame) -> DataFrame:
    """The metrics of ``stat_level`` with the grade and the note that their ideal range (stat_id, low, high) gives them."""
    pct, low, high = F.col("pct_time_decay"), F.col("low"), F.col("high")
    joined = stats.join(ranges.select("stat_id", "low", "high"), "stat_id", "left")
    return joined.withColumns({"grade": scoring.range_grade(pct, low, high), "note": scoring.range_text(pct, low, high)}).drop("low", "high")


def subgroup_level(stats: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of the metrics of a subgroup that have a score."""
    return (
        stats.join(weights.where(F.col("weight") > 0), "stat_id")
        .groupBy("subgroup", "grp")
        .agg(steady_round(weighted_mean(F.col("score_time_decay"), F.col("weight")), 2).alias("score"))
    )


def group_level(subgroups: DataFrame, weights: DataFrame, rescale: bool = False) -> DataFrame:
    """Subgroup scores times their weights; ``rescale`` divides by the weights present."""
    part = F.sum(F.col("score") * F.col("subgroup_weight"))
    total = part / F.sum("subgroup_weight") if rescale else part
    return subgroups.join(weights, "subgroup").groupBy("grp").agg(steady_round(total, 2).alias("score"))


def overall(groups: DataFrame, weights: DataFrame, missing: str = "zero") -> DataFrame:
    """One score. ``missing="zero"`` counts an absent group as 0, ``"skip"`` leaves it out."""
    if missing not in ("zero", "skip"):
        raise ValueError(missing)
    rows = weights.where(F.col("grp_weight") > 0).join(groups, "grp", "left")
    present = F.col("score").isNotNull() | F.lit(missing == "zero")
    top = F.sum(F.coalesce("score", F.lit(0.0)) * F.col("grp_weight"))
    bottom = F.sum(F.when(present, F.col("grp_weight")))
    # no score at all gives no overall
    return rows.agg(F.when(F.count("score") > 0, steady_round(top / bottom, 2)).alias("overall"))


def rescaled(weights: DataFrame, level: list[str], weight: str = "weight") -> DataFrame:
    """Weights divided by their sum within each level (a level that sums to 0 is kept)."""
    total = F.sum(weight).over(Window.partitionBy(*level))
    return weights.withColumn(weight, F.when(total != 0, F.col(weight) / total).otherwise(F.col(weight)))


def tier_scores(cube: DataFrame, goals: DataFrame) -> DataFrame:
    """Tier score with deviation, trend and confidence for metrics with a target.

    ``goals``: grp, stat_id, ideal, down_pct, up_pct (and weight).
    """
    pct = F.col("attempts") / F.col("opportunities") * 100.0
    if "pct_decimals" in goals.columns:
        pct = F.when(F.col("pct_decimals") == 1, F.round(pct, 1)).otherwise(pct)
    return (
        cube.where(F.col("opportunities") > 0)
        .join(goals, ["grp", "stat_id"])
        .withColumn("actual", pct)
        .withColumn("score", F.round(scoring.score_tier(F.col("actual"), F.col("ideal"), F.col("down_pct"), F.col("up_pct")), 1))
        .withColumn("deviation", F.round(F.col("actual") - F.col("ideal"), 1))
        .withColumn("trend", scoring.deviation_trend(F.col("actual"), F.col("ideal")))
        .withColumn("confidence", scoring.confidence(F.col("opportunities")))
        .withColumn("actual", F.round("actual", 1))
    )


def group_overall(scored: DataFrame) -> DataFrame:
    """Weighted mean over the scored metrics of each group."""
    return scored.groupBy("grp").agg(steady_round(weighted_mean(F.col("score"), F.col("weight")), 1).alias("overall_score"))


def counter_goals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        targets.counter_targets(), "grp string, stat_id string, ideal double, down_pct double, up_pct double, weight double"
    )


def category_goals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        targets.category_table(),
        "grp string, category string, stat_id string, weight double, rescale boolean, pct_decimals int, decimals int,"
        " ideal double, down_pct double, up_pct double",
    )


def category_scores(cube: DataFrame, goals: DataFrame) -> DataFrame:
    """One weighted roll-up for every category; the table says what is rescaled."""
    scored = tier_scores(cube, goals)
    part = F.sum(F.col("score") * F.col("weight"))
    score = F.when(F.max("rescale"), part / F.sum("weight")).otherwise(part)
    rounded = F.when(F.max("decimals") == 1, steady_round(score, 1)).otherwise(steady_round(score, 2))
    return scored.groupBy("grp", "category").agg(rounded.alias("score"), F.count(F.lit(1)).alias("stats"))


def monthly_scores(cube: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per month (and further ``keys``): the groups' rates, each to one place, weighted by their opportunities."""
    keys = ["month", *(keys or [])]
    groups = cube.groupBy(*keys, "grp").agg(
        F.round(F.sum("attempts") / F.sum("opportunities") * 100.0, 1).alias("score"), F.sum("opportunities").cast("double").alias("hands")
    )
    return groups.groupBy(*keys).agg(weighted_mean(F.col("score"), F.col("hands")).alias("score"))


def monthly_overall(cube: DataFrame, postflop: DataFrame, goals: DataFrame, subgroup_weights: DataFrame, pool: list[str] | None = None) -> DataFrame:
    """(month, postflop, overall): the blend of ``hand_share_blend`` for each month, its post-flop score of that month too.

    ``cube``: month, grp, opportunities, attempts; a group's score is its rate to one place. ``postflop``: month, stat_id,
    opportunities, attempts, percentage, added over the groups; ``goals`` and ``subgroup_weights`` as for
    ``postflop_aggregate`` and ``postflop_overall``. A month without post-flop rows gets 0 for that part.
    """
    subgroups = postflop_subgroups(postflop_aggregate(postflop, goals), ["month"])
    post = postflop_overall(subgroups, subgroup_weights, ["month"])
    rate = F.round(F.sum("attempts") / F.sum("opportunities") * 100.0, 1)
    groups = cube.groupBy("month", "grp").agg(F.sum("opportunities").alias("hands"), rate.alias("score"))
    return hand_share_blend(groups, post, pool, ["month"])


def category_report(categories: DataFrame, groups: DataFrame, pool: list[str] | None = None) -> DataFrame:
    """Category scores with label and weight, the pooled groups' added in proportion to their hands.

    ``categories``: grp, category, score. ``groups``: grp, hands. A pooled group without a
    score in a category adds nothing to it.
    """
    pool = pool or ["nonko_9max", "nonko_6max"]
    family = F.when(F.col("grp").isin(pool), F.lit("nonko")).otherwise(F.col("grp")).alias("family")
    shares = groups.where(F.col("hands") > 0).select("grp", family, "hands")
    share = F.col("hands") / F.sum("hands").over(Window.partitionBy("family"))
    return (
        categories.join(shares.withColumn("share", share).select("grp", "family", "share"), "grp")
        .groupBy("family", "category")
        .agg(steady_round(F.sum(F.coalesce("score", F.lit(0.0)) * F.col("share")), 2).alias("score"))
        .withColumns({"label": lookup(targets.CATEGORY_LABELS, F.col("category")), "weight": lookup(targets.CATEGORY_WEIGHTS, F.col("category"))})
    )


def hand_share_blend(groups: DataFrame, postflop: DataFrame, pool: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Overall score: 80% spread over the groups by hands, 20% the post-flop score; for each ``by``, if given.

    ``groups``: grp, hands, score. ``pool`` names the groups merged into one (by
    hands) before the split. ``postflop``: one row with ``score``.
    """
    pool, by = pool or ["nonko_9max", "nonko_6max"], by or []
    family = F.when(F.col("grp").isin(pool), F.lit("nonko")).otherwise(F.col("grp"))
    merged = (
        groups.where(F.col("hands") > 0)
        .groupBy(*by, family.alias("family"))
        .agg(
            steady_round(F.sum(F.coalesce("score", F.lit(0.0)) * F.col("hands")) / F.sum("hands"), 1).alias("score"),
            F.sum("hands").alias("hands"),
        )
        .select(*by, "family", "score", F.col("hands").cast("double").alias("hands"))
    )
    both = merged.unionByName(
        postflop.select(*by, F.lit("postflop").alias("family"), F.col("score"), F.lit(None).cast("double").alias("hands"))
    )
    by_hands = F.sum(F.col("score") * F.col("hands")) / F.sum("hands") * 0.80
    post = F.coalesce(F.sum(F.when(F.col("family") == "postflop", F.col("score"))), F.lit(0.0)) * 0.20
    overall = F.when(F.sum("hands") > 0, by_hands + post).alias("overall")
    if not by:
        return both.agg(overall)
    return both.groupBy(*by).agg(F.max(F.when(F.col("family") == "postflop", F.col("score"))).alias("postflop"), overall)


def postflop_goals(spark: SparkSession) -> DataFrame:
    rows = [(s, sub, i, d, u, w) for s, (sub, i, d, u, w) in targets.POSTFLOP_TARGETS.items()]
    return spark.createDataFrame(rows, "stat_id string, subgroup string, ideal double, down double, up double, weight double")


def postflop_aggregate(merged: DataFrame, goals: DataFrame) -> DataFrame:
    """Post-flop metrics (already added over groups, with ``percentage``) scored by absolute steps."""
    score = F.when(
        (F.col("opportunities") > 0) & F.col("ideal").isNotNull(),
        scoring.score_step(F.col("percentage"), F.col("ideal"), F.col("down"), F.col("up")),
    )
    return merged.join(goals, "stat_id").withColumn("score", score)


def postflop_subgroups(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Score and share of weight per post-flop subgroup, of each ``by`` if given."""
    rows = scored.groupBy(*(by or []), "subgroup").agg(
        F.sum("weight").alias("raw"),
        steady_round(F.coalesce(weighted_mean(F.col("score"), F.when(F.col("weight") > 0, F.col("weight"))), F.lit(0.0)), 1).alias("score"),
    )
    # as many subgroups as the goals name: their shares are taken inside one row
    listed = rows.groupBy(*(by or [])).agg(F.collect_list(F.struct("subgroup", "raw", "score")).alias("_rows"), F.sum("raw").alias("_all"))
    share = lambda r: F.when(F.col("_all") != 0, r["raw"] / F.col("_all")).otherwise(r["raw"])
    cells = F.transform("_rows", lambda r: F.struct(r["subgroup"].alias("subgroup"), share(r).alias("weight"), r["score"].alias("score")))
    return listed.select(*(by or []), F.inline(cells))


def postflop_overall(subgroups: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fixed subgroup weights, not rescaled to the subgroups present."""
    return subgroups.select(*(by or []), "subgroup", "score").join(weights, "subgroup").groupBy(*(by or [])).agg(
        steady_round(F.sum(F.col("score") * F.col("subgroup_weight")), 1).alias("score")
    )
