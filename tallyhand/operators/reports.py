"""Reports over the cube and the run tables: joins, hierarchy, top-k, pivots."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyhand.functions import scoring
from tallyhand.functions.columns import count_true, ratio_pct, steady_round, weighted_mean
from tallyhand.functions.numbers import decimal_comma
from tallyhand.operators.months import DECAY, joined_by
from tallyhand.sources.readers import first_row

# Parts of metric names, in test order, and the subgroup they mean.
SUBGROUP_MARKS = [
    (["RFI_", "CO_STEAL", "BTN_STEAL"], "RFI"),
    (["SB_UO", "SB_STEAL", "BB_FOLD_TO_SB", "BB_RAISE_VS_SB"], "BvB"),
    (["FOLD_TO_3BET"], "VS_3BET"),
    (["3BET"], "3BET_RANGE"),
    (["COLD_CALL"], "CC_RANGE"),
    (["VPIP"], "VPIP"),
    (["FOLD_TO_CO_STEAL"], "FOLD_RANGE"),
    (["SQUEEZE"], "SQUEEZE"),
    (["BB_FOLD_VS_", "BB_RESTEAL"], "BB_DEFENSE"),
    (["SB_FOLD_TO_", "SB_RESTEAL"], "SB_DEFENSE"),
    (["FLOP_CBET"], "FLOP_CBET"),
    (["FOLD_VS_CBET", "RAISE_CBET", "FOLD_VS_CHECK_RAISE", "FLOP_FOLD_VS_CBET", "FLOP_RAISE_CBET"], "VS_CBET"),
    (["BET_VS_MISSED_CBET", "FLOP_BET_VS_MISSED"], "VS_SKIPPED_CBET"),
    (["TURN_CBET", "TURN_DONK", "BET_TURN_VS_MISSED", "TURN_FOLD_VS_CBET"], "TURN_PLAY"),
    (["WTSD", "W$SD", "W$WSF", "RIVER_AGG", "RIVER_BET"], "RIVER_PLAY"),
]


def subgroup_of(stat: Column) -> Column:
    up, out = F.upper(stat), None
    for marks, name in SUBGROUP_MARKS:
        cond = F.lit(False)
        for mark in marks:
            cond = cond | up.contains(mark)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("OTHER")


def label_of(stat: Column) -> Column:
    """``RFI_CO_STEAL`` -> ``RFI — Co Steal``; names without ``_`` stay."""
    words = F.split(stat, "_")
    tail = F.array_join(F.transform(F.slice(words, 2, F.size(words)), lambda p: F.initcap(F.lower(p))), " ")
    return F.when(F.size(words) > 1, F.concat(F.get(words, F.lit(0)), F.lit(" — "), tail)).otherwise(stat)


def hierarchy(cube: DataFrame, ideals: DataFrame, width: float = 2.0) -> DataFrame:
    """Cube rows with their subgroup and the ideal range, ideal +- width."""
    return (
        cube.join(ideals, ["grp", "stat_id"], "left")
        .withColumn("subgroup", subgroup_of(F.col("stat_id")))
        .withColumn("ideal_low", F.col("ideal") - width)
        .withColumn("ideal_high", F.col("ideal") + width)
    )


def flat_report(cube: DataFrame, scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each user's newest month's counters with score and note; unscored metrics stay."""
    newest = cube.groupBy(*(by or [])).agg(F.max("month").alias("month"))
    rows = joined_by(cube, newest, [*(by or []), "month"])
    pct = F.when(F.col("opportunities") > 0, F.round(F.col("attempts") / F.col("opportunities") * 100.0, 2))
    return (
        rows.join(scores, [*(by or []), "grp", "stat_id"], "left")
        .withColumn("pct", pct)
        .withColumn("subgroup", subgroup_of(F.col("stat_id")))
        .withColumn("note", scoring.score_note(F.col("score")))
        .select(*(by or []), "month", "grp", "subgroup", "stat_id", "opportunities", "attempts", "pct", "score", "note")
    )


def month_columns(weighted: DataFrame, keys: list[str], value: str = "pct", n: int = 3) -> DataFrame:
    """One column per month rank (``pct_1`` = newest) and the null-safe weighted mean.

    ``weighted`` carries ``rank`` and ``weight``. The ranks are known, so the pivot is a
    plain conditional aggregate.
    """
    return weighted.groupBy(*keys).agg(
        *[F.max(F.when(F.col("rank") == i, F.col(value))).alias(f"{value}_{i}") for i in range(1, n + 1)],
        weighted_mean(F.col(value), F.col("weight")).alias(f"{value}_weighted"),
    )


def merge_months(weighted: DataFrame, by: list[str] | None = None, table: dict[int, list[float]] = DECAY) -> DataFrame:
    """Dashboard rows over the chosen months: summed counters, weighted score, value per month.

    ``weighted``: month, grp, stat_id, opportunities, attempts, percentage, score, and the rank
    and weight of ``months.weigh_months`` with the same ``by`` and ``table``.
    """
    return weighted.groupBy(*(by or []), "grp", "stat_id").agg(
        F.sum("opportunities").alias("opportunities"),
        F.sum("attempts").alias("attempts"),
        weighted_mean(F.col("score"), F.col("weight")).alias("score"),
        *[F.max(F.when(F.col("rank") == i, F.col("percentage"))).alias(f"pct_{i}") for i in range(1, max(table) + 1)],
    )


def drill_down(hits: DataFrame, hands: DataFrame, stat_id: str, grp: str, kind: str, key: str = "hand_id") -> DataFrame:
    """Hands counted for one metric, each once (its first month).

    The index is partitioned by month and group, so the filters prune files; distinct
    ids are taken before the join.
    """
    wanted = (
        hits.where((F.col("stat_id") == stat_id) & (F.col("grp") == grp) & (F.col("kind") == kind))
        .groupBy(key)
        .agg(F.min("month").alias("first_month"))
    )
    return hands.join(wanted, key)


def drill_down_stored(
    spark: SparkSession, hits: str, hands: str, stat_id: str, grp: str, kind: str, months: list[str] | None = None, key: str = "hand_id"
) -> DataFrame:
    """``drill_down`` over tables that ``sinks.write_bucketed`` wrote: neither side is shuffled.

    Ids are grouped within their bucket and the buckets of both tables are joined pair by
    pair; with ``months`` only the files of those months are read, on both sides.
    """
    chosen = lambda name: spark.table(name) if months is None else spark.table(name).where(F.col("month").isin(months))
    return drill_down(chosen(hits), chosen(hands), stat_id, grp, kind, key)


def newest_runs(runs: DataFrame, n: int, status: str | None = None) -> DataFrame:
    """The latest ``n`` runs, newest first (a top-k, not a sort of the table)."""
    rows = runs if status is None else runs.where(F.col("status") == status)
    return rows.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(n)


def top_stats(counts: DataFrame, n: int = 3) -> DataFrame:
    return counts.orderBy(F.col("hands").desc(), F.col("stat_id")).limit(n)


def run_details(runs: DataFrame, details: DataFrame) -> DataFrame:
    """Runs with the number of metrics and the opportunities stored for them.

    The details are aggregated before the join, so the join sees one row per run.
    """
    per_pair = details.groupBy("run_id", "stat_id").agg(F.sum("opportunities").alias("opportunities"))
    per_run = per_pair.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("unique_stats"), F.sum("opportunities").alias("total_opportunities")
    )
    return runs.join(per_run, "run_id", "left").withColumn("unique_stats", F.coalesce("unique_stats", F.lit(0)))


def user_summary(runs: DataFrame) -> DataFrame:
    """Per user: runs, hands, outcome counts and the most recent run."""
    return runs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("hands").alias("hands"),
        count_true(F.col("status") == "completed").alias("completed"),
        count_true(F.col("status") == "failed").alias("failed"),
        F.max("created_at").alias("last_run_at"),
        F.max_by("run_id", F.struct("created_at", "run_id")).alias("last_run_id"),
    )


def latest_cube(parts: DataFrame) -> DataFrame:
    """Cube parts from several stored files: per month the rows of the last file win.

    ``parts`` carries ``file_order``.
    """
    last = parts.groupBy("month").agg(F.max("file_order").alias("file_order"))
    return parts.join(last, ["month", "file_order"], "left_semi").drop("file_order")


def overview(rates: DataFrame, scores: DataFrame) -> DataFrame:
    """Weighted rates of the last three months with score and grade."""
    return rates.join(scores, ["grp", "stat_id"], "left").withColumn("grade", scoring.score_grade(F.col("score")))


# Names that decide how the wide report treats a column.
SOURCES = ["9MAX", "6MAX", "PKO", "POSTFLOP"]
UNOPENED = ["Early UO VPIP", "Middle UO VPIP", "Cutoff UO VPIP", "Button UO VPIP"]
OPENS = ["Early RFI", "Middle RFI", "CO Steal", "BTN Steal"]
KEPT_OPENS = ["Fold to", "Resteal"]
AS_IS = ["Total Hands", "POSTFLOP_River Agg", "POSTFLOP_W$WSF Rating"]
BEFORE_COPY, COPIED = "BB Fold to BTN Steal", "BB Fold to SB Steal"


def _skipped(source: str, header: str) -> bool:
    if source in ("9MAX", "6MAX"):
        return any(s in header for s in UNOPENED)
    if source == "PKO":
        return any(s in header for s in OPENS) and not any(s in header for s in KEPT_OPENS)
    return False


def one_decimal(share: Column) -> Column:
    """A share as percentage text with one decimal comma."""
    return F.replace(F.format_string("%.1f", steady_round(share * 100.0, 1)), F.lit("."), F.lit(","))


def wide_merge(sheets: dict[str, DataFrame], key: str | None = None) -> DataFrame:
    """One wide report from up to four one-row sheets, columns prefixed by their source.

    Values become percentages with one decimal comma, apart from counts and ratios;
    ``X VPIP`` (3Bet + Cold Call) follows each cold-call column, one column is shown
    twice. With ``key`` the sheets hold one row per key and are joined on it; without it
    the first row of each sheet, in the order it is read in, is the report's.
    """

    def shown(col: Column) -> Column:
        return one_decimal(decimal_comma(col))

    merged = None
    columns: list[Column] = []
    for source in SOURCES:
        sheet = sheets.get(source)
        if sheet is None:
            continue
        names = [c for c in sheet.columns if c != key]
        if source == "PKO":
            first = [c for c in names if "Total Hands" in c]
            second = [c for c in names if c not in first and any(u in c for u in UNOPENED)]
            names = first + second + [c for c in names if c not in first and c not in second]
        if key is None:
            sheet = first_row(sheet.withColumn("_at", F.monotonically_increasing_id()), "_at")
        prefixed = sheet.select(
            F.lit(1).alias("_k") if key is None else F.col(key).alias("_k"),
            *[F.col(f"`{c}`").alias(f"{source}_{c}") for c in names],
        )
        merged = prefixed if merged is None else merged.join(prefixed, "_k", "full_outer" if key else "inner")
        for name in names:
            header = f"{source}_{name}"
            if _skipped(source, header):
                continue
            col = F.col(f"`{header}`")
            columns.append((col if any(a in header for a in AS_IS) else shown(col)).alias(header))
            if source == "POSTFLOP":
                continue
            if header.endswith(BEFORE_COPY) and COPIED in names:
                columns.append(shown(F.col(f"`{source}_{COPIED}`")).alias(f"{source}_{COPIED} (Dup)"))
            for seat in ("EP", "MP", "CO", "BTN"):
                three = name.replace("Cold Call", "3Bet")
                if header.endswith(f"{seat} Cold Call") and three in names:
                    both = decimal_comma(F.col(f"`{source}_{three}`")) + decimal_comma(col)
                    columns.append(one_decimal(both).alias(f"{source}_{seat} VPIP"))
    if merged is None:
        raise ValueError("no sheet given")
    return merged.select(*([F.col("_k").alias(key)] if key else []), *columns)


def committed_before(actions: DataFrame, hand: str, player: str, street: str, order: str, amount: str = "amount") -> DataFrame:
    """Long-form betting arithmetic: what each action adds and what was left before it.

    ``actions`` holds chip-committing rows (``amount`` is the total on the street) and
    ``stack`` (starting chips without the ante). Keys are (hand, player), so windows
    hold a few rows each.
    """
    on_street = Window.partitionBy(hand, player, street).orderBy(order)
    in_hand = Window.partitionBy(hand, player).orderBy(order)
    added = F.col(amount) - F.coalesce(F.lag(amount).over(on_street), F.lit(0.0))
    rows = actions.withColumn("added", added)
    spent = F.sum("added").over(in_hand.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("available", F.col("stack") - F.coalesce(spent, F.lit(0.0))).withColumn(
        "math_allin", F.col("added") >= F.col("available") - 0.01
    )


def month_rates(cube: DataFrame) -> DataFrame:
    return cube.withColumn("percentage", ratio_pct(F.col("attempts"), F.col("opportunities")))
