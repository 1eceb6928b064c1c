"""Opportunity and attempt counts: the core job.

Hands stay one row each; the labels a hand belongs to are exploded (at most two per
hand), and all metrics are counted by conditional sums in ONE group-by on
(month, group). Counters combine map-side, so the shuffle carries one row per
month x group x task whatever the number of hands. Only then is the wide row
turned into the long cube.
"""

from pyspark.sql import DataFrame, functions as F

from tallyhand.functions import timecols, tourney
from tallyhand.functions.columns import ratio_pct
from tallyhand.functions.predicates import Fields, metric_text


def with_month_and_groups(facts: DataFrame) -> DataFrame:
    """Add ``month`` (from the stamp, else the stored month) and ``groups``."""
    cls = tourney.class_from_file(F.col("tourney_class"), F.col("file_id"))
    post = F.col("saw_flop") | F.col("saw_turn") | F.col("saw_river")
    return facts.withColumns(
        {
            "month": timecols.month_bucket(F.col("timestamp_utc"), F.col("month")),
            "groups": tourney.group_labels(cls, F.col("table_max_resolved"), post),
        }
    )


def _flags(df: DataFrame, metrics: list[dict]) -> DataFrame:
    """One (opportunity, attempt) pair of boolean columns per metric, tested once per hand."""
    fields = Fields(df.schema)
    flags = []
    for i, metric in enumerate(metrics):
        opp, att = metric_text(metric, fields)
        flags += [f"{opp} AS o{i}", f"{att} AS a{i}"]
    return df.selectExpr("*", *flags)


def count_flags(
    flagged: DataFrame, stats: list[tuple[str, list[str] | None]], keys: list[str], groups: str | None = None
) -> DataFrame:
    """Long cube from flag columns ``o0, a0, o1, a1, ...``, one pair per (stat_id, labels).

    ``groups`` names an array of labels: a row counts once under each label that a
    metric applies to (None = all of them). The predicates ran before the labels are
    exploded.
    """
    by = list(keys)
    pairs = [f"{k}{i}" for i in range(len(stats)) for k in "oa"]
    member = ["true"] * len(stats)
    if groups:
        flagged = flagged.select(*keys, *pairs, F.explode(groups).alias("grp"))
        by.append("grp")
        quoted = lambda labels: ", ".join(f"'{g}'" for g in labels)
        member = ["true" if labels is None else f"grp IN ({quoted(labels)})" for _, labels in stats]
    sums = [
        F.expr(f"coalesce(sum(CASE WHEN {member[i]} AND {k}{i} THEN 1L ELSE 0L END), 0L) AS {k}{i}")
        for i in range(len(stats))
        for k in "oa"
    ]
    wide = flagged.groupBy(*by).agg(*sums)
    rows = ", ".join(
        f"named_struct('stat_id', '{stat}', 'opportunities', o{i}, 'attempts', a{i})" for i, (stat, _) in enumerate(stats)
    )
    triples = F.expr(f"array({rows})")
    return wide.select(*by, F.inline(triples)).where((F.col("opportunities") > 0) | (F.col("attempts") > 0))


def count_metrics(df: DataFrame, metrics: list[dict], keys: list[str], groups: str | None = None) -> DataFrame:
    """Long cube (keys..., [grp], stat_id, opportunities, attempts) of a metric catalogue."""
    stats = [(m["id"], m["applies_to_groups"]) for m in metrics]
    return count_flags(_flags(df, metrics), stats, keys, groups)


def count_hands(facts: DataFrame, metrics: list[dict]) -> DataFrame:
    """The cube for hands that carry ``month`` and ``groups``."""
    return count_metrics(facts, metrics, keys=["month"], groups="groups")


def stat_hits(facts: DataFrame, metrics: list[dict], hand_id: str = "hand_id", stat_ids: list[str] | None = None) -> DataFrame:
    """The id index: one row per (month, grp, stat_id, kind, hand_id) that was counted.

    This is what drill-down joins against; it is written partitioned and never
    collected. With ``stat_ids`` only those metrics are tested, and only what they need is derived.
    """
    metrics = [m for m in metrics if stat_ids is None or m["id"] in stat_ids]
    flagged = _flags(facts, metrics)
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"{kind}{i}"),
                    F.struct(
                        F.lit(m["id"]).alias("stat_id"),
                        F.lit(name).alias("kind"),
                        F.array(*map(F.lit, m["applies_to_groups"])).alias("member_of"),
                    ),
                )
                for i, m in enumerate(metrics)
                for kind, name in (("o", "opps"), ("a", "attempts"))
            ]
        )
    )
    return (
        flagged.select("month", "groups", F.col(hand_id).alias("hand_id"), F.inline(hits))
        .select("month", F.explode(F.array_intersect("groups", "member_of")).alias("grp"), "stat_id", "kind", "hand_id")
    )


def counted_hands(facts: DataFrame, metrics: list[dict], marked: list[str], hand_id: str = "hand_id") -> DataFrame:
    """(grp, hand_id, marked): the groups in which any metric counted a hand, and whether one of the ``marked`` metrics did.

    The tests of all metrics fold into two booleans a group before the labels are exploded.
    """
    flagged = _flags(facts, metrics)
    labels = dict.fromkeys(g for m in metrics for g in m["applies_to_groups"])

    def any_of(label: str, stats: list[str] | None) -> str:
        flags = [f"o{i} OR a{i}" for i, m in enumerate(metrics) if label in m["applies_to_groups"] and (stats is None or m["id"] in stats)]
        return f"coalesce({' OR '.join(flags)}, false)" if flags else "false"

    cells = ", ".join(f"named_struct('grp', '{g}', 'counted', {any_of(g, None)}, 'marked', {any_of(g, marked)})" for g in labels)
    rows = flagged.select("groups", F.col(hand_id).alias("hand_id"), F.expr(f"inline(array({cells}))"))
    return rows.where(F.col("counted") & F.array_contains("groups", F.col("grp"))).select("grp", "hand_id", "marked")


def with_percentage(cube: DataFrame, decimals: int = 2) -> DataFrame:
    return cube.withColumn("percentage", ratio_pct(F.col("attempts"), F.col("opportunities"), decimals))
