"""Queries over the count cube of the orders table, with their oracles."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.tables import table
from tallyhand.functions import scoring
from tallyhand.functions.columns import ratio_pct, weighted_mean
from tallyhand.operators import cube as cubes
from tallyhand.operators import months, quality, reports
from tallyhand.plans import opportunities, scorecard, targets

GROUPS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _metric(id_, opportunity, attempt, groups=None):
    return {
        "id": id_, "label": id_, "family": id_.split("_")[0], "scope": "preflop",
        "applies_to_groups": groups or GROUPS, "opportunity": opportunity, "attempt": attempt,
    }


# (metric, the same as SQL)
METRICS = [
    (
        _metric("RFI_EARLY", {"in": ["o_orderpriority", ["1-URGENT", "2-HIGH"]]}, {"eq": ["o_orderstatus", "F"]}),
        "o_orderpriority IN ('1-URGENT', '2-HIGH')", "o_orderstatus = 'F'",
    ),
    (
        _metric("RFI_CO_STEAL", {"gte": ["o_totalprice", 150000]}, {"not": {"eq": ["o_orderstatus", "O"]}}),
        "o_totalprice >= 150000", "o_orderstatus <> 'O'",
    ),
    (
        _metric("SB_STEAL", {"all": [{"eq": ["o_orderpriority", "3-MEDIUM"]}, {"lt": ["o_totalprice", 400000]}]}, {"gt": ["c_acctbal", 0]}),
        "o_orderpriority = '3-MEDIUM' AND o_totalprice < 400000", "c_acctbal > 0",
    ),
    (
        _metric("BTN_3BET", {"any": [{"eq": ["o_orderpriority", "5-LOW"]}, {"lte": ["c_acctbal", -500]}]}, {"in": ["o_orderstatus", ["F", "P"]]}),
        "o_orderpriority = '5-LOW' OR c_acctbal <= -500", "o_orderstatus IN ('F', 'P')",
    ),
    (
        _metric("POST_CBET_FLOP_IP", {"is_true": "o_orderstatus"}, [{"gte": ["o_totalprice", 100000]}, {"lt": ["c_acctbal", 5000]}]),
        "true", "o_totalprice >= 100000 AND c_acctbal < 5000",
    ),
    (
        _metric("POST_CBET_TURN_OOP", {"not": {"eq": ["o_orderpriority", "4-NOT SPECIFIED"]}}, {"gt": ["o_totalprice", 250000]}, GROUPS[:3]),
        "o_orderpriority <> '4-NOT SPECIFIED' AND grp IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')", "o_totalprice > 250000",
    ),
    (
        _metric("EP_CBET_RIVER", {"eq": ["o_orderstatus", "P"]}, {"gt": ["o_totalprice", 200000]}),
        "o_orderstatus = 'P'", "o_totalprice > 200000",
    ),
]
CATALOGUE = [m for m, _, _ in METRICS]

ORDERS = """
oc AS (SELECT o.*, c.c_acctbal, c.c_mktsegment AS grp, c.c_nationkey, strftime(o_orderdate, '%Y-%m') AS month
       FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)
"""


def _cube_cells(keys: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{m['id']}' AS stat_id, count(*) FILTER (WHERE {opp}) AS opportunities,"
        f" count(*) FILTER (WHERE ({opp}) AND ({att})) AS attempts FROM {source} GROUP BY {keys}"
        f" HAVING count(*) FILTER (WHERE {opp}) > 0"
        for m, opp, att in METRICS
    )


CUBE = f"WITH {ORDERS}, cube AS ({_cube_cells('month, grp', 'oc')})"
SOURCED = f"WITH {ORDERS}, sc AS (SELECT oc.*, r.r_name AS source FROM oc JOIN nation n ON n.n_nationkey = oc.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey), cube AS ({_cube_cells('month, grp, source', 'sc')})"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c.select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey"), o.o_custkey == c.c_custkey).withColumns(
        {"month": F.date_format("o_orderdate", "yyyy-MM"), "groups": F.array("c_mktsegment")}
    )


def sourced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("source"))
    rows = orders(spark, sf_dir)
    return rows.join(places, rows.c_nationkey == places.n_nationkey)


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opportunities.count_metrics(orders(spark, sf_dir), CATALOGUE, ["month"], "groups")


def sourced_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opportunities.count_metrics(sourced_orders(spark, sf_dir), CATALOGUE, ["month", "source"], "groups")


def by_stat_group(spark, sf_dir):
    return cubes.add_up(cube(spark, sf_dir), ["grp", "stat_id"])


def _pct(a="attempts", o="opportunities", d=2):
    return f"round({a} / {o} * 100.0, {d})"


QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


@query(
    "opp_att_month_group",
    f"""WITH {ORDERS}
    SELECT month, grp, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS opportunities,
      count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F') AS attempts,
      round(100.0 * count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F')
            / count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')), 2) AS percentage
    FROM oc GROUP BY month, grp HAVING count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) > 0""",
)
def opp_att_month_group(spark, sf_dir):
    out = opportunities.count_metrics(orders(spark, sf_dir), CATALOGUE[:1], ["month"], "groups")
    return opportunities.with_percentage(out).drop("stat_id")


@query("opp_att_catalogue", f"{CUBE} SELECT *, {_pct()} AS percentage FROM cube")
def opp_att_catalogue(spark, sf_dir):
    return opportunities.with_percentage(cube(spark, sf_dir))


@query(
    "opp_att_grouping_sets",
    f"""{SOURCED} SELECT CASE WHEN GROUPING(month) = 0 THEN 'detail' ELSE 'total' END AS level, month, source, grp AS table_format, stat_id, CAST(sum(opportunities) AS BIGINT) AS opportunities,
      CAST(sum(attempts) AS BIGINT) AS attempts, round(sum(attempts) / sum(opportunities) * 100.0, 2) AS percentage
    FROM cube GROUP BY GROUPING SETS ((month, source, grp, stat_id), (grp, stat_id))""",
)
def opp_att_grouping_sets(spark, sf_dir):
    return cubes.history_rows(sourced_cube(spark, sf_dir).withColumnRenamed("grp", "table_format"))


@query(
    "partition_counts",
    f"WITH {ORDERS} SELECT CASE WHEN GROUPING(month) = 0 THEN 'detail' ELSE 'total' END AS level, month, grp, count(*) AS hands FROM oc GROUP BY GROUPING SETS ((month, grp), (grp))",
)
def partition_counts(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumnRenamed("c_mktsegment", "grp")
    return cubes.counts_with_totals(rows, ["month", "grp"], ["grp"])


@query(
    "combined_groups",
    f"""{CUBE} SELECT month, 'vehicles' AS grp, stat_id, CAST(sum(opportunities) AS BIGINT) AS opportunities,
      CAST(sum(attempts) AS BIGINT) AS attempts FROM cube WHERE grp IN ('AUTOMOBILE', 'MACHINERY') GROUP BY month, stat_id""",
)
def combined_groups(spark, sf_dir):
    return cubes.combine_groups(cube(spark, sf_dir), ["AUTOMOBILE", "MACHINERY"], "vehicles")


# the two ratio metrics are named after two of the metrics above, with a stand-in for
# the players at the flop
def _rated(spark, sf_dir):
    stat = F.when(F.col("stat_id") == "SB_STEAL", cubes.WIN_RATING).when(F.col("stat_id") == "BTN_3BET", cubes.RIVER_AGGRESSION).otherwise(F.col("stat_id"))
    return (
        sourced_cube(spark, sf_dir)
        .withColumn("player_sum", F.when(F.col("stat_id") == "SB_STEAL", F.col("opportunities") * 3 - F.col("attempts")))
        .withColumn("stat_id", stat)
    )


RATED = f"""{SOURCED}, rated AS (
  SELECT month, grp, source, opportunities, attempts,
    CASE stat_id WHEN 'SB_STEAL' THEN 'W$WSF Rating' WHEN 'BTN_3BET' THEN 'River Agg %' ELSE stat_id END AS stat_id,
    CASE WHEN stat_id = 'SB_STEAL' THEN opportunities * 3 - attempts END AS player_sum FROM cube)"""


@query(
    "multi_source_merge",
    f"""{RATED} SELECT grp, stat_id, CAST(o AS BIGINT) AS opportunities, CAST(a AS BIGINT) AS attempts,
      CAST(p AS BIGINT) AS player_sum, sources,
      CASE WHEN stat_id = 'W$WSF Rating' THEN round(CAST(a AS DOUBLE) / o * (CAST(p AS DOUBLE) / o), 2)
           WHEN stat_id = 'River Agg %' THEN round(CAST(a AS DOUBLE) / o, 2) ELSE round(CAST(a AS DOUBLE) / o * 100.0, 2) END AS percentage
    FROM (SELECT grp, stat_id, sum(opportunities) AS o, sum(attempts) AS a, sum(player_sum) AS p,
            list(DISTINCT source ORDER BY source) AS sources FROM rated GROUP BY grp, stat_id)""",
)
def multi_source_merge(spark, sf_dir):
    return cubes.merge_sources(_rated(spark, sf_dir), ["grp", "stat_id"])


@query(
    "performance_ratio",
    f"""{CUBE} SELECT grp, month, CASE WHEN opportunities > 0 THEN
      round(CAST(attempts AS DOUBLE) / opportunities * (CAST(opportunities * 3 - attempts AS DOUBLE) / opportunities), 2) ELSE 0.0 END AS rating
    FROM cube WHERE stat_id = 'SB_STEAL'""",
)
def performance_ratio(spark, sf_dir):
    rows = cube(spark, sf_dir).where(F.col("stat_id") == "SB_STEAL")
    return rows.select("grp", "month", scoring.performance_ratio(F.col("attempts"), F.col("opportunities"), F.col("opportunities") * 3 - F.col("attempts")).alias("rating"))


@query(
    "action_ratio",
    f"""{CUBE} SELECT grp, month, stat_id, CASE WHEN opportunities - attempts > 0 THEN round(CAST(attempts AS DOUBLE) / (opportunities - attempts), 2)
      WHEN attempts > 0 THEN 10.0 ELSE 0.0 END AS ratio FROM cube""",
)
def action_ratio(spark, sf_dir):
    return cube(spark, sf_dir).select(
        "grp", "month", "stat_id", scoring.action_ratio(F.col("attempts"), F.col("opportunities") - F.col("attempts")).alias("ratio")
    )


@query(
    "cross_group_merge",
    f"""{CUBE} SELECT stat_id, CAST(sum(opportunities) AS BIGINT) AS opportunities, CAST(sum(attempts) AS BIGINT) AS attempts
    FROM cube WHERE contains(stat_id, 'FLOP') OR contains(stat_id, 'TURN') OR contains(stat_id, 'RIVER') GROUP BY stat_id""",
)
def cross_group_merge(spark, sf_dir):
    return cubes.across_groups(cube(spark, sf_dir), ["FLOP", "TURN", "RIVER"])


@query(
    "keyword_stats",
    f"""{CUBE} SELECT * FROM cube WHERE contains(lower(stat_id), 'cbet') OR contains(lower(stat_id), 'steal')""",
)
def keyword_stats(spark, sf_dir):
    return cubes.keyword_stats(cube(spark, sf_dir), ["CBet", "Steal"])


@query(
    "stat_name_filter",
    f"{CUBE} SELECT grp, stat_id, CAST(sum(opportunities) AS BIGINT) AS opportunities, CAST(sum(attempts) AS BIGINT) AS attempts FROM cube WHERE stat_id IN ('RFI_EARLY', 'RFI_CO_STEAL') GROUP BY grp, stat_id",
)
def stat_name_filter(spark, sf_dir):
    rows = cube(spark, sf_dir).where(F.col("stat_id").isin("RFI_EARLY", "RFI_CO_STEAL"))
    return cubes.add_up(rows, ["grp", "stat_id"])


@query(
    "composite_vpip",
    f"""{CUBE}, parts AS (SELECT month, grp, CASE stat_id WHEN 'RFI_EARLY' THEN 'EP 3bet' WHEN 'RFI_CO_STEAL' THEN 'EP Cold Call'
        WHEN 'SB_STEAL' THEN 'CO 3bet' WHEN 'BTN_3BET' THEN 'CO Cold Call' ELSE stat_id END AS part, opportunities, attempts FROM cube)
    SELECT month, grp, left(part, 2) || ' VPIP' AS stat_id, max(opportunities) AS opportunities, CAST(sum(attempts) AS BIGINT) AS attempts
    FROM parts WHERE part IN ('EP 3bet', 'EP Cold Call', 'CO 3bet', 'CO Cold Call') GROUP BY month, grp, left(part, 2)""",
)
def composite_vpip(spark, sf_dir):
    names = {"RFI_EARLY": "EP 3bet", "RFI_CO_STEAL": "EP Cold Call", "SB_STEAL": "CO 3bet", "BTN_3BET": "CO Cold Call"}
    stat = F.col("stat_id")
    for old, new in names.items():
        stat = F.when(F.col("stat_id") == old, new).otherwise(stat)
    return cubes.vpip_from_parts(cube(spark, sf_dir).withColumn("stat_id", stat), ["month", "grp"], ["EP", "CO"])


PARTS = """
parts AS (
  SELECT stat_id, opportunities, attempts,
    CASE WHEN regexp_matches(stat_id, '_(EP|UTG|UTG1|UTG2)(_|$)') THEN 'EP' WHEN regexp_matches(stat_id, '_(MP|MP1|MP2|LJ)(_|$)') THEN 'MP'
         WHEN regexp_matches(stat_id, '_(CO|HJ)(_|$)') THEN 'CO' WHEN regexp_matches(stat_id, '_(BTN|BU)(_|$)') THEN 'BTN'
         WHEN regexp_matches(stat_id, '_(SB|BB)(_|$)') THEN 'BLINDS' END AS position,
    CASE WHEN contains(stat_id, '_FLOP') THEN 'FLOP' WHEN contains(stat_id, '_TURN') THEN 'TURN' WHEN contains(stat_id, '_RIVER') THEN 'RIVER' END AS street
  FROM named)
"""


@query(
    "breakdown_position_street",
    f"""{CUBE}, named AS (SELECT 'X_' || stat_id || CASE WHEN grp = 'BUILDING' THEN '_BTN' WHEN grp = 'FURNITURE' THEN '_SB' ELSE '' END AS stat_id, opportunities, attempts FROM cube), {PARTS},
    sets AS (
      SELECT 'position' AS level, position, NULL AS street, sum(opportunities) AS o, sum(attempts) AS a, count(*) AS stats FROM parts WHERE position IS NOT NULL GROUP BY position
      UNION ALL SELECT 'street', NULL, street, sum(opportunities), sum(attempts), count(*) FROM parts WHERE street IS NOT NULL GROUP BY street
      UNION ALL SELECT 'both', position, street, sum(opportunities), sum(attempts), count(*) FROM parts WHERE position IS NOT NULL AND street IS NOT NULL GROUP BY position, street)
    SELECT level, position, street, CAST(o AS BIGINT) AS opportunities, CAST(a AS BIGINT) AS attempts, stats, round(CAST(a AS DOUBLE) / o * 100.0, 2) AS percentage FROM sets""",
)
def breakdown_position_street(spark, sf_dir):
    mark = F.when(F.col("grp") == "BUILDING", "_BTN").when(F.col("grp") == "FURNITURE", "_SB").otherwise("")
    named = cube(spark, sf_dir).withColumn("stat_id", F.concat(F.lit("X_"), F.col("stat_id"), mark))
    return cubes.breakdown(named, "X_")


# --- months ------------------------------------------------------------------------------

USABLE = f"""{CUBE}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY grp, stat_id ORDER BY month DESC) AS rank FROM cube WHERE opportunities >= 10),
usable AS (SELECT *, count(*) OVER (PARTITION BY grp, stat_id) AS months_used FROM ranked WHERE rank <= 3),
weighted AS (SELECT *, CASE months_used WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE CASE rank WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END END AS weight FROM usable)"""


@query("top3_months", f"{USABLE} SELECT month, grp, stat_id, opportunities, attempts, CAST(rank AS INT) AS rank, months_used, CAST(weight AS DOUBLE) AS weight FROM weighted")
def top3_months(spark, sf_dir):
    return months.usable_months(cube(spark, sf_dir), ["grp", "stat_id"])


@query(
    "time_decay_pct",
    f"""{USABLE} SELECT grp, stat_id, round(sum(round(attempts / opportunities * 100.0, 2) * weight) / sum(weight), 4) AS pct, CAST(max(months_used) AS INT) AS months_used
    FROM weighted GROUP BY grp, stat_id""",
)
def time_decay_pct(spark, sf_dir):
    rows = months.usable_months(cube(spark, sf_dir), ["grp", "stat_id"]).withColumn("pct", ratio_pct(F.col("attempts"), F.col("opportunities")))
    return months.decayed_mean(rows, ["grp", "stat_id"], ["pct"]).withColumn("pct", F.round("pct", 4))


@query(
    "min_sample",
    f"{CUBE} SELECT * FROM cube WHERE opportunities >= 10",
)
def min_sample(spark, sf_dir):
    return cube(spark, sf_dir).where(F.col("opportunities") >= targets.MIN_OPPORTUNITIES_MONTH)


NEWEST = "newest AS (SELECT month, rank, CASE rank WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END AS weight FROM (SELECT month, row_number() OVER (ORDER BY month DESC) AS rank FROM (SELECT DISTINCT month FROM {src})) WHERE rank <= 3)"


@query(
    "weighted_att_opp",
    f"""{CUBE}, {NEWEST.format(src='cube')} SELECT grp, stat_id, round(sum(attempts * weight) / sum(opportunities * weight) * 100.0, 4) AS pct,
      CAST(floor(round(sum(attempts * weight), 8)) AS BIGINT) AS attempts, CAST(floor(round(sum(opportunities * weight), 8)) AS BIGINT) AS opportunities
    FROM cube JOIN newest USING (month) GROUP BY grp, stat_id""",
)
def weighted_att_opp(spark, sf_dir):
    return months.weighted_rate(cube(spark, sf_dir), ["grp", "stat_id"]).withColumn("pct", F.round("pct", 4))


SELECTED = "1998-06"
PICKED = f"""picked AS (SELECT month, rank, CASE rank WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END AS weight FROM (
  SELECT month, row_number() OVER (ORDER BY month DESC) AS rank FROM (SELECT DISTINCT month FROM cube WHERE month <= '{SELECTED}')) WHERE rank <= 3)"""


@query(
    "selected_month_blend",
    f"""{CUBE}, {PICKED} SELECT grp, stat_id, round(sum(attempts / opportunities * 100.0 * weight) / sum(weight), 4) AS score, count(*) AS months_used
    FROM cube JOIN picked USING (month) GROUP BY grp, stat_id""",
)
def selected_month_blend(spark, sf_dir):
    rows = cube(spark, sf_dir)
    scores = rows.withColumn("score", F.col("attempts") / F.col("opportunities") * 100.0)
    out = months.blend_months(months.weigh_months(scores, SELECTED), ["grp", "stat_id"])
    return out.withColumn("score", F.round("score", 4))


@query(
    "main_3_months",
    f"""{CUBE}, spine AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS rank FROM (SELECT DISTINCT month FROM cube WHERE month <= '1995-02') ),
    picked AS (SELECT month, CASE WHEN (SELECT count(*) FROM spine) = 1 THEN 1.0 WHEN (SELECT count(*) FROM spine) = 2 THEN CASE rank WHEN 1 THEN 0.7 ELSE 0.3 END
      ELSE CASE rank WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END END AS weight FROM spine WHERE rank <= 3)
    SELECT grp, stat_id, round(sum(attempts / opportunities * 100.0 * weight) / sum(weight), 4) AS score, count(*) AS months_used
    FROM cube JOIN picked USING (month) GROUP BY grp, stat_id""",
)
def main_3_months(spark, sf_dir):
    rows = cube(spark, sf_dir)
    scores = rows.withColumn("score", F.col("attempts") / F.col("opportunities") * 100.0)
    return months.blend_months(months.weigh_months(scores, "1995-02", months.MAIN_DECAY), ["grp", "stat_id"]).withColumn("score", F.round("score", 4))


LAST6 = "l6 AS (SELECT month, row_number() OVER (ORDER BY month) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT month FROM cube ORDER BY month DESC LIMIT 6))"


@query(
    "series_last_n",
    f"""{CUBE}, {LAST6} SELECT grp, stat_id, month, opportunities, attempts, {_pct()} AS percentage, round(CAST(pos AS DOUBLE) / n, 2) AS ramp,
      CAST(sum(opportunities) OVER w AS BIGINT) AS total_opportunities, CAST(sum(attempts) OVER w AS BIGINT) AS total_attempts,
      round(CAST(sum(attempts) OVER w AS DOUBLE) / sum(opportunities) OVER w * 100.0, 2) AS average_percentage
    FROM cube JOIN l6 USING (month) WINDOW w AS (PARTITION BY grp, stat_id)""",
)
def series_last_n(spark, sf_dir):
    return months.ramp_series(cube(spark, sf_dir), 6, ["grp", "stat_id"])


@query(
    "trend_halves",
    f"""{CUBE}, {LAST6}, s AS (SELECT grp, stat_id, month, {_pct()} AS p, row_number() OVER w AS i, count(*) OVER (PARTITION BY grp, stat_id) AS c
        FROM cube JOIN l6 USING (month) WINDOW w AS (PARTITION BY grp, stat_id ORDER BY month)),
    t AS (SELECT grp, stat_id, max(c) AS c, avg(p) FILTER (WHERE i <= c // 2) AS a, avg(p) FILTER (WHERE i > c // 2) AS b,
        arg_max(p, month) AS latest_value, max(p) AS peak_value, min(p) AS valley_value FROM s WHERE c >= 2 GROUP BY grp, stat_id)
    SELECT grp, stat_id, c AS months_analyzed,
      CASE WHEN abs(b - a) < 1 THEN 'stable' WHEN b - a > 5 THEN 'improving' WHEN b - a > 0 THEN 'slightly_improving' WHEN b - a < -5 THEN 'declining' ELSE 'slightly_declining' END AS trend,
      CAST(round(CAST(a AS DECIMAL(24, 8)), 2) AS DOUBLE) AS first_period_avg, CAST(round(CAST(b AS DECIMAL(24, 8)), 2) AS DOUBLE) AS second_period_avg, CAST(round(CAST(b - a AS DECIMAL(24, 8)), 2) AS DOUBLE) AS absolute_change,
      CASE WHEN a <> 0 THEN CAST(round(CAST((b - a) / a * 100.0 AS DECIMAL(24, 8)), 2) AS DOUBLE) ELSE 0.0 END AS rate_of_change, latest_value, peak_value, valley_value FROM t""",
)
def trend_halves(spark, sf_dir):
    return months.trend(cube(spark, sf_dir), 6, ["grp", "stat_id"])


# months by source: each one ends in another month, as users' uploads do
USERS = f"""{SOURCED}, u AS (SELECT * FROM cube WHERE month <= CASE source WHEN 'ASIA' THEN '1997-03' WHEN 'EUROPE' THEN '1995-11' ELSE '1998-12' END),
  ranked AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY month DESC) AS rank FROM u)"""
_DECAY = "CASE rank WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END"


def users(spark, sf_dir):
    last = F.when(F.col("source") == "ASIA", "1997-03").when(F.col("source") == "EUROPE", "1995-11").otherwise("1998-12")
    return sourced_cube(spark, sf_dir).where(F.col("month") <= last)


@query(
    "weighted_att_opp_by_source",
    f"""{USERS}, w AS (SELECT *, {_DECAY} AS weight FROM ranked WHERE rank <= 3)
    SELECT source, grp, stat_id, round(sum(attempts * weight) / sum(opportunities * weight) * 100.0, 4) AS pct,
      CAST(floor(round(sum(attempts * weight), 8)) AS BIGINT) AS attempts, CAST(floor(round(sum(opportunities * weight), 8)) AS BIGINT) AS opportunities
    FROM w GROUP BY source, grp, stat_id""",
)
def weighted_att_opp_by_source(spark, sf_dir):
    return months.weighted_rate(users(spark, sf_dir), ["grp", "stat_id"], by=["source"]).withColumn("pct", F.round("pct", 4))


@query(
    "selected_month_by_source",
    f"""{USERS.replace("FROM u)", "FROM u WHERE month <= '1997-06')")}
    SELECT source, grp, stat_id, round(sum(attempts / opportunities * 100.0 * {_DECAY}) / sum({_DECAY}), 4) AS score, count(*) AS months_used
    FROM ranked WHERE rank <= 3 GROUP BY source, grp, stat_id""",
)
def selected_month_by_source(spark, sf_dir):
    scores = users(spark, sf_dir).withColumn("score", F.col("attempts") / F.col("opportunities") * 100.0)
    out = months.blend_months(months.weigh_months(scores, "1997-06", by=["source"]), ["source", "grp", "stat_id"])
    return out.withColumn("score", F.round("score", 4))


@query(
    "series_by_source",
    f"""{USERS} SELECT source, grp, stat_id, month, opportunities, attempts, {_pct()} AS percentage, round(CAST(7 - rank AS DOUBLE) / 6, 2) AS ramp,
      CAST(sum(opportunities) OVER w AS BIGINT) AS total_opportunities, CAST(sum(attempts) OVER w AS BIGINT) AS total_attempts,
      round(CAST(sum(attempts) OVER w AS DOUBLE) / sum(opportunities) OVER w * 100.0, 2) AS average_percentage
    FROM ranked WHERE rank <= 6 WINDOW w AS (PARTITION BY source, grp, stat_id)""",
)
def series_by_source(spark, sf_dir):
    return months.ramp_series(users(spark, sf_dir), 6, ["grp", "stat_id"], by=["source"])


@query(
    "months_sorted",
    f"""{CUBE}, m AS (SELECT DISTINCT CASE WHEN month LIKE '1995-%' THEN 'unknown' ELSE month END AS month FROM cube)
    SELECT month, CAST(row_number() OVER (ORDER BY month = 'unknown', month DESC) AS INT) AS rank, CAST(count(*) OVER () AS INT) AS of FROM m""",
)
def months_sorted(spark, sf_dir):
    masked = F.when(F.col("month").startswith("1995-"), "unknown").otherwise(F.col("month"))
    return months.ranked_months(cube(spark, sf_dir).withColumn("month", masked))


# --- scores ------------------------------------------------------------------------------

_P, _I = "(attempts / opportunities * 100.0)", "40.0"
STEPS = f"""
CASE WHEN {_P} = {_I} THEN 100.0 ELSE greatest(0.0, least(100.0, 100.0 - (CASE WHEN m - floor(m) < 0.0001 AND floor(m) > 0 THEN floor(m) - 1 ELSE floor(m) END) * 10.0)) END
"""


@query(
    "score_step",
    f"""{CUBE} SELECT month, grp, stat_id, {STEPS} AS score FROM (SELECT *, CASE WHEN {_P} > {_I} THEN ({_P} - {_I}) / 4.0 ELSE ({_I} - {_P}) / 2.0 END AS m FROM cube)""",
)
def score_step(spark, sf_dir):
    pct = F.col("attempts") / F.col("opportunities") * 100.0
    return cube(spark, sf_dir).select("month", "grp", "stat_id", scoring.score_step(pct, F.lit(40.0), 2.0, 4.0).alias("score"))


@query(
    "score_linear",
    f"""{CUBE} SELECT month, grp, stat_id, round(greatest(0.0, least(100.0, 100.0 - CASE WHEN {_P} >= {_I} THEN ({_P} - {_I}) / 4.0 * 10.0 ELSE ({_I} - {_P}) / 2.0 * 10.0 END)), 6) AS score FROM cube""",
)
def score_linear(spark, sf_dir):
    pct = F.col("attempts") / F.col("opportunities") * 100.0
    return cube(spark, sf_dir).select("month", "grp", "stat_id", F.round(scoring.score_linear(pct, F.lit(40.0), 2.0, 4.0), 6).alias("score"))


@query(
    "score_tier",
    f"""{CUBE} SELECT month, grp, stat_id, CASE WHEN abs({_P} - {_I}) < 0.001 THEN 100.0
      WHEN {_P} < {_I} THEN greatest(0.0, 100.0 - floor(({_I} - {_P}) / ({_I} * 6.0 / 100.0)) * 10.0)
      ELSE greatest(0.0, 100.0 - floor(({_P} - {_I}) / ({_I} * 12.0 / 100.0)) * 10.0) END AS score FROM cube""",
)
def score_tier(spark, sf_dir):
    pct = F.col("attempts") / F.col("opportunities") * 100.0
    return cube(spark, sf_dir).select("month", "grp", "stat_id", scoring.score_tier(pct, F.lit(40.0), 6.0, 12.0).alias("score"))


@query(
    "score_notes",
    f"""{CUBE}, s AS (SELECT month, grp, stat_id, round({_P}, 2) AS p, opportunities FROM cube)
    SELECT month, grp, stat_id, p AS score,
      CASE WHEN p >= 90 THEN 'Excelente' WHEN p >= 75 THEN 'Bom' WHEN p >= 60 THEN 'OK' WHEN p >= 40 THEN 'A ajustar' ELSE 'Crítico' END AS note,
      CASE WHEN p >= 90 THEN 'A' WHEN p >= 80 THEN 'B' WHEN p >= 70 THEN 'C' WHEN p >= 60 THEN 'D' ELSE 'E' END AS grade,
      CASE WHEN p >= 90 THEN '#22c55e' WHEN p >= 75 THEN '#84cc16' WHEN p >= 60 THEN '#eab308' WHEN p >= 40 THEN '#f97316' ELSE '#ef4444' END AS color,
      CASE WHEN opportunities >= 100 THEN 'high' WHEN opportunities >= 50 THEN 'medium' ELSE 'low' END AS confidence,
      CASE WHEN abs(p - 40) < 0.5 THEN 'ideal' WHEN p < 40 THEN 'below' ELSE 'above' END AS trend,
      CASE WHEN p BETWEEN 38 AND 42 THEN 'A' WHEN round(greatest(38 - p, p - 42), 2) < 3 THEN 'C' ELSE 'D' END AS range_grade
    FROM s""",
)
def score_notes(spark, sf_dir):
    p = F.round(F.col("attempts") / F.col("opportunities") * 100.0, 2)
    low, high = F.lit(38.0), F.lit(42.0)
    return cube(spark, sf_dir).select(
        "month", "grp", "stat_id", p.alias("score"), scoring.score_note(p).alias("note"), scoring.score_grade(p).alias("grade"),
        scoring.score_color(p).alias("color"), scoring.confidence(F.col("opportunities")).alias("confidence"),
        scoring.deviation_trend(p, F.lit(40.0)).alias("trend"), scoring.range_grade(p, low, high).alias("range_grade"),
    )


@query(
    "range_text",
    f"""{CUBE}, s AS (SELECT month, grp, stat_id, round({_P}, 2) AS p FROM cube)
    SELECT month, grp, stat_id, CASE WHEN p < 38 THEN 'Abaixo do ideal (38.00–42.00); falta ' || printf('%.2f', round(38 - p, 2)) || ' pp.'
      WHEN p > 42 THEN 'Acima do ideal (38.00–42.00); excede ' || printf('%.2f', round(p - 42, 2)) || ' pp.' ELSE 'Dentro do ideal (38.00–42.00).' END AS note FROM s""",
)
def range_text(spark, sf_dir):
    p = F.round(F.col("attempts") / F.col("opportunities") * 100.0, 2)
    return cube(spark, sf_dir).select("month", "grp", "stat_id", scoring.range_text(p, F.lit(38.0), F.lit(42.0)).alias("note"))


@query(
    "weights_normalised",
    f"""{CUBE}, t AS (SELECT grp, stat_id, CAST(sum(opportunities) AS DOUBLE) AS weight FROM cube GROUP BY grp, stat_id)
    SELECT grp, stat_id, round(weight / sum(weight) OVER (PARTITION BY grp), 6) AS weight FROM t""",
)
def weights_normalised(spark, sf_dir):
    w = by_stat_group(spark, sf_dir).select("grp", "stat_id", F.col("opportunities").cast("double").alias("weight"))
    return scorecard.rescaled(w, ["grp"]).withColumn("weight", F.round("weight", 6))


IDEALS = [
    ("RFI_EARLY", "AUTOMOBILE", 50.0), ("RFI_EARLY", "BUILDING", 46.0), ("RFI_EARLY", "HOUSEHOLD", 48.0),
    ("RFI_CO_STEAL", "AUTOMOBILE", 66.0), ("RFI_CO_STEAL", "vehicles", 64.0), ("RFI_CO_STEAL", "HOUSEHOLD", 60.0),
    ("SB_STEAL", "MACHINERY", 80.0), ("SB_STEAL", "HOUSEHOLD", 90.0),
    ("BTN_3BET", "BUILDING", 58.0), ("BTN_3BET", "HOUSEHOLD", 62.0),
]
COMBINED = {"vehicles": ["AUTOMOBILE", "MACHINERY"]}
WEIGHTS = {"RFI": {"RFI_EARLY": 0.4, "RFI_CO_STEAL": 0.6}, "BvB": {"SB_STEAL": 1.0}, "3BET_RANGE": {"BTN_3BET": 0.5}}
SUB_WEIGHTS = {"RFI": 0.5, "BvB": 0.3, "3BET_RANGE": 0.2}
GROUP_WEIGHTS = {"vehicles": 0.5, "HOUSEHOLD": 0.25, "absent": 0.25}

CARD = f"""{CUBE}, ideals(stat_id, grp, ideal) AS (VALUES {', '.join(f"('{s}', '{g}', {i})" for s, g, i in IDEALS)}),
vehicles AS (SELECT month, 'vehicles' AS grp, stat_id, sum(opportunities) AS opportunities, sum(attempts) AS attempts FROM cube WHERE grp IN ('AUTOMOBILE', 'MACHINERY') GROUP BY month, stat_id),
rowz AS (SELECT month, grp, stat_id, opportunities, round(attempts / opportunities * 100.0, 2) AS pct FROM cube
  UNION ALL SELECT month, grp, stat_id, CAST(opportunities AS BIGINT), CAST(attempts AS DOUBLE) / opportunities * 100.0 FROM vehicles),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp, stat_id ORDER BY month DESC) AS rank FROM rowz WHERE opportunities >= 10 AND stat_id IN (SELECT stat_id FROM ideals)),
usable AS (SELECT *, count(*) OVER (PARTITION BY grp, stat_id) AS n FROM ranked WHERE rank <= 3),
aimed AS (SELECT u.*, CASE n WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE CASE rank WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END END AS weight,
  coalesce(own.ideal, CASE WHEN u.grp = 'vehicles' THEN a.ideal ELSE v.ideal END, pct) AS ideal
  FROM usable u LEFT JOIN ideals own ON own.stat_id = u.stat_id AND own.grp = u.grp
  LEFT JOIN ideals a ON a.stat_id = u.stat_id AND a.grp = 'AUTOMOBILE' 
  LEFT JOIN ideals v ON v.stat_id = u.stat_id AND v.grp = 'vehicles'),
steps AS (SELECT *, CASE WHEN pct > ideal THEN (pct - ideal) / 4.0 ELSE (ideal - pct) / 2.0 END AS m FROM aimed),
scored AS (SELECT *, CASE WHEN pct = ideal THEN 100.0 ELSE greatest(0.0, least(100.0, 100.0 - (CASE WHEN m - floor(m) < 0.0001 AND floor(m) > 0 THEN floor(m) - 1 ELSE floor(m) END) * 10.0)) END AS score FROM steps),
card AS (SELECT grp, stat_id, round(round(sum(pct * weight) / sum(weight), 8), 2) AS pct_time_decay, round(round(sum(score * weight) / sum(weight), 8), 2) AS score_time_decay, CAST(max(n) AS INT) AS months_used FROM scored GROUP BY grp, stat_id),
sw(subgroup, stat_id, weight) AS (VALUES {', '.join(f"('{s}', '{k}', {w})" for s, d in WEIGHTS.items() for k, w in d.items())}),
subs AS (SELECT subgroup, grp, round(round(sum(score_time_decay * weight) / sum(weight), 8), 2) AS score FROM card JOIN sw USING (stat_id) GROUP BY subgroup, grp),
gw(subgroup, w) AS (VALUES {', '.join(f"('{s}', {w})" for s, w in SUB_WEIGHTS.items())}),
grps AS (SELECT grp, round(round(sum(score * w), 8), 2) AS score FROM subs JOIN gw USING (subgroup) GROUP BY grp)"""


def _card(spark, sf_dir):
    return scorecard.stat_level(cube(spark, sf_dir), scorecard.ideals_frame(spark, IDEALS), COMBINED)


@query("scorecard_stat", f"{CARD} SELECT * FROM card")
def scorecard_stat(spark, sf_dir):
    return _card(spark, sf_dir)


_RANGES = [("RFI_EARLY", 46.0, 50.0), ("RFI_CO_STEAL", 60.0, 64.0), ("SB_STEAL", 95.5, 99.0)]


@query(
    "scorecard_explained",
    f"""{CARD}, r(stat_id, low, high) AS (VALUES {', '.join(f"('{s}', {a}::DOUBLE, {b}::DOUBLE)" for s, a, b in _RANGES)}), e AS (SELECT card.*, low, high, round(greatest(low - pct_time_decay, pct_time_decay - high), 2) AS off FROM card LEFT JOIN r USING (stat_id))
    SELECT grp, stat_id, pct_time_decay, score_time_decay, months_used, CASE WHEN low IS NULL THEN '-' WHEN off <= 0 THEN 'A' WHEN off < 3 THEN 'C' ELSE 'D' END AS grade,
      CASE WHEN low IS NULL THEN '' WHEN pct_time_decay < low THEN 'Abaixo do ideal (' || printf('%.2f–%.2f', low, high) || '); falta ' || printf('%.2f', off) || ' pp.'
        WHEN pct_time_decay > high THEN 'Acima do ideal (' || printf('%.2f–%.2f', low, high) || '); excede ' || printf('%.2f', off) || ' pp.' ELSE 'Dentro do ideal (' || printf('%.2f–%.2f', low, high) || ').' END AS note FROM e""",
)
def scorecard_explained(spark, sf_dir):
    """Each metric's grade and note from its ideal range."""
    return scorecard.explained(_card(spark, sf_dir), spark.createDataFrame(_RANGES, "stat_id string, low double, high double"))


@query(
    "scorecard_rollup",
    f"""{CARD} SELECT 'subgroup' AS level, subgroup || ':' || grp AS name, score FROM subs UNION ALL SELECT 'group', grp, score FROM grps
    UNION ALL SELECT 'overall', 'all', round(round((SELECT sum(score * w) FROM grps JOIN (VALUES ('vehicles', 0.5), ('HOUSEHOLD', 0.25)) v(grp, w) USING (grp)) / 1.0, 8), 2)""",
)
def scorecard_rollup(spark, sf_dir):
    subs = scorecard.subgroup_level(_card(spark, sf_dir), scorecard.stat_weights_frame(spark, WEIGHTS))
    groups = scorecard.group_level(subs, scorecard.weights_frame(spark, "subgroup", SUB_WEIGHTS))
    total = scorecard.overall(groups, scorecard.weights_frame(spark, "grp", GROUP_WEIGHTS))
    return (
        subs.select(F.lit("subgroup").alias("level"), F.concat("subgroup", F.lit(":"), "grp").alias("name"), "score")
        .unionByName(groups.select(F.lit("group").alias("level"), F.col("grp").alias("name"), "score"))
        .unionByName(total.select(F.lit("overall").alias("level"), F.lit("all").alias("name"), F.col("overall").alias("score")))
    )


# the counter path: metrics and groups renamed to those the target tables know
RENAMED = {
    "RFI_EARLY": "Early RFI", "RFI_CO_STEAL": "CO Steal", "SB_STEAL": "SB Steal", "BTN_3BET": "BTN VPIP",
    "POST_CBET_FLOP_IP": "Squeeze", "POST_CBET_TURN_OOP": "SB fold to CO Steal", "EP_CBET_RIVER": "Fold to 3bet IP",
}
REGROUPED = {
    "AUTOMOBILE": "nonko_9max", "BUILDING": "nonko_6max", "FURNITURE": "pko", "HOUSEHOLD": "nonko_9max", "MACHINERY": "pko",
}


def _swap(col, table_):
    out = F.col(col)
    for old, new in table_.items():
        out = F.when(F.col(col) == old, new).otherwise(out)
    return out


def counter_cube(spark, sf_dir):
    rows = cube(spark, sf_dir).withColumn("stat_id", _swap("stat_id", RENAMED)).withColumn("grp", _swap("grp", REGROUPED))
    return cubes.add_up(rows, ["grp", "stat_id"])


def _case(col, table_):
    return f"CASE {col} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table_.items()) + f" ELSE {col} END"


COUNTERS = f"""{CUBE}, cc AS (SELECT {_case('grp', REGROUPED)} AS grp, {_case('stat_id', RENAMED)} AS stat_id, CAST(sum(opportunities) AS BIGINT) AS opportunities,
  CAST(sum(attempts) AS BIGINT) AS attempts FROM cube GROUP BY 1, 2)"""


def _tier(p: str) -> str:
    return (
        f"CASE WHEN abs({p} - ideal) < 0.001 THEN 100.0 WHEN {p} < ideal THEN greatest(0.0, 100.0 - floor((ideal - {p}) / (ideal * down / 100.0)) * 10.0)"
        f" ELSE greatest(0.0, 100.0 - floor(({p} - ideal) / (ideal * up / 100.0)) * 10.0) END"
    )


GOALS = "goals(grp, stat_id, ideal, down, up, weight) AS (VALUES " + ", ".join(
    f"('{g}', '{s}', {i}, {d}, {u}, {w})" for g, s, i, d, u, w in targets.counter_targets()
) + ")"


@query(
    "tier_scores",
    f"""{COUNTERS}, {GOALS} SELECT grp, stat_id, opportunities, attempts, CAST(ideal AS DOUBLE) AS ideal, CAST(down AS DOUBLE) AS down_pct, CAST(up AS DOUBLE) AS up_pct, CAST(weight AS DOUBLE) AS weight,
      round(p, 1) AS actual, {_tier('p')} AS score, round(p - ideal, 1) AS deviation, CASE WHEN abs(p - ideal) < 0.5 THEN 'ideal' WHEN p < ideal THEN 'below' ELSE 'above' END AS trend,
      CASE WHEN opportunities >= 100 THEN 'high' WHEN opportunities >= 50 THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT cc.*, g.ideal, g.down, g.up, g.weight, attempts / opportunities * 100.0 AS p FROM cc JOIN goals g USING (grp, stat_id))""",
)
def tier_scores(spark, sf_dir):
    return scorecard.tier_scores(counter_cube(spark, sf_dir), scorecard.counter_goals(spark))


@query(
    "group_overall",
    f"""{COUNTERS}, {GOALS} SELECT grp, round(round(sum(score * weight) / sum(weight), 8), 1) AS overall_score FROM (
      SELECT grp, weight, {_tier('p')} AS score FROM (SELECT cc.grp, g.ideal, g.down, g.up, g.weight, attempts / opportunities * 100.0 AS p FROM cc JOIN goals g USING (grp, stat_id))) GROUP BY grp""",
)
def group_overall(spark, sf_dir):
    return scorecard.group_overall(scorecard.tier_scores(counter_cube(spark, sf_dir), scorecard.counter_goals(spark)))


CATEGORY_ROWS = "cat(grp, category, stat_id, weight, rescale, pd, dec, ideal, down, up) AS (VALUES " + ", ".join(
    f"('{g}', '{c}', '{s}', {w}, {str(r).lower()}, {'NULL' if pd is None else pd}, {d}, {i}, {dn}, {up})"
    for g, c, s, w, r, pd, d, i, dn, up in targets.category_table()
) + ")"


@query(
    "category_scores",
    f"""{COUNTERS}, {CATEGORY_ROWS}, sc AS (SELECT grp, category, weight, rescale, dec, {_tier('p')} AS score FROM (
        SELECT cc.grp, t.category, t.weight, t.rescale, t.dec, t.ideal, t.down, t.up,
          CASE WHEN t.pd = 1 THEN round(attempts / opportunities * 100.0, 1) ELSE attempts / opportunities * 100.0 END AS p
        FROM cc JOIN cat t USING (grp, stat_id)))
    SELECT grp, category, CASE WHEN bool_or(rescale) THEN round(round(sum(score * weight) / sum(weight), 8), max(dec)) ELSE round(round(sum(score * weight), 8), max(dec)) END AS score, count(*) AS stats
    FROM sc GROUP BY grp, category""",
)
def category_scores(spark, sf_dir):
    return scorecard.category_scores(counter_cube(spark, sf_dir), scorecard.category_goals(spark))


_LABELS = ", ".join(f"('{c}', '{targets.CATEGORY_LABELS[c]}', {w})" for c, w in targets.CATEGORY_WEIGHTS.items())


@query(
    "category_report",
    f"""WITH cats AS ({ORACLES["category_scores"]}), c AS (SELECT * FROM cats),
    h AS (SELECT *, CASE WHEN grp IN ('nonko_9max', 'nonko_6max') THEN 'nonko' ELSE grp END AS family FROM ({COUNTERS} SELECT grp, sum(opportunities) AS hands FROM cc GROUP BY grp)),
    s AS (SELECT grp, family, hands / sum(hands) OVER (PARTITION BY family) AS share FROM h), l(category, label, weight) AS (VALUES {_LABELS})
    SELECT family, category, round(round(sum(score * share), 8), 2) AS score, any_value(label) AS label, any_value(CAST(weight AS DOUBLE)) AS weight
    FROM c JOIN s USING (grp) JOIN l USING (category) GROUP BY family, category""",
)
def category_report(spark, sf_dir):
    counted = counter_cube(spark, sf_dir)
    hands = counted.groupBy("grp").agg(F.sum("opportunities").alias("hands"))
    return scorecard.category_report(scorecard.category_scores(counted, scorecard.category_goals(spark)), hands)


@query(
    "blend_80_20",
    f"""{COUNTERS}, g AS (SELECT grp, CAST(sum(opportunities) AS BIGINT) AS hands, round(sum(attempts) / sum(opportunities) * 100.0, 1) AS score FROM cc GROUP BY grp),
    f AS (SELECT CASE WHEN grp IN ('nonko_9max', 'nonko_6max') THEN 'nonko' ELSE grp END AS family, round(round(sum(score * hands) / sum(hands), 8), 1) AS score, sum(hands) AS hands FROM g GROUP BY 1)
    SELECT round(sum(score * hands) / sum(hands) * 0.8 + (SELECT round(sum(attempts) / sum(opportunities) * 100.0, 1) FROM cc WHERE stat_id = 'Squeeze') * 0.2, 6) AS overall FROM f""",
)
def blend_80_20(spark, sf_dir):
    rows = counter_cube(spark, sf_dir)
    rate = F.round(F.sum("attempts") / F.sum("opportunities") * 100.0, 1)
    groups = rows.groupBy("grp").agg(F.sum("opportunities").alias("hands"), rate.alias("score"))
    post = rows.where(F.col("stat_id") == "Squeeze").agg(rate.alias("score"))
    return scorecard.hand_share_blend(groups, post).withColumn("overall", F.round("overall", 6))


POST_NAMES = {
    "RFI_EARLY": "Flop CBet IP %", "RFI_CO_STEAL": "Turn CBet IP%", "SB_STEAL": "W$SD%", "BTN_3BET": "River Agg %",
    "POST_CBET_FLOP_IP": "Flop fold vs Cbet IP", "EP_CBET_RIVER": "W$WSF Rating", "POST_CBET_TURN_OOP": "Flop CBet OOP%",
}
POST_GOALS = "pg(stat_id, subgroup, ideal, down, up, weight) AS (VALUES " + ", ".join(
    f"('{s}', '{g}', {'NULL' if i is None else i}, {d}, {u}, {w})" for s, (g, i, d, u, w) in targets.POSTFLOP_TARGETS.items()
) + ")"
POST = f"""{SOURCED}, ren AS (SELECT {_case('stat_id', POST_NAMES)} AS stat_id, opportunities, attempts, CASE WHEN stat_id = 'EP_CBET_RIVER' THEN opportunities * 2 END AS ps FROM cube), {POST_GOALS},
mg AS (SELECT stat_id, CAST(sum(opportunities) AS DOUBLE) AS o, CAST(sum(attempts) AS DOUBLE) AS a, sum(ps) AS p FROM ren GROUP BY stat_id),
pp AS (SELECT mg.stat_id, o, a, CASE WHEN mg.stat_id = 'W$WSF Rating' THEN round(a / o * (p / o), 2) WHEN mg.stat_id = 'River Agg %' THEN round(a / o, 2) ELSE round(a / o * 100.0, 2) END AS pct, subgroup, ideal, down, up, weight FROM mg JOIN pg USING (stat_id)),
ps AS (SELECT *, CASE WHEN pct > ideal THEN (pct - ideal) / up ELSE (ideal - pct) / down END AS m FROM pp),
psc AS (SELECT *, CASE WHEN ideal IS NULL THEN NULL WHEN pct = ideal THEN 100.0 ELSE greatest(0.0, least(100.0, 100.0 - (CASE WHEN m - floor(m) < 0.0001 AND floor(m) > 0 THEN floor(m) - 1 ELSE floor(m) END) * 10.0)) END AS score FROM ps),
sg AS (SELECT subgroup, round(round(coalesce(sum(score * weight) FILTER (WHERE weight > 0) / nullif(sum(weight) FILTER (WHERE score IS NOT NULL AND weight > 0), 0), 0), 8), 1) AS score, sum(weight) AS w FROM psc GROUP BY subgroup)"""


def _post(spark, sf_dir):
    rows = sourced_cube(spark, sf_dir).withColumn("player_sum", F.when(F.col("stat_id") == "EP_CBET_RIVER", F.col("opportunities") * 2))
    merged = cubes.merge_sources(rows.withColumn("stat_id", _swap("stat_id", POST_NAMES)), ["stat_id"])
    return scorecard.postflop_aggregate(merged, scorecard.postflop_goals(spark))


@query("postflop_aggregate", f"{POST} SELECT stat_id, subgroup, CAST(o AS BIGINT) AS opportunities, CAST(a AS BIGINT) AS attempts, pct AS percentage, score FROM psc")
def postflop_aggregate(spark, sf_dir):
    return _post(spark, sf_dir).select("stat_id", "subgroup", "opportunities", "attempts", "percentage", "score")


@query(
    "postflop_rollup",
    f"""{POST} SELECT subgroup, score, round(CAST(w / sum(w) OVER () AS DOUBLE), 6) AS weight,
      (SELECT round(round(sum(s.score * v.w), 8), 1) FROM sg s JOIN (VALUES ('Flop Cbet', 0.35), ('Vs Cbet', 0.20), ('vs Skipped Cbet', 0.10), ('Turn Play', 0.20), ('River play', 0.15)) v(subgroup, w) USING (subgroup)) AS overall FROM sg""",
)
def postflop_rollup(spark, sf_dir):
    subs = scorecard.postflop_subgroups(_post(spark, sf_dir))
    total = scorecard.postflop_overall(subs, scorecard.weights_frame(spark, "subgroup", targets.POSTFLOP_SUBGROUP_WEIGHTS))
    one = F.lit(1).alias("k")
    return (
        subs.select("*", one).join(total.select(F.col("score").alias("overall"), one), "k")
        .select("subgroup", "score", F.round("weight", 6).alias("weight"), "overall")
    )


@query(
    "monthly_scores",
    f"""{CUBE}, g AS (SELECT month, grp, round(sum(attempts) / sum(opportunities) * 100.0, 1) AS score, CAST(sum(opportunities) AS DOUBLE) AS hands FROM cube GROUP BY month, grp)
    SELECT month, round(sum(score * hands) / sum(hands), 4) AS score FROM g GROUP BY month""",
)
def monthly_scores(spark, sf_dir):
    return scorecard.monthly_scores(cube(spark, sf_dir)).withColumn("score", F.round("score", 4))


_MPOST = POST.replace("ren AS (SELECT ", "ren AS (SELECT month, ").replace("mg AS (SELECT stat_id,", "mg AS (SELECT month, stat_id,").replace("FROM ren GROUP BY stat_id)", "FROM ren GROUP BY month, stat_id)").replace(
    "pp AS (SELECT mg.stat_id,", "pp AS (SELECT mg.month, mg.stat_id,").replace("sg AS (SELECT subgroup,", "sg AS (SELECT month, subgroup,").replace("FROM psc GROUP BY subgroup)", "FROM psc GROUP BY month, subgroup)")


@query(
    "monthly_overall",
    f"""{_MPOST}, po AS (SELECT month, round(round(sum(s.score * v.w), 8), 1) AS score FROM sg s JOIN (VALUES ('Flop Cbet', 0.35), ('Vs Cbet', 0.20), ('vs Skipped Cbet', 0.10), ('Turn Play', 0.20), ('River play', 0.15)) v(subgroup, w) USING (subgroup) GROUP BY month),
    g AS (SELECT month, {_case('grp', REGROUPED)} AS grp, CAST(sum(opportunities) AS BIGINT) AS hands, round(sum(attempts) / sum(opportunities) * 100.0, 1) AS score FROM cube GROUP BY 1, 2),
    f AS (SELECT month, CASE WHEN grp IN ('nonko_9max', 'nonko_6max') THEN 'nonko' ELSE grp END AS family, round(round(sum(score * hands) / sum(hands), 8), 1) AS score, sum(hands) AS hands FROM g GROUP BY 1, 2)
    SELECT f.month, any_value(po.score) AS postflop, round(sum(f.score * hands) / sum(hands) * 0.8 + coalesce(any_value(po.score), 0) * 0.2, 6) AS overall FROM f LEFT JOIN po USING (month) GROUP BY f.month""",
)
def monthly_overall(spark, sf_dir):
    """The 80/20 blend of each month, with that month's post-flop score."""
    rows = sourced_cube(spark, sf_dir)
    post = rows.withColumn("player_sum", F.when(F.col("stat_id") == "EP_CBET_RIVER", F.col("opportunities") * 2))
    merged = cubes.merge_sources(post.withColumn("stat_id", _swap("stat_id", POST_NAMES)), ["month", "stat_id"])
    weights = scorecard.weights_frame(spark, "subgroup", targets.POSTFLOP_SUBGROUP_WEIGHTS)
    out = scorecard.monthly_overall(rows.withColumn("grp", _swap("grp", REGROUPED)), merged, scorecard.postflop_goals(spark), weights)
    return out.withColumn("overall", F.round("overall", 6))


@query(
    "pct_by_month_pivot",
    f"""{USABLE}, p AS (SELECT *, round(attempts / opportunities * 100.0, 2) AS pct FROM weighted)
    SELECT grp, stat_id, max(pct) FILTER (WHERE rank = 1) AS pct_1, max(pct) FILTER (WHERE rank = 2) AS pct_2, max(pct) FILTER (WHERE rank = 3) AS pct_3,
      round(sum(pct * weight) / sum(weight), 4) AS pct_weighted FROM p GROUP BY grp, stat_id""",
)
def pct_by_month_pivot(spark, sf_dir):
    rows = months.usable_months(cube(spark, sf_dir), ["grp", "stat_id"]).withColumn("pct", ratio_pct(F.col("attempts"), F.col("opportunities")))
    return reports.month_columns(rows, ["grp", "stat_id"]).withColumn("pct_weighted", F.round("pct_weighted", 4))


@query(
    "merged_months",
    f"""{CUBE}, {PICKED} SELECT grp, stat_id, CAST(sum(opportunities) AS BIGINT) AS opportunities, CAST(sum(attempts) AS BIGINT) AS attempts,
      round(sum(score * weight) / sum(weight) FILTER (WHERE score IS NOT NULL), 4) AS score,
      max(p) FILTER (WHERE rank = 1) AS pct_1, max(p) FILTER (WHERE rank = 2) AS pct_2, max(p) FILTER (WHERE rank = 3) AS pct_3
    FROM (SELECT cube.*, rank, weight, {_pct()} AS p, CASE WHEN opportunities >= 20 THEN {_pct()} END AS score FROM cube JOIN picked USING (month)) GROUP BY grp, stat_id""",
)
def merged_months(spark, sf_dir):
    rows = opportunities.with_percentage(cube(spark, sf_dir))
    rows = rows.withColumn("score", F.when(F.col("opportunities") >= 20, F.col("percentage")))
    return reports.merge_months(months.weigh_months(rows, SELECTED)).withColumn("score", F.round("score", 4))


SUBGROUP = """CASE WHEN regexp_matches(stat_id, 'RFI_|CO_STEAL|BTN_STEAL') THEN 'RFI' WHEN regexp_matches(stat_id, 'SB_UO|SB_STEAL|BB_FOLD_TO_SB|BB_RAISE_VS_SB') THEN 'BvB'
  WHEN contains(stat_id, 'FOLD_TO_3BET') THEN 'VS_3BET' WHEN contains(stat_id, '3BET') THEN '3BET_RANGE' WHEN contains(stat_id, 'FLOP_CBET') THEN 'FLOP_CBET'
  WHEN contains(stat_id, 'TURN_CBET') THEN 'TURN_PLAY' ELSE 'OTHER' END"""


@query(
    "stat_hierarchy",
    f"""{CARD} SELECT cube.month, cube.grp, cube.stat_id, opportunities, attempts, CAST(ideal AS DOUBLE) AS ideal, {SUBGROUP.replace('stat_id', 'cube.stat_id')} AS subgroup,
      CAST(ideal - 2 AS DOUBLE) AS ideal_low, CAST(ideal + 2 AS DOUBLE) AS ideal_high FROM cube LEFT JOIN ideals ON ideals.grp = cube.grp AND ideals.stat_id = cube.stat_id""",
)
def stat_hierarchy(spark, sf_dir):
    return reports.hierarchy(cube(spark, sf_dir), scorecard.ideals_frame(spark, IDEALS))


@query(
    "flat_report",
    f"""{CARD} SELECT month, cube.grp, {SUBGROUP.replace('stat_id', 'cube.stat_id')} AS subgroup, cube.stat_id, opportunities, attempts, {_pct()} AS pct, score_time_decay AS score,
      CASE WHEN score_time_decay IS NULL THEN 'Sem amostra' WHEN score_time_decay >= 90 THEN 'Excelente' WHEN score_time_decay >= 75 THEN 'Bom' WHEN score_time_decay >= 60 THEN 'OK' WHEN score_time_decay >= 40 THEN 'A ajustar' ELSE 'Crítico' END AS note
    FROM cube LEFT JOIN card ON card.grp = cube.grp AND card.stat_id = cube.stat_id WHERE month = (SELECT max(month) FROM cube)""",
)
def flat_report(spark, sf_dir):
    scores = _card(spark, sf_dir).select("grp", "stat_id", F.col("score_time_decay").alias("score"))
    return reports.flat_report(cube(spark, sf_dir), scores)


@query(
    "overview_grades",
    f"""{CARD}, {NEWEST.format(src='cube')}, r AS (SELECT grp, stat_id, round(sum(attempts * weight) / sum(opportunities * weight) * 100.0, 4) AS pct,
        CAST(floor(round(sum(attempts * weight), 8)) AS BIGINT) AS attempts, CAST(floor(round(sum(opportunities * weight), 8)) AS BIGINT) AS opportunities FROM cube JOIN newest USING (month) GROUP BY grp, stat_id)
    SELECT r.grp, r.stat_id, pct, attempts, opportunities, score_time_decay AS score,
      CASE WHEN score_time_decay IS NULL THEN '-' WHEN score_time_decay >= 90 THEN 'A' WHEN score_time_decay >= 80 THEN 'B' WHEN score_time_decay >= 70 THEN 'C' WHEN score_time_decay >= 60 THEN 'D' ELSE 'E' END AS grade
    FROM r LEFT JOIN card ON card.grp = r.grp AND card.stat_id = r.stat_id""",
)
def overview_grades(spark, sf_dir):
    rates = months.weighted_rate(cube(spark, sf_dir), ["grp", "stat_id"]).withColumn("pct", F.round("pct", 4))
    return reports.overview(rates, _card(spark, sf_dir).select("grp", "stat_id", F.col("score_time_decay").alias("score")))


@query(
    "latest_cube_file",
    f"""{CUBE}, parts AS (SELECT *, 0 AS f FROM cube UNION ALL SELECT month, grp, stat_id, opportunities + 1, attempts, 1 FROM cube WHERE month >= '1998-01')
    SELECT month, grp, stat_id, opportunities, attempts FROM parts WHERE f = (SELECT max(f) FROM parts q WHERE q.month = parts.month)""",
)
def latest_cube_file(spark, sf_dir):
    base = cube(spark, sf_dir)
    newer = base.where(F.col("month") >= "1998-01").withColumn("opportunities", F.col("opportunities") + 1)
    parts = base.withColumn("file_order", F.lit(0)).unionByName(newer.withColumn("file_order", F.lit(1)))
    return reports.latest_cube(parts)


@query(
    "top_stats",
    f"{CUBE} SELECT stat_id, CAST(sum(opportunities) AS BIGINT) AS hands FROM cube GROUP BY stat_id ORDER BY hands DESC, stat_id LIMIT 3",
)
def top_stats(spark, sf_dir):
    totals = cube(spark, sf_dir).groupBy("stat_id").agg(F.sum("opportunities").alias("hands"))
    return reports.top_stats(totals)


# --- checks ------------------------------------------------------------------------------


@query(
    "month_global_check",
    f"""{CUBE}, whole AS (SELECT grp, stat_id, CAST(sum(opportunities) AS BIGINT) + CASE WHEN stat_id = 'BTN_3BET' THEN 1 ELSE 0 END AS opportunities, CAST(sum(attempts) AS BIGINT) AS attempts FROM cube GROUP BY grp, stat_id)
    SELECT grp, stat_id, opportunities, attempts, opportunities - 1 AS opportunities_sum, attempts AS attempts_sum FROM whole WHERE stat_id = 'BTN_3BET'""",
)
def month_global_check(spark, sf_dir):
    rows = cube(spark, sf_dir)
    whole = cubes.add_up(rows, ["grp", "stat_id"])
    whole = whole.withColumn("opportunities", F.col("opportunities") + F.when(F.col("stat_id") == "BTN_3BET", 1).otherwise(0))
    return quality.monthly_against_global(rows, whole, ["grp", "stat_id"])


@query(
    "partition_diff",
    f"""WITH {ORDERS}, c AS (SELECT month, grp, count(*) AS n FROM oc GROUP BY month, grp)
    SELECT month, grp, n + 2 AS expected, n AS actual FROM c WHERE grp = 'BUILDING'
    UNION ALL SELECT '2030-01', 'BUILDING', 2, 0""",
)
def partition_diff(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumnRenamed("c_mktsegment", "grp")
    stored = rows.groupBy("month", "grp").agg(F.count(F.lit(1)).alias("hands"))
    off = stored.withColumn("hands", F.col("hands") + F.when(F.col("grp") == "BUILDING", 2).otherwise(0))
    ghost = off.where(F.col("grp") == "BUILDING").agg(F.lit("2030-01").alias("month"), F.max("grp").alias("grp"), F.lit(2).cast("bigint").alias("hands"))
    return quality.validate_partitions(off.unionByName(ghost), rows, ["month", "grp"])


@query(
    "expectation_check",
    f"""WITH {ORDERS} SELECT o_orderstatus AS name, count(*) + 1 AS expected, count(*) AS actual FROM oc GROUP BY o_orderstatus""",
)
def expectation_check(spark, sf_dir):
    rows = orders(spark, sf_dir).groupBy(F.col("o_orderstatus").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return quality.expectation_differences(rows, rows.withColumn("value", F.col("value") + 1))
