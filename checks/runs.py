"""Queries over run tables and hand records made from orders and line items."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.tables import table
from tallyhand.operators import cube as cubes
from tallyhand.operators import quality, records, reports
from tallyhand.sources.sinks import compiled_text

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


# hand records: an order is a hand, its priority the reason it may be discarded
RECORDS_SQL = """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS hand_id, o_orderkey, c_mktsegment AS file_id, r_name AS source,
       CASE o_orderpriority WHEN '5-LOW' THEN 'mystery' WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'cash_game' ELSE 'other' END END AS discard_reason,
       CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN NULL WHEN o_orderstatus = 'F' THEN 'nonko_9max' WHEN o_orderstatus = 'O' THEN 'nonko_6max' ELSE 'pko' END AS grp,
       CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE {month} END AS month
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
"""
DUCK_RECORDS = "WITH rec AS (" + RECORDS_SQL.format(month="strftime(o_orderdate, '%Y-%m')") + ")"


def hand_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("orders", "customer", "nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(RECORDS_SQL.format(month="date_format(o_orderdate, 'yyyy-MM')"))


_REASONS = ["mystery", "less_than_4_players", "tournament_summary", "cash_game", "invalid_format", "other"]


@query(
    "discard_rollup",
    f"""{DUCK_RECORDS}, c AS (SELECT CASE WHEN CAST(hand_id AS BIGINT) % 5 = 0 THEN 'other' ELSE discard_reason END AS reason, count(*) AS n FROM rec WHERE discard_reason IS NOT NULL GROUP BY 1),
    k(reason) AS (VALUES {', '.join(f"('{r}')" for r in _REASONS)}),
    f AS (SELECT k.reason, coalesce(n, 0) + CASE WHEN k.reason = 'other' THEN 5 ELSE 0 END AS hands FROM k LEFT JOIN c USING (reason))
    SELECT reason, hands FROM f UNION ALL SELECT 'total', CAST(sum(hands) AS BIGINT) FROM f""",
)
def discard_rollup(spark, sf_dir):
    dropped = hand_records(spark, sf_dir).where(F.col("discard_reason").isNotNull())
    # every fifth reason is missing
    counts = dropped.groupBy(F.when(F.col("hand_id").cast("bigint") % 5 != 0, F.col("discard_reason")).alias("reason")).agg(F.count(F.lit(1)).alias("hands"))
    # the supplied total is five higher than what the reasons explain
    supplied = counts.agg((F.sum("hands") + 5).alias("hands"))
    return cubes.discard_rollup(counts, supplied)


_CELLS = ", ".join(f"count(*) FILTER (WHERE discard_reason = '{r}') AS {r}" for r in _REASONS)


@query(
    "source_totals",
    f"{DUCK_RECORDS} SELECT source, count(*) AS total_hands, count(*) FILTER (WHERE discard_reason IS NULL) AS valid_hands, {_CELLS}, 0::BIGINT AS residual FROM rec GROUP BY source",
)
def source_totals(spark, sf_dir):
    return cubes.source_totals(hand_records(spark, sf_dir))


@query(
    "unexplained_totals",
    f"{DUCK_RECORDS} SELECT source, count(*) + 3 AS total_hands, count(*) FILTER (WHERE discard_reason IS NULL) AS valid_hands, {_CELLS}, 3::BIGINT AS residual FROM rec WHERE source = 'ASIA' GROUP BY source",
)
def unexplained_totals(spark, sf_dir):
    totals = cubes.source_totals(hand_records(spark, sf_dir))
    return quality.unexplained(totals.withColumn("total_hands", F.col("total_hands") + F.when(F.col("source") == "ASIA", 3).otherwise(0)))


@query(
    "global_samples",
    f"""{DUCK_RECORDS} SELECT CASE WHEN discard_reason IS NULL THEN 'group:' || grp ELSE 'discard:' || discard_reason END AS name, count(*) AS hands FROM rec GROUP BY 1
    UNION ALL SELECT 'group:postflop_all', count(*) FROM rec WHERE discard_reason IS NULL UNION ALL SELECT 'total', count(*) FROM rec""",
)
def global_samples(spark, sf_dir):
    return cubes.global_samples(hand_records(spark, sf_dir))


@query(
    "months_manifest",
    f"""{DUCK_RECORDS}, f AS (SELECT month, source, file_id, count(*) AS t, count(*) FILTER (WHERE discard_reason IS NULL) AS v FROM rec GROUP BY 1, 2, 3)
    SELECT CASE WHEN GROUPING(source) = 0 THEN 'detail' ELSE 'total' END AS level, month, source, count(*) AS files, CAST(sum(v) AS BIGINT) AS valid_hands, CAST(sum(t) AS BIGINT) AS total_hands FROM f GROUP BY GROUPING SETS ((month, source), (month))""",
)
def months_manifest(spark, sf_dir):
    return cubes.months_manifest(hand_records(spark, sf_dir))


@query(
    "hands_per_month",
    f"{DUCK_RECORDS} SELECT coalesce(month, 'unknown') AS month, count(*) AS hands FROM rec GROUP BY 1",
)
def hands_per_month(spark, sf_dir):
    return cubes.hands_per_month(hand_records(spark, sf_dir), missing="unknown")


@query(
    "merge_runs",
    f"""{DUCK_RECORDS}, runs AS (SELECT 0 AS run, * FROM rec WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 1, * REPLACE ('late' AS source) FROM rec WHERE o_orderkey % 3 <> 1)
    SELECT hand_id, run, source, month, grp FROM (SELECT *, row_number() OVER (PARTITION BY hand_id ORDER BY run, file_id, o_orderkey) AS rn FROM runs WHERE month IS NULL OR month IN ('1996-01', '1996-02')) WHERE rn = 1""",
)
def merge_runs(spark, sf_dir):
    rows = hand_records(spark, sf_dir).withColumn("hand_index", F.col("o_orderkey"))
    k = F.col("o_orderkey") % 3
    merged = records.merge_runs([rows.where(k != 0), rows.where(k != 1).withColumn("source", F.lit("late"))], ["1996-01", "1996-02"])
    return merged.select("hand_id", "run", "source", "month", "grp")


@query(
    "class_conflicts",
    "WITH p AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_returnflag <> 'N') SELECT CAST(l_orderkey AS VARCHAR) AS hand_id, count(*) AS buckets FROM p GROUP BY 1 HAVING count(*) > 1",
)
def class_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("hand_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("grp")
    )
    return quality.class_conflicts(rows)


@query(
    "sums_within_total",
    f"{DUCK_RECORDS} SELECT unnest(['total', 'classes', 'months']) AS sum_over, count(*) AS hands FROM rec WHERE discard_reason IS NULL",
)
def sums_within_total(spark, sf_dir):
    return quality.sums_within_total(hand_records(spark, sf_dir).where(F.col("discard_reason").isNull()))


@query(
    "month_id_report",
    """WITH m AS (SELECT DISTINCT l_orderkey AS hand_id, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem), g AS (SELECT o_orderkey AS hand_id FROM orders WHERE o_orderkey % 10 <> 3)
    SELECT 'duplicate_ids' AS "check", count(*) AS ids FROM (SELECT hand_id FROM m GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'extra_ids', count(DISTINCT hand_id) FROM m WHERE hand_id NOT IN (SELECT hand_id FROM g)
    UNION ALL SELECT 'monthly_ids', count(DISTINCT hand_id) FROM m UNION ALL SELECT 'global_ids', count(DISTINCT hand_id) FROM g""",
)
def month_id_report(spark, sf_dir):
    monthly = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hand_id"), F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    known = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 10 != 3).select(F.col("o_orderkey").alias("hand_id"))
    return quality.month_id_report(monthly, known)


# --- runs --------------------------------------------------------------------------------------

RUNS = """WITH runs AS (SELECT o_orderkey AS run_id, o_custkey AS user_id, o_orderdate AS created_at, CAST(floor(o_totalprice) AS BIGINT) AS hands,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status FROM orders)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"),
        F.floor("o_totalprice").cast("bigint").alias("hands"), status.alias("status"),
    )


@query(
    "run_summary",
    f"""{RUNS} SELECT run_id, user_id, strftime(created_at, '%Y-%m-%d') AS day, hands, status, count(DISTINCT l_linenumber) AS unique_stats, CAST(sum(l_quantity) AS DOUBLE) AS total_opportunities
    FROM runs LEFT JOIN lineitem ON l_orderkey = run_id GROUP BY run_id, user_id, created_at, hands, status""",
)
def run_summary(spark, sf_dir):
    details = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stat_id"), F.col("l_quantity").alias("opportunities")
    )
    out = reports.run_details(runs(spark, sf_dir), details)
    return out.select("run_id", "user_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"), "hands", "status", "unique_stats", "total_opportunities")


@query(
    "newest_runs",
    f"{RUNS} SELECT run_id, user_id, strftime(created_at, '%Y-%m-%d') AS day, hands, status FROM runs WHERE status = 'completed' ORDER BY created_at DESC, run_id DESC LIMIT 20",
)
def newest_runs(spark, sf_dir):
    out = reports.newest_runs(runs(spark, sf_dir), 20, "completed")
    return out.select("run_id", "user_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"), "hands", "status")


@query(
    "user_summary",
    f"""{RUNS} SELECT user_id, count(*) AS runs, CAST(sum(hands) AS BIGINT) AS hands, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
      strftime(max(created_at), '%Y-%m-%d') AS last_day, arg_max(run_id, (created_at, run_id)) AS last_run_id FROM runs GROUP BY user_id""",
)
def user_summary(spark, sf_dir):
    out = reports.user_summary(runs(spark, sf_dir))
    return out.select("user_id", "runs", "hands", "completed", "failed", F.date_format("last_run_at", "yyyy-MM-dd").alias("last_day"), "last_run_id")


# --- wide report -------------------------------------------------------------------------------

# sheets: one row per customer nation, cells as text with decimal commas
@query(
    "wide_report",
    """WITH s AS (SELECT c_nationkey::VARCHAR AS room, count(*) AS n, round(count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 4) AS a,
        round(count(*) FILTER (WHERE o_orderpriority = '2-HIGH') / CAST(count(*) AS DOUBLE), 4) AS b, round(count(*) FILTER (WHERE o_orderstatus = 'P') / CAST(count(*) AS DOUBLE), 4) AS c
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
    t AS (SELECT room, n, replace(CAST(round(CAST(a * 100 AS DECIMAL(18, 8)), 1)::DECIMAL(18, 1) AS VARCHAR), '.', ',') AS pa, replace(CAST(round(CAST(b * 100 AS DECIMAL(18, 8)), 1)::DECIMAL(18, 1) AS VARCHAR), '.', ',') AS pb, replace(CAST(round(CAST(c * 100 AS DECIMAL(18, 8)), 1)::DECIMAL(18, 1) AS VARCHAR), '.', ',') AS pc, replace(CAST(round(CAST((a + b) * 100 AS DECIMAL(18, 8)), 1)::DECIMAL(18, 1) AS VARCHAR), '.', ',') AS pv, replace(printf('%.4f', a), '.', ',') AS raw FROM s)
    SELECT room, n::VARCHAR AS "9MAX_Total Hands", pa AS "9MAX_EP 3Bet", pb AS "9MAX_EP Cold Call", pv AS "9MAX_EP VPIP", pc AS "9MAX_BB Fold to BTN Steal", pb AS "9MAX_BB Fold to SB Steal (Dup)", pb AS "9MAX_BB Fold to SB Steal",
      n::VARCHAR AS "PKO_Total Hands", pc AS "PKO_Early UO VPIP", pa AS "PKO_EP 3Bet", raw AS "POSTFLOP_River Agg", pc AS "POSTFLOP_WTSD" FROM t""",
)
def wide_report(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = F.count(F.lit(1))
    share = lambda cond: F.replace(F.format_string("%.4f", F.round(F.sum(F.when(cond, 1).otherwise(0)) / n, 4)), F.lit("."), F.lit(","))
    rows = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").cast("string").alias("room")).agg(
        n.cast("string").alias("n"), share(F.col("o_orderstatus") == "F").alias("a"), share(F.col("o_orderpriority") == "2-HIGH").alias("b"), share(F.col("o_orderstatus") == "P").alias("c")
    )
    sheets = {
        "9MAX": rows.select("room", F.col("n").alias("Total Hands"), F.col("c").alias("Early UO VPIP"), F.col("a").alias("EP 3Bet"), F.col("b").alias("EP Cold Call"), F.col("c").alias("BB Fold to BTN Steal"), F.col("b").alias("BB Fold to SB Steal")),
        "PKO": rows.select("room", F.col("a").alias("Early RFI"), F.col("a").alias("EP 3Bet"), F.col("c").alias("Early UO VPIP"), F.col("n").alias("Total Hands")),
        "POSTFLOP": rows.select("room", F.col("a").alias("River Agg"), F.col("c").alias("WTSD")),
    }
    return reports.wide_merge(sheets, key="room")


@query(
    "compiled_text",
    "SELECT lang AS class, '=== ' || source || '-' || doc_id || ' ===' || chr(10) || text || chr(10) || chr(10) AS value FROM documents",
)
def compiled_class_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("name", F.concat_ws("-", "source", "doc_id"))
    return compiled_text(docs, "lang", "name", "text")
