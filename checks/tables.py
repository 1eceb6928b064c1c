"""Inputs: the given tables, and hands derived from the ``events`` table.

The derivation is written as SQL that reads the same in Spark and in DuckDB, so
the query and its oracle start from the same rows. A hand is twelve consecutive
events (``event_id`` is the key of that table), so hands stay small however large
the table grows, and every event is an action of exactly one hand.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


# one row per event with its hand number, place in the hand and the hand's shape
SLOTS_SQL = """
SELECT event_id, ts, user_id, event_type, value,
       CAST(floor(event_id / 12) AS BIGINT) AS h,
       CAST(event_id % 12 AS INT) AS slot,
       CAST(2 + CAST(floor(event_id / 12) AS BIGINT) % 8 AS INT) AS n
FROM events
"""

SEATS_SQL = f"""
SELECT *,
       CAST(floor(h / 8) AS BIGINT) % n + 1 AS hero_seat,
       CASE WHEN slot < 5 OR h % 7 = 0 THEN 'preflop'
            WHEN slot < 8 OR h % 11 = 0 THEN 'flop'
            WHEN slot < 10 OR h % 5 = 0 THEN 'turn'
            ELSE 'river' END AS street
FROM ({SLOTS_SQL}) s
"""

ACTS_SQL = f"""
SELECT h, slot, n, event_id, ts, user_id, street, hero_seat, seat,
       'p' || CAST(hero_seat AS VARCHAR(4)) AS hero,
       'p' || CAST(seat AS VARCHAR(4)) AS actor,
       CASE WHEN street = 'preflop' THEN
              CASE WHEN h % 4 = 1 AND slot = 0 THEN 'POST_SB'
                   WHEN h % 4 = 1 AND slot = 1 THEN 'POST_BB'
                   WHEN event_type = 'error' THEN 'FOLD'
                   WHEN seat = hero_seat OR seat = hero_seat % n + 1 THEN
                     CASE WHEN event_type IN ('view', 'signup') THEN 'CALL'
                          WHEN event_type = 'click' THEN CASE WHEN value >= 30 THEN 'RERAISE' ELSE 'RAISE' END
                          WHEN value < 2 THEN 'ALLIN' WHEN value < 5 THEN 'CHECK' ELSE 'RAISE' END
                   WHEN event_type = 'signup' AND value < 12 THEN 'CALL'
                   WHEN event_type = 'click' AND value < 12 THEN 'RAISE'
                   ELSE 'FOLD' END
            ELSE CASE event_type WHEN 'error' THEN 'FOLD' WHEN 'view' THEN 'CHECK' WHEN 'signup' THEN 'CALL'
                   WHEN 'click' THEN 'BET' ELSE CASE WHEN value < 3 THEN 'ALLIN' ELSE 'RAISE' END END
       END AS type,
       value AS amount,
       CASE WHEN event_type IN ('click', 'purchase') AND street = 'preflop' AND event_id % 2 = 0
            THEN value + 4 END AS to_amount
FROM (SELECT *, CASE WHEN street = 'preflop' THEN (hero_seat - 1 - h % 4 + slot + 8 * n) % n + 1
                     WHEN (slot + h) % 2 = 0 THEN hero_seat
                     ELSE hero_seat % n + 1 END AS seat
      FROM ({SEATS_SQL}) t) u
"""

# one row per hand
HANDS_SQL = f"""
SELECT h, n, hero_seat,
       'p' || CAST(hero_seat AS VARCHAR(4)) AS hero,
       CAST(floor(h / 3) AS BIGINT) % n + 1 AS button_seat,
       CASE WHEN h % 9 = 4 THEN NULL WHEN n <= 6 THEN 6 ELSE 9 END AS table_max,
       CASE h % 6 WHEN 0 THEN 'pokerstars' WHEN 1 THEN 'gg' WHEN 2 THEN 'wpn' WHEN 3 THEN 'winamax'
                  WHEN 4 THEN '888' ELSE 'other' END AS site,
       CASE WHEN h % 13 = 0 THEN NULL ELSE 'T' || CAST(h % 40 AS VARCHAR(4)) END AS tournament_id,
       CASE h % 10 WHEN 0 THEN '/in/pko/f' WHEN 1 THEN '/in/mystery/f' WHEN 2 THEN '/in/bounty-f'
                   WHEN 3 THEN '/in/non-ko/bounty-f' ELSE '/in/f' END || CAST(h % 100 AS VARCHAR(4)) AS file_id,
       min(ts) AS first_ts,
       CAST(h % 6 AS INT) AS month_shift,
       h % 3 = 0 AS hero_won,
       h % 2 = 0 AS shown,
       max(CASE WHEN street = 'preflop' AND type = 'ALLIN' THEN 1 ELSE 0 END) = 1 AS any_allin
FROM ({ACTS_SQL}) a
GROUP BY h, n, hero_seat
"""

STACK_RULE = "20 * (1 + ({h} * 3 + {seat} * 7) % 25)"

# names that got cards: everybody who acts before the flop, the hero and the next seat
DEALT_SQL = f"""
SELECT DISTINCT h, seat, 'p' || CAST(seat AS VARCHAR(4)) AS name FROM (
  SELECT h, seat FROM ({ACTS_SQL}) a WHERE street = 'preflop'
  UNION ALL SELECT h, hero_seat FROM ({ACTS_SQL}) a
  UNION ALL SELECT h, hero_seat % n + 1 FROM ({ACTS_SQL}) a) d
"""

# one row per hand and seat: every third hand lists the empty-handed seats too
SEATED_SQL = f"""
SELECT hd.h, hd.n, hd.hero, hd.button_seat, s.seat, 'p' || CAST(s.seat AS VARCHAR(4)) AS name,
       CAST({STACK_RULE.format(h='hd.h', seat='s.seat')} AS DOUBLE) AS stack
FROM ({HANDS_SQL}) hd
JOIN (SELECT 1 AS seat UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5
      UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9) s
  ON s.seat <= hd.n
LEFT JOIN ({DEALT_SQL}) d ON d.h = hd.h AND d.seat = s.seat
WHERE hd.h % 3 = 0 OR d.seat IS NOT NULL
"""

# The same hands for DuckDB, as a chain of named subqueries for a WITH clause.
DUCK_HANDS = f"""
acts AS MATERIALIZED ({ACTS_SQL}),
hd0 AS ({HANDS_SQL}),
hd AS MATERIALIZED (
  SELECT *, first_ts + to_months(month_shift) AS hand_ts,
         strftime(timezone('Europe/Lisbon', timezone('UTC', date_trunc('second', first_ts + to_months(month_shift)))), '%Y-%m') AS month
  FROM hd0),
dealt AS MATERIALIZED ({DEALT_SQL}),
seated AS MATERIALIZED ({SEATED_SQL})
"""


def hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hands in the library's HAND shape, plus the hand number ``h``."""
    views(spark, sf_dir, "events")
    acts = spark.sql(ACTS_SQL)
    step = F.struct(
        "slot",
        "street",
        "seat",
        F.struct(
            "actor", "type", "amount", "to_amount",
            (F.col("type") == "ALLIN").alias("allin"), F.col("slot").alias("raw_offset"),
        ).alias("action"),
    )
    # twelve actions per hand by construction of ``h``, so the lists are bounded
    per_hand = (
        acts.groupBy("h", "n", "hero_seat", "hero")
        .agg(
            F.min("ts").alias("first_ts"),
            F.array_sort(F.collect_list(step)).alias("steps"),
            F.max((F.col("street") == "preflop") & (F.col("type") == "ALLIN")).alias("any_allin_preflop"),
        )
        .withColumn("h3", F.floor(F.col("h") / 3))
        .withColumn(
            "dealt",
            F.expr(
                "array_sort(array_distinct(transform(concat(array(hero_seat, hero_seat % n + 1),"
                " transform(filter(steps, x -> x.street = 'preflop'), x -> x.seat)), s -> CAST(s AS INT))))"
            ),
        )
    )

    def street(name: str):
        mine = F.filter("steps", lambda x: x["street"] == name)
        return F.struct(
            F.transform(mine, lambda x: x["action"]).alias("actions"),
            F.lit(None).cast("array<string>").alias("board"),
        ).alias(name)

    shown = F.struct(
        F.expr(
            "CASE WHEN h % 2 = 0 THEN array(named_struct('actor', hero, 'type', 'SHOW', 'amount', CAST(NULL AS DOUBLE),"
            " 'to_amount', CAST(NULL AS DOUBLE), 'allin', false, 'raw_offset', 12)) END"
        ).alias("actions"),
        F.lit(None).cast("array<string>").alias("board"),
    ).alias("showdown")
    hand_ts = F.expr("first_ts + make_ym_interval(0, CAST(h % 6 AS INT))")
    return per_hand.select(
        "h",
        F.expr(
            "CASE h % 6 WHEN 0 THEN 'pokerstars' WHEN 1 THEN 'gg' WHEN 2 THEN 'wpn' WHEN 3 THEN 'winamax'"
            " WHEN 4 THEN '888' ELSE 'other' END"
        ).alias("site"),
        F.expr("CASE WHEN h % 13 = 0 THEN NULL ELSE 'T' || CAST(h % 40 AS STRING) END").alias("tournament_id"),
        F.lit(None).cast("string").alias("tournament_name"),
        F.lit(None).cast("string").alias("tourney_class"),
        F.expr(
            "CASE h % 10 WHEN 0 THEN '/in/pko/f' WHEN 1 THEN '/in/mystery/f' WHEN 2 THEN '/in/bounty-f'"
            " WHEN 3 THEN '/in/non-ko/bounty-f' ELSE '/in/f' END || CAST(h % 100 AS STRING)"
        ).alias("file_id"),
        F.date_format(hand_ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"),
        F.lit(None).cast("string").alias("month"),
        (F.col("h3") % F.col("n") + 1).cast("int").alias("button_seat"),
        F.expr("CASE WHEN h % 9 = 4 THEN NULL WHEN n <= 6 THEN 6 ELSE 9 END").alias("table_max"),
        F.create_map(F.lit("sb"), F.lit(2.0), F.lit("bb"), F.lit(4.0), F.lit("ante"), F.lit(0.5)).alias("blinds"),
        F.expr(
            "transform(filter(sequence(1, n), s -> h % 3 = 0 OR array_contains(dealt, s)), s -> named_struct("
            "'seat', s, 'name', 'p' || CAST(s AS STRING),"
            f" 'stack_chips', CAST({STACK_RULE.format(h='h', seat='s')} AS DOUBLE), 'is_hero', s = hero_seat))"
        ).alias("players"),
        F.expr("transform(dealt, s -> 'p' || CAST(s AS STRING))").alias("players_dealt_in"),
        "hero",
        F.struct(*[street(s) for s in ["preflop", "flop", "turn", "river"]], shown).alias("streets"),
        "any_allin_preflop",
        F.expr("CASE WHEN h % 3 = 0 THEN array(hero) ELSE array('p0') END").alias("winners"),
        F.create_map(F.lit("hand_start"), F.col("h").cast("int")).alias("raw_offsets"),
    )
