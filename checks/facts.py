"""Queries over per-hand facts derived from the events table, with their oracles."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import duck, tables
from tallyhand.functions import seats, tourney
from tallyhand.operators import classify, cube as cubes, derive, quality, records, reports, segments
from tallyhand.plans import catalogue, opportunities

QUERIES, ORACLES = {}, {}
STREETS = ["flop", "turn", "river"]


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.derive_facts(tables.hands(spark, sf_dir))


def preflop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the steps a pre-flop question needs."""
    df = derive.with_words(derive.with_actors(tables.hands(spark, sf_dir)))
    return derive.with_preflop(df)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opportunities.with_month_and_groups(facts(spark, sf_dir))


def per_street(df: DataFrame, cols: dict[str, str], streets=STREETS) -> DataFrame:
    """One row per hand and street; ``{s}`` in a column name stands for the street."""
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("street"), *[F.col(c.format(s=s)).alias(k) for k, c in cols.items()])
            for s in streets
        ]
    )
    return df.select("h", F.inline(rows))


def _duck_streets(cols: dict[str, str], streets=STREETS) -> str:
    return duck.WITH_FACTS + " UNION ALL ".join(
        f" SELECT h, '{s}' AS street, " + ", ".join(f"{c.format(s=s)} AS {k}" for k, c in cols.items()) + " FROM facts"
        for s in streets
    )


def street_query(name: str, cols: dict[str, str], streets=STREETS) -> None:
    """A fact family compared row by row for every hand and street."""
    QUERIES[name] = lambda spark, sf_dir: per_street(facts(spark, sf_dir), cols, streets)
    ORACLES[name] = _duck_streets(cols, streets)


def column_query(name: str, cols: list[str], source=facts, prelude: str | None = None, relation: str = "facts") -> None:
    QUERIES[name] = lambda spark, sf_dir: source(spark, sf_dir).select("h", *cols)
    ORACLES[name] = (prelude or duck.WITH_FACTS) + f" SELECT h, {', '.join(cols)} FROM {relation}"


# --- positions -----------------------------------------------------------------------


@query("seat_positions", duck.WITH_POSITIONS + " SELECT h, name, pos FROM pos WHERE pos IS NOT NULL")
def seat_positions(spark, sf_dir):
    hands = tables.hands(spark, sf_dir)
    return hands.select("h", F.inline(seats.named_positions(F.col("players"), F.col("button_seat"))))


@query(
    "position_bucket",
    duck.WITH_POSITIONS
    + """ SELECT h, name, pos, CASE WHEN pos IN ('EP', 'EP2') THEN 'EP' WHEN pos IN ('MP', 'MP1', 'MP2', 'MP3') THEN 'MP'
          WHEN pos IN ('CO', 'BTN') THEN 'LP' END AS bucket FROM pos WHERE pos IS NOT NULL""",
)
def position_bucket(spark, sf_dir):
    return seat_positions(spark, sf_dir).withColumn("bucket", seats.bucket_of(F.col("pos")))


@query(
    "seat_names_alternative",
    duck.WITH_POSITIONS
    + f""", other(n, idx, pos2) AS (VALUES {duck.values(duck.OTHER_NAMES)})
    SELECT r.h, r.name, o.pos2 AS pos FROM seat_rank r JOIN other o ON o.n = r.np AND o.idx = r.idx""",
)
def seat_names_alternative(spark, sf_dir):
    hands = tables.hands(spark, sf_dir)
    return hands.select("h", F.inline(seats.named_positions(F.col("players"), F.col("button_seat"), seats.NAMED_SEATS)))


@query(
    "actor_position",
    duck.WITH_POSITIONS + " SELECT p.pos, a.type, count(*) AS actions FROM acts a JOIN pos p ON p.h = a.h AND p.name = a.actor GROUP BY p.pos, a.type",
)
def actor_position(spark, sf_dir):
    hands = tables.hands(spark, sf_dir)
    pos = seats.named_positions(F.col("players"), F.col("button_seat"))
    acts = F.flatten(F.array(*[F.col(f"streets.{s}.actions") for s in ["preflop", *STREETS]]))
    rows = hands.select(pos.alias("positions"), acts.alias("acts"))
    at = F.transform("acts", lambda a: F.struct(seats.position_of(F.col("positions"), a["actor"]).alias("pos"), a["type"].alias("type")))
    return (
        rows.select(F.inline(at)).where(F.col("pos").isNotNull()).groupBy("pos", "type").agg(F.count(F.lit(1)).alias("actions"))
    )


# --- before the flop -----------------------------------------------------------------------

_PRE = ("pf", duck.WITH_PREFLOP)
for _name, _cols in {
    "vpip_flag": ["hero_vpip"],
    "unopened_pot": ["unopened_pot", "has_limper_before_hero"],
    "raise_sequence": ["open_raiser", "three_bettor", "four_bettor", "hero_is_three_bettor"],
    "pot_type": ["pot_type"],
    "three_bet_reply": ["faced_3bet", "folded_to_3bet"],
    "squeeze": ["is_squeeze"],
    "resteal_freeplay": ["is_resteal_vs_btn", "freeplay_bb"],
}.items():
    column_query(_name, _cols, preflop, duck.WITH_PREFLOP, "pf")


@query(
    "first_in",
    duck.WITH_PREFLOP + " SELECT h, unopened_pot AND leads AS hero_raised_first_in, NOT unopened_pot AND leads AND any_limp AS is_isoraiser FROM pf",
)
def first_in(spark, sf_dir):
    return preflop(spark, sf_dir).select("h", "hero_raised_first_in", "is_isoraiser")


# pot size: the same fold over actions, as a recursive walk
_POT = (
    duck.BASE
    + """, ordered AS (SELECT h, actor, type, amount, coalesce(to_amount, 0) AS to_amount, row_number() OVER (PARTITION BY h ORDER BY slot) AS i FROM acts WHERE street = 'preflop'),
    posts AS (SELECT h, sum(amount) AS pot FROM ordered WHERE type IN ('POST_SB', 'POST_BB', 'POST_ANTE') GROUP BY h),
    posted AS (SELECT h, map_from_entries(list((actor, total) ORDER BY actor)) AS put FROM (
        SELECT h, actor, sum(amount) AS total FROM ordered WHERE type IN ('POST_SB', 'POST_BB', 'POST_ANTE') GROUP BY h, actor) GROUP BY h),
    start AS (SELECT hd.h, coalesce(nullif(p.pot, 0), 2.0 + 4.0 + 0.5 * (SELECT count(*) FROM dealt d WHERE d.h = hd.h)) AS pot, 4.0::DOUBLE AS price,
        coalesce(q.put, MAP {}::MAP(VARCHAR, DOUBLE)) AS put FROM hd LEFT JOIN posts p USING (h) LEFT JOIN posted q USING (h)),
    walk AS MATERIALIZED (
      WITH RECURSIVE w AS (
        SELECT h, 0::BIGINT AS i, pot::DOUBLE AS pot, price, put FROM start
        UNION ALL
        SELECT w.h, o.i,
          CASE WHEN o.type = 'CALL' THEN w.pot + greatest(coalesce(w.put[o.actor], 0), w.price) - coalesce(w.put[o.actor], 0)
               WHEN o.type IN ('RAISE', 'RERAISE', 'ALLIN') AND o.to_amount > 0 THEN w.pot + greatest(0, o.to_amount - coalesce(w.put[o.actor], 0))
               WHEN o.type IN ('RAISE', 'RERAISE', 'ALLIN') AND o.amount <> 0 THEN w.pot + o.amount ELSE w.pot END,
          CASE WHEN o.type IN ('RAISE', 'RERAISE', 'ALLIN') AND o.to_amount > 0 THEN o.to_amount
               WHEN o.type IN ('RAISE', 'RERAISE', 'ALLIN') AND o.amount <> 0 THEN coalesce(w.put[o.actor], 0) + o.amount ELSE w.price END,
          CASE WHEN o.type = 'CALL' THEN map_concat(w.put, MAP {o.actor: greatest(coalesce(w.put[o.actor], 0), w.price)})
               WHEN o.type IN ('RAISE', 'RERAISE', 'ALLIN') AND o.to_amount > 0 THEN map_concat(w.put, MAP {o.actor: o.to_amount})
               WHEN o.type IN ('RAISE', 'RERAISE', 'ALLIN') AND o.amount <> 0 THEN map_concat(w.put, MAP {o.actor: coalesce(w.put[o.actor], 0) + o.amount}) ELSE w.put END
        FROM w JOIN ordered o ON o.h = w.h AND o.i = w.i + 1)
      SELECT h, arg_max(pot, i) AS pot FROM w GROUP BY h)
    SELECT h, CAST(round(CAST(round(pot, 8) / 4.0 AS DECIMAL(24, 8)), 2) AS DOUBLE) AS pot_size_bb FROM walk"""
)


@query("pot_size", _POT)
def pot_size(spark, sf_dir):
    return preflop(spark, sf_dir).select("h", "pot_size_bb")


# --- players and stacks -----------------------------------------------------------------------

street_query("players_per_street", {"players": "players_to_{s}", "heads_up": "heads_up_{s}"})
street_query("in_position", {"hero_ip": "hero_ip_{s}"})
column_query("effective_stack", ["eff_stack_srp", "eff_stack_vs_3bet"])
column_query(
    "opponent_stacks",
    ["hero_stack_bb", "avg_stacks_after_hero_bb", "raiser_stack_bb", "three_bettor_stack_bb", "squeeze_avg_stack_bb", "bvb_villain_stack_bb"],
)


@query(
    "stack_rule_average",
    duck.WITH_FACTS
    + """ SELECT h, coalesce(hero_stack_bb >= 16, false) AND coalesce(avg_stacks_after_hero_bb >= 16, true) AS open_ok,
      coalesce(hero_stack_bb >= 16, false) AND coalesce(raiser_stack_bb >= 16, false) AS defend_ok,
      coalesce(hero_stack_bb >= 16, false) AND coalesce(squeeze_avg_stack_bb >= 16, false) AS squeeze_ok,
      coalesce(hero_stack_bb >= 16, false) AND coalesce(three_bettor_stack_bb >= 16, false) AS fold3_ok,
      coalesce(hero_stack_bb >= 16, false) AND coalesce(bvb_villain_stack_bb >= 16, false) AS blinds_ok FROM facts""",
)
def stack_rule_average(spark, sf_dir):
    ok = derive.stack_rules()
    return facts(spark, sf_dir).select("h", *[col.alias(name) for name, col in ok.items()])


# --- after the flop ---------------------------------------------------------------------------

SIDES = ("ip", "oop")
column_query("preflop_aggressor", ["pfr_player"], lambda s, d: derive.with_actors(tables.hands(s, d)), duck.WITH_PREFLOP, "(SELECT h, pfr AS pfr_player FROM pf)")
street_query("cbet", {f"{k}_{x}": f"cbet_{{s}}_{k}_{x}" for k in ("opp", "att") for x in SIDES})
street_query("vs_cbet", {f"{k}_{x}": f"vs_cbet_{{s}}_{k}_{x}" for k in ("fold", "call", "raise") for x in SIDES})
street_query("probe", {f"{k}_{x}": f"probe_{{s}}_{k}_{x}" for k in ("opp", "att") for x in SIDES}, ["turn", "river"])
street_query("donk", {"opp": "donk_{s}_opp", "att": "donk_{s}_att"})
street_query("check_raise", {"opp": "xr_{s}_opp", "att": "xr_{s}_att"})
street_query("missed_cbet", {f"{k}_{x}": f"bet_vs_missed_{{s}}_{k}_{x}" for k in ("opp", "att") for x in SIDES})
street_query("delayed_cbet", {f"{k}_{x}": f"delayed_cbet_{{s}}_{k}_{x}" for k in ("opp", "att") for x in SIDES}, ["turn", "river"])
street_query("aggression_pct", {"saw": "saw_{s}", "agg_pct": "agg_pct_{s}"})
column_query("showdown", ["saw_showdown", "won_showdown", "won_when_saw_flop"])
column_query("fold_vs_check_raise", ["fold_vs_check_raise_opp", "fold_vs_check_raise_att"])
column_query("river_bets", ["river_bet_srp_opp", "river_bet_srp_att", "w_sd_b_river_opp", "w_sd_b_river_att"])


@query("enriched_hands", duck.WITH_FACTS + " SELECT h, hero_position, pot_type, hero_ip_flop, hero_stack_bb, any_allin_preflop, donk_flop, river_agg_pct FROM facts")
def enriched_hands(spark, sf_dir):
    nested = derive.enrich_hands(tables.hands(spark, sf_dir))
    return derive.hand_context(nested).select(
        "h", "hero_position", "pot_type", "hero_ip_flop", "hero_stack_bb", "any_allin_preflop", "donk_flop", "river_agg_pct"
    )


# --- groups and the catalogue -----------------------------------------------------------------------


@query("hand_groups", duck.WITH_FACTS + " SELECT h, month, grp FROM labelled")
def hand_groups(spark, sf_dir):
    return labelled(spark, sf_dir).select("h", "month", F.explode("groups").alias("grp"))


_KEYS = {
    "hero": "hero", "site": "site", "tournament_id": "coalesce(tournament_id, 'cash_game')", "pot_type": "pot_type",
    "stake_level": "'mid'", "table_size": "CASE WHEN table_max IS NULL THEN 'unknown' ELSE table_max::VARCHAR || 'max' END",
    "position": """CASE WHEN hero_position IS NULL THEN 'no_position' WHEN hero_position IN ('EP', 'EP2') THEN 'early' WHEN hero_position IN ('MP', 'MP1', 'MP2') THEN 'middle'
        WHEN hero_position IN ('CO', 'BTN') THEN 'late' WHEN hero_position IN ('SB', 'BB') THEN 'blinds' ELSE lower(hero_position) END""",
}


@query(
    "group_keys",
    duck.WITH_FACTS + " UNION ALL ".join(f" SELECT '{k}' AS field, {sql} AS key, count(*) AS hands FROM facts GROUP BY 2" for k, sql in _KEYS.items()),
)
def group_keys(spark, sf_dir):
    df = facts(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), tourney.group_key(k, df.columns).alias("key")) for k in _KEYS])
    return df.select(F.inline(pairs)).groupBy("field", "key").agg(F.count(F.lit(1)).alias("hands"))


@query("enriched_catalogue_counts", duck.WITH_FACTS + duck.catalogue_sql(catalogue.catalogue(by_seat=True)))
def enriched_catalogue_counts(spark, sf_dir):
    return opportunities.count_hands(labelled(spark, sf_dir), catalogue.catalogue(by_seat=True))


@query("literal_catalogue_counts", duck.WITH_FACTS + duck.catalogue_sql(catalogue.catalogue()))
def literal_catalogue_counts(spark, sf_dir):
    return opportunities.count_hands(labelled(spark, sf_dir), catalogue.catalogue())


_POSTFLOP = ["POST_CBET_FLOP_IP", "POST_CBET_FLOP_OOP", "POST_DONK_FLOP", "POST_XR_FLOP"]


def _hits(spark, sf_dir):
    return opportunities.stat_hits(labelled(spark, sf_dir).withColumn("hand_id", F.col("h").cast("string")), catalogue.catalogue(by_seat=True))


def _hits_sql() -> str:
    parts = []
    for m in catalogue.catalogue(by_seat=True):
        opp, att = duck.metric_sql(m)
        for kind, test in (("opps", opp), ("attempts", att)):
            parts.append(f"SELECT month, grp, '{m['id']}' AS stat_id, '{kind}' AS kind, h::VARCHAR AS hand_id FROM labelled WHERE {test}")
    return duck.WITH_FACTS + ", hits AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


@query("stat_hits", _hits_sql() + " SELECT * FROM hits")
def stat_hits(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(
    "distinct_hands",
    _hits_sql()
    + f""" SELECT grp, count(DISTINCT hand_id) AS hand_count, count(DISTINCT hand_id) FILTER (WHERE stat_id IN ({', '.join(repr(s) for s in _POSTFLOP)})) AS postflop_hands_count
    FROM hits GROUP BY grp""",
)
def distinct_hands(spark, sf_dir):
    hands = labelled(spark, sf_dir).withColumn("hand_id", F.col("h").cast("string"))
    return cubes.distinct_counted(opportunities.counted_hands(hands, catalogue.catalogue(by_seat=True), _POSTFLOP))


@query("distinct_hands_of_index", ORACLES["distinct_hands"])
def distinct_hands_of_index(spark, sf_dir):
    """The same from the id index."""
    return cubes.distinct_hands(_hits(spark, sf_dir), _POSTFLOP)


@query(
    "manifest_rollup",
    _hits_sql()
    + """, s AS (SELECT hits.*, hd.site AS source FROM hits JOIN hd ON hd.h = hits.hand_id::BIGINT)
    SELECT 'source' AS level, source AS key, count(DISTINCT stat_id) AS stats, count(*) AS hands FROM s GROUP BY source
    UNION ALL SELECT 'group', grp, count(DISTINCT stat_id), count(*) FROM s GROUP BY grp""",
)
def manifest_rollup(spark, sf_dir):
    sites = tables.hands(spark, sf_dir).select(F.col("h").cast("string").alias("hand_id"), F.col("site").alias("source"))
    return cubes.manifest_rollup(_hits(spark, sf_dir).join(sites, "hand_id"))


@query(
    "stat_drilldown",
    _hits_sql()
    + """ SELECT hd.h::VARCHAR AS hand_id, hd.site, hd.file_id, w.first_month FROM (
        SELECT hand_id, min(month) AS first_month FROM hits WHERE stat_id = 'POST_CBET_FLOP_OOP' AND grp = 'postflop_all' AND kind = 'attempts' GROUP BY hand_id) w
      JOIN hd ON hd.h = w.hand_id::BIGINT""",
)
def stat_drilldown(spark, sf_dir):
    hands = tables.hands(spark, sf_dir).select(F.col("h").cast("string").alias("hand_id"), "site", "file_id")
    facts_ = labelled(spark, sf_dir).withColumn("hand_id", F.col("h").cast("string"))
    hits = opportunities.stat_hits(facts_, catalogue.catalogue(by_seat=True), stat_ids=["POST_CBET_FLOP_OOP"])
    return reports.drill_down(hits, hands, "POST_CBET_FLOP_OOP", "postflop_all", "attempts")


@query(
    "derive_telemetry",
    duck.WITH_FACTS
    + """ SELECT count(*) AS hands_processed, count(*) FILTER (WHERE hero_pos_group = 'EP') AS position_ep, count(*) FILTER (WHERE hero_pos_group = 'MP') AS position_mp,
      count(*) FILTER (WHERE hero_pos_group = 'LP') AS position_lp, count(*) FILTER (WHERE pot_type = 'SRP') AS pot_srp, count(*) FILTER (WHERE pot_type = '3bet') AS pot_3bet,
      count(*) FILTER (WHERE pot_type = '4bet') AS pot_4bet, count(*) FILTER (WHERE pot_type = 'none') AS pot_none,
      round(count(*) FILTER (WHERE heads_up_flop) / count(*) * 100, 2) AS heads_up_percentage,
      round(avg(nullif(eff_stack_srp, 0)), 2) AS average_eff_stack_srp, round(avg(nullif(eff_stack_vs_3bet, 0)), 2) AS average_eff_stack_vs_3bet FROM facts""",
)
def derive_telemetry(spark, sf_dir):
    return cubes.derive_telemetry(facts(spark, sf_dir))


@query(
    "context_report",
    duck.WITH_FACTS
    + """ SELECT count(*) AS hands, 0::BIGINT AS no_hero, count(*) FILTER (WHERE saw_flop AND hero_ip_flop IS NULL) AS no_position_on_flop,
      count(*) FILTER (WHERE saw_flop AND players_to_flop = 2 AND NOT heads_up_flop) AS two_players_not_heads_up,
      count(*) FILTER (WHERE saw_flop AND pot_type = 'SRP' AND eff_stack_srp IS NULL) AS no_stack_in_srp FROM facts""",
)
def context_report(spark, sf_dir):
    return quality.context_report(facts(spark, sf_dir))


@query(
    "parse_summary",
    duck.WITH_FACTS
    + """ SELECT site, count(*) AS hands, round(count(*) FILTER (WHERE any_allin_preflop) / count(*) * 100, 2) AS allin_pct,
      round(count(*) FILTER (WHERE players_to_flop = 2) / count(*) * 100, 2) AS heads_up_pct, round(count(*) FILTER (WHERE players_to_flop > 2) / count(*) * 100, 2) AS multiway_pct,
      round(avg(n_dealt), 2) AS avg_dealt_in FROM facts GROUP BY site""",
)
def parse_summary(spark, sf_dir):
    return segments.parse_summary(facts(spark, sf_dir), ["site"])


@query(
    "parse_errors",
    duck.BASE
    + """ SELECT h, CASE WHEN h % 17 = 0 THEN ['missing_button'] ELSE []::VARCHAR[] END || CASE WHEN h % 5 = 0 THEN ['missing_preflop_actions'] ELSE []::VARCHAR[] END AS errors FROM hd""",
)
def parse_errors(spark, sf_dir):
    hands = tables.hands(spark, sf_dir)
    broken = hands.withColumn("button_seat", F.when(F.col("h") % 17 != 0, F.col("button_seat"))).withColumn(
        "streets",
        F.when(
            F.col("h") % 5 == 0,
            F.col("streets").withField("preflop", F.col("streets.preflop").withField("actions", F.slice("streets.preflop.actions", 1, 0))),
        ).otherwise(F.col("streets")),
    )
    return segments.parse_errors(broken).select("h", "errors")


@query(
    "stable_id",
    duck.BASE
    + """, nm AS (SELECT h, string_agg(name, '|' ORDER BY name) AS names FROM seated GROUP BY h)
    SELECT hd.h, left(sha1(site || '|' || coalesce(tournament_id, '') || '|' || file_id || '|' || button_seat::VARCHAR || '|' || hd.h::VARCHAR || '|' ||
      strftime(hand_ts, '%Y-%m-%dT%H:%M:%SZ') || '|' || sha1(names)), 16) AS hand_id FROM hd JOIN nm USING (h)""",
)
def stable_id(spark, sf_dir):
    return tables.hands(spark, sf_dir).select(
        "h",
        records.stable_id(
            *[F.col(c) for c in ("site", "tournament_id", "file_id", "button_seat")],
            F.try_element_at("raw_offsets", F.lit("hand_start")),
            F.col("timestamp_utc"),
            names=F.transform("players", lambda p: p["name"]),
        ).alias("hand_id"),
    )


@query(
    "math_allin",
    duck.BASE
    + """, chips AS (SELECT a.h, a.slot, a.actor, a.street, a.amount, s.stack / 10 - 0.5 AS stack FROM acts a JOIN seated s ON s.h = a.h AND s.name = a.actor
        WHERE a.street <> 'preflop' AND a.type IN ('CALL', 'BET', 'RAISE', 'ALLIN')),
    d AS (SELECT *, amount - coalesce(lag(amount) OVER (PARTITION BY h, actor, street ORDER BY slot), 0) AS added FROM chips),
    e AS (SELECT *, stack - coalesce(sum(added) OVER (PARTITION BY h, actor ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS available FROM d)
    SELECT h, slot, actor, round(added, 4) AS added, round(available, 4) AS available, added >= available - 0.01 AS math_allin FROM e""",
)
def math_allin(spark, sf_dir):
    hands = tables.hands(spark, sf_dir)

    def on(street: str) -> Column:
        return F.transform(
            F.col(f"streets.{street}.actions"),
            lambda a: F.struct(
                F.lit(street).alias("street"), a["actor"].alias("actor"), a["type"].alias("type"),
                a["amount"].alias("amount"), a["raw_offset"].alias("slot"),
            ),
        )

    acts = F.flatten(F.array(*map(on, STREETS)))
    rows = hands.select("h", "players", F.inline(acts)).where(F.col("type").isin("CALL", "BET", "RAISE", "ALLIN"))
    mine = F.filter("players", lambda p: p["name"] == F.col("actor"))
    chips = rows.withColumn("stack", F.get(mine, F.lit(0))["stack_chips"] / 10 - 0.5).where(F.col("stack").isNotNull())
    out = reports.committed_before(chips, "h", "actor", "street", "slot")
    return out.select("h", "slot", "actor", F.round("added", 4).alias("added"), F.round("available", 4).alias("available"), "math_allin")


@query(
    "group_sample",
    duck.WITH_FACTS + " SELECT grp, h FROM (SELECT grp, h, row_number() OVER (PARTITION BY grp ORDER BY h) AS rn FROM labelled) WHERE rn <= 10",
)
def group_sample(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("h", F.explode("groups").alias("grp"))
    return classify.group_sample(rows, ["h"])
