"""Oracle building blocks: the derived hands and their facts in plain SQL.

Written independently of the library: long-form rows, minimum positions and
conditional aggregates, no arrays of actions and no street words.
"""

from checks.tables import DUCK_HANDS

RAISES = "('RAISE', 'RERAISE', 'ALLIN')"
AGGR = "('BET', 'RAISE', 'ALLIN')"

# Seat names by table size, from the button clockwise.
SEAT_NAMES = {
    1: ["BTN"],
    2: ["BTN", "SB"],
    3: ["BTN", "SB", "BB"],
    4: ["BTN", "SB", "BB", "CO"],
    5: ["BTN", "SB", "BB", "MP", "CO"],
    6: ["BTN", "SB", "BB", "EP", "MP", "CO"],
    7: ["BTN", "SB", "BB", "EP", "EP2", "MP1", "CO"],
    8: ["BTN", "SB", "BB", "EP", "EP2", "MP1", "MP2", "CO"],
    9: ["BTN", "SB", "BB", "EP", "EP2", "MP1", "MP2", "MP3", "CO"],
}
OTHER_NAMES = {
    2: ["BTN/SB", "BB"],
    3: ["BTN", "SB", "BB"],
    4: ["BTN", "SB", "BB", "CO"],
    5: ["BTN", "SB", "BB", "MP", "CO"],
    6: ["BTN", "SB", "BB", "UTG", "MP", "CO"],
    7: ["BTN", "SB", "BB", "UTG", "UTG+1", "MP", "CO"],
    8: ["BTN", "SB", "BB", "UTG", "UTG+1", "MP", "HJ", "CO"],
    9: ["BTN", "SB", "BB", "UTG", "UTG+1", "UTG+2", "MP", "HJ", "CO"],
}


def values(table: dict[int, list[str]]) -> str:
    return ", ".join(f"({n}, {i}, '{p}')" for n, names in table.items() for i, p in enumerate(names))


POSITIONS = f"""
pos_of_n(n, idx, pos) AS (VALUES {values(SEAT_NAMES)}),
button AS (SELECT h, CASE WHEN bool_or(seat = button_seat) THEN any_value(button_seat) ELSE min(seat) END AS btn
           FROM seated GROUP BY h),
seat_rank AS (
  SELECT s.h, s.name, s.hero, s.stack,
         row_number() OVER (PARTITION BY s.h ORDER BY (s.seat - b.btn + 100) % 100) - 1 AS idx,
         count(*) OVER (PARTITION BY s.h) AS np
  FROM seated s JOIN button b USING (h)),
pos AS MATERIALIZED (
  SELECT r.h, r.name, r.hero, r.stack, r.np, p.pos
  FROM seat_rank r LEFT JOIN pos_of_n p ON p.n = r.np AND p.idx = r.idx)
"""

PREFLOP = f"""
pa AS MATERIALIZED (
  SELECT h, any_value(hero) AS hero,
    min(slot) FILTER (WHERE actor = hero) AS hero_i,
    min(slot) FILTER (WHERE type IN ('RAISE', 'ALLIN')) AS open_i,
    arg_min(actor, slot) FILTER (WHERE type IN ('RAISE', 'ALLIN')) AS open_raiser,
    list(actor ORDER BY slot) FILTER (WHERE type IN {RAISES}) AS raisers,
    arg_max(actor, slot) FILTER (WHERE type IN {AGGR}) AS last_aggr,
    arg_min(type, slot) FILTER (WHERE actor = hero AND type IN ('CALL', 'RAISE', 'RERAISE', 'ALLIN', 'BET', 'FOLD', 'CHECK')) AS hero_decides,
    min(slot) FILTER (WHERE type IN ('CALL', 'RAISE', 'RERAISE', 'ALLIN')) AS entry_i,
    arg_min(type, slot) FILTER (WHERE type IN ('CALL', 'RAISE', 'RERAISE', 'ALLIN')) AS entry_type,
    min(slot) FILTER (WHERE actor <> hero AND type IN {RAISES}) AS opp_raise_i
  FROM acts WHERE street = 'preflop' GROUP BY h),
pb AS (
  SELECT a.h,
    min(a.slot) FILTER (WHERE a.type = 'CALL' AND a.slot > p.open_i) AS call_i,
    bool_or(a.slot > p.open_i AND ((a.actor <> p.hero AND a.type IN {RAISES}) OR (a.actor = p.hero AND a.type = 'RERAISE'))) AS raise_after_open,
    arg_min(a.type, a.slot) FILTER (WHERE a.actor = p.hero AND a.slot > p.opp_raise_i) AS hero_reply
  FROM acts a JOIN pa p USING (h) WHERE a.street = 'preflop' GROUP BY a.h),
pc AS (
  SELECT a.h, bool_or(a.actor = a.hero AND a.type IN {RAISES} AND a.slot > b.call_i) AS hero_raises_after_call,
         min(a.slot) FILTER (WHERE a.type = 'CALL' AND a.slot < coalesce(p.hero_i, 99)) AS caller_i
  FROM acts a JOIN pb b USING (h) JOIN pa p USING (h) WHERE a.street = 'preflop' GROUP BY a.h),
pf AS MATERIALIZED (
  SELECT pa.h, pa.hero, hp.pos AS hero_position, op.pos AS open_raiser_position,
    pa.open_raiser, pa.raisers[2] AS three_bettor, pa.raisers[3] AS four_bettor,
    CASE coalesce(len(pa.raisers), 0) WHEN 0 THEN 'none' WHEN 1 THEN 'SRP' WHEN 2 THEN '3bet' ELSE '4bet' END AS pot_type,
    coalesce(pa.raisers[3], pa.raisers[2], pa.open_raiser, pa.last_aggr) AS pfr,
    coalesce(pa.hero_decides IN ('CALL', 'RAISE', 'RERAISE', 'ALLIN', 'BET'), false) AS hero_vpip,
    coalesce(pa.entry_i >= coalesce(pa.hero_i, 99), true) AS unopened_pot,
    coalesce(pa.entry_i < pa.hero_i AND pa.entry_type = 'CALL', false) AS has_limper_before_hero,
    coalesce(pa.entry_type = 'CALL', false) AS any_limp,
    coalesce(pa.hero_i = pa.open_i, false) AS leads,
    coalesce(pa.open_raiser = pa.hero AND pb.raise_after_open, false) AS faced_3bet,
    coalesce(pb.hero_reply = 'FOLD', false) AS folded_to_3bet,
    coalesce(pc.hero_raises_after_call, false) AS is_squeeze,
    coalesce(pa.open_raiser <> pa.hero AND op.pos = 'BTN' AND hp.pos IN ('SB', 'BB') AND pa.raisers[2] = pa.hero, false) AS is_resteal_vs_btn,
    coalesce(pa.raisers[2] = pa.hero, false) AS hero_is_three_bettor,
    pa.open_i IS NULL AND EXISTS (SELECT 1 FROM acts a JOIN pos q ON q.h = a.h AND q.name = a.actor WHERE a.h = pa.h AND a.street = 'preflop' AND q.pos = 'SB' AND a.type = 'CALL')
      AND EXISTS (SELECT 1 FROM acts a JOIN pos q ON q.h = a.h AND q.name = a.actor WHERE a.h = pa.h AND a.street = 'preflop' AND q.pos = 'BB' AND a.type = 'CHECK') AS freeplay_bb,
    pc.caller_i
  FROM pa JOIN pb USING (h) JOIN pc USING (h)
  LEFT JOIN pos hp ON hp.h = pa.h AND hp.name = pa.hero
  LEFT JOIN pos op ON op.h = pa.h AND op.name = pa.open_raiser)
"""

IN_POSITION = """
folds AS (SELECT DISTINCT h, street, actor FROM acts WHERE type = 'FOLD'),
in_flop AS (SELECT d.h, d.name FROM dealt d ANTI JOIN (SELECT * FROM folds WHERE street = 'preflop') f ON f.h = d.h AND f.actor = d.name),
in_turn AS (SELECT d.h, d.name FROM in_flop d ANTI JOIN (SELECT * FROM folds WHERE street = 'flop') f ON f.h = d.h AND f.actor = d.name),
in_river AS (SELECT d.h, d.name FROM in_turn d ANTI JOIN (SELECT * FROM folds WHERE street = 'turn') f ON f.h = d.h AND f.actor = d.name),
alive AS (SELECT 'flop' AS street, * FROM in_flop UNION ALL SELECT 'turn', * FROM in_turn UNION ALL SELECT 'river', * FROM in_river),
grid AS (SELECT hd.h, hd.hero, s.street FROM hd, (VALUES ('flop'), ('turn'), ('river')) s(street)),
counts AS (SELECT g.h, g.street, g.hero, count(a.name) AS players, coalesce(bool_or(a.name = g.hero), false) AS hero_in
           FROM grid g LEFT JOIN alive a ON a.h = g.h AND a.street = g.street GROUP BY g.h, g.street, g.hero),
firsts AS (SELECT a.h, a.street, arg_min(a.actor, a.slot) AS first_actor
           FROM acts a JOIN alive l ON l.h = a.h AND l.street = a.street AND l.name = a.actor GROUP BY a.h, a.street),
ip AS MATERIALIZED (
  SELECT c.h, c.street, c.players, c.players = 2 AS heads_up,
         CASE WHEN c.players = 2 AND c.hero_in THEN f.first_actor <> c.hero END AS hero_ip
  FROM counts c LEFT JOIN firsts f ON f.h = c.h AND f.street = c.street)
"""

STREETS = f"""
sa AS MATERIALIZED (
  SELECT a.h, a.street, p.hero, p.pfr, p.pot_type,
    count(*) AS n_acts,
    min(slot) FILTER (WHERE actor = p.hero) AS hero_i,
    min(slot) FILTER (WHERE actor = p.pfr) AS pfr_i,
    min(slot) FILTER (WHERE type IN {AGGR}) AS aggr_i,
    arg_min(actor, slot) FILTER (WHERE type IN {AGGR}) AS aggr_actor,
    arg_min(type, slot) FILTER (WHERE actor = p.hero) AS hero_type,
    arg_min(type, slot) FILTER (WHERE actor = p.pfr AND type IN ('CHECK', 'BET', 'RAISE', 'ALLIN')) AS pfr_shows,
    min(slot) FILTER (WHERE actor = p.hero AND type = 'CHECK') AS check_i,
    count(*) FILTER (WHERE actor = p.hero) AS hero_n,
    count(*) FILTER (WHERE actor = p.hero AND type IN {AGGR}) AS hero_aggr
  FROM acts a JOIN pf p USING (h) WHERE a.street <> 'preflop' GROUP BY a.h, a.street, p.hero, p.pfr, p.pot_type),
sb AS (SELECT a.h, a.street, min(a.slot) FILTER (WHERE a.slot > s.check_i AND a.type IN {AGGR}) AS bet_i
       FROM acts a JOIN sa s ON s.h = a.h AND s.street = a.street GROUP BY a.h, a.street),
sc AS (SELECT a.h, a.street, arg_min(a.type, a.slot) FILTER (WHERE a.actor = a.hero AND a.slot > s.bet_i) AS reply
       FROM acts a JOIN sb s ON s.h = a.h AND s.street = a.street GROUP BY a.h, a.street),
xb AS (SELECT b.h, b.street, b.slot AS bet_i, min(r.slot) AS raise_i
       FROM acts b
       JOIN acts c ON c.h = b.h AND c.street = b.street AND c.type = 'CHECK' AND c.slot < b.slot
       JOIN acts r ON r.h = b.h AND r.street = b.street AND r.actor = c.actor AND r.slot > b.slot AND r.type IN ('RAISE', 'ALLIN')
       WHERE b.actor = b.hero AND b.type IN {AGGR} AND b.street <> 'preflop' GROUP BY b.h, b.street, b.slot),
xr AS (SELECT x.h, x.street, x.bet_i, arg_min(a.type, a.slot) AS reply
       FROM xb x LEFT JOIN acts a ON a.h = x.h AND a.street = x.street AND a.actor = a.hero AND a.slot > x.raise_i
       GROUP BY x.h, x.street, x.bet_i),
xs AS (SELECT h, street, true AS trapped, bool_or(coalesce(reply = 'FOLD', false)) AS trapped_folds FROM xr GROUP BY h, street),
sf AS MATERIALIZED (
  SELECT s.h, s.street, s.hero, s.pfr, s.pot_type, i.hero_ip, i.heads_up,
    coalesce(s.hero = s.pfr, false) AS is_pfr,
    coalesce(s.hero <> s.pfr, false) AS vs_pfr,
    s.hero_i IS NOT NULL AND coalesce(s.aggr_i >= s.hero_i, true) AS to_hero,
    coalesce(s.aggr_i = s.hero_i, false) AS hero_bets,
    coalesce(s.aggr_actor = s.pfr AND s.pfr <> s.hero AND s.aggr_i < s.hero_i, false) AS faces_cbet,
    s.hero_type,
    coalesce(s.pfr_shows = 'CHECK', false) AS pfr_checked,
    s.hero_i IS NOT NULL AND coalesce(s.hero_i < s.pfr_i, true) AS before_pfr,
    s.hero_type IN {AGGR} AS first_is_bet,
    b.bet_i IS NOT NULL AS xr_opp,
    coalesce(c.reply IN ('RAISE', 'ALLIN'), false) AS xr_att,
    CASE WHEN s.hero_n > 0 THEN round(100.0 * s.hero_aggr / s.hero_n, 2) ELSE 0.0 END AS agg_pct,
    s.hero_aggr > 0 AS hero_aggressive,
    coalesce(x.trapped, false) AS trapped, coalesce(x.trapped_folds, false) AS trapped_folds
  FROM sa s JOIN ip i ON i.h = s.h AND i.street = s.street
  JOIN sb b ON b.h = s.h AND b.street = s.street
  JOIN sc c ON c.h = s.h AND c.street = s.street
  LEFT JOIN xs x ON x.h = s.h AND x.street = s.street
  WHERE EXISTS (SELECT 1 FROM acts f WHERE f.h = s.h AND f.street = 'flop') OR s.street = 'flop')
"""

STACKS = """
bb AS (SELECT 4.0 AS bb),
alive_seats AS (SELECT s.h, s.name, s.stack, s.hero FROM seated s ANTI JOIN (SELECT * FROM folds WHERE street = 'preflop') f ON f.h = s.h AND f.actor = s.name),
eff AS (SELECT h, CASE WHEN count(*) = 2 AND bool_or(name = hero) THEN round(min(stack) / 4.0, 2) END AS eff_stack_srp FROM alive_seats GROUP BY h),
play_order(pos, turn) AS (VALUES ('EP', 1), ('EP2', 2), ('MP1', 3), ('MP', 3), ('MP2', 4), ('MP3', 5), ('CO', 6), ('BTN', 7), ('SB', 8), ('BB', 9)),
behind AS (
  SELECT m.h, round(avg(o.stack) / 4.0, 2) AS avg_stacks_after_hero_bb
  FROM pos m JOIN play_order mo ON mo.pos = m.pos
  JOIN pos o ON o.h = m.h JOIN play_order oo ON oo.pos = o.pos AND oo.turn > mo.turn
  WHERE m.name = m.hero GROUP BY m.h),
stk AS MATERIALIZED (
  SELECT p.h, e.eff_stack_srp,
    CASE WHEN t.stack IS NOT NULL THEN round(least(m.stack, t.stack) / 4.0, 2) END AS eff_stack_vs_3bet,
    round(m.stack / 4.0, 2) AS hero_stack_bb, b.avg_stacks_after_hero_bb,
    round(o.stack / 4.0, 2) AS raiser_stack_bb, round(t.stack / 4.0, 2) AS three_bettor_stack_bb,
    round((o.stack + c.stack) / 2 / 4.0, 2) AS squeeze_avg_stack_bb,
    round(v.stack / 4.0, 2) AS bvb_villain_stack_bb
  FROM pf p LEFT JOIN eff e USING (h) LEFT JOIN behind b USING (h)
  LEFT JOIN pos m ON m.h = p.h AND m.name = p.hero
  LEFT JOIN pos o ON o.h = p.h AND o.name = p.open_raiser
  LEFT JOIN pos t ON t.h = p.h AND t.name = p.three_bettor
  LEFT JOIN acts ca ON ca.h = p.h AND ca.slot = p.caller_i
  LEFT JOIN pos c ON c.h = p.h AND c.name = ca.actor
  LEFT JOIN pos v ON v.h = p.h AND p.hero_position IN ('SB', 'BB') AND v.pos = CASE p.hero_position WHEN 'SB' THEN 'BB' ELSE 'SB' END)
"""


def _street_columns(s: str, short: str, prev: str | None) -> str:
    live = f"{short}.h IS NOT NULL"
    out = []
    for side, test in (("ip", f"{short}.hero_ip"), ("oop", f"NOT {short}.hero_ip")):
        out += [
            f"coalesce({short}.is_pfr AND {short}.to_hero AND {test}, false) AS cbet_{s}_opp_{side}",
            f"coalesce({short}.is_pfr AND {short}.hero_bets AND {test}, false) AS cbet_{s}_att_{side}",
            f"coalesce({short}.faces_cbet AND {short}.hero_type = 'FOLD' AND {test}, false) AS vs_cbet_{s}_fold_{side}",
            f"coalesce({short}.faces_cbet AND {short}.hero_type = 'CALL' AND {test}, false) AS vs_cbet_{s}_call_{side}",
            f"coalesce({short}.faces_cbet AND {short}.first_is_bet AND {test}, false) AS vs_cbet_{s}_raise_{side}",
            f"coalesce({short}.vs_pfr AND {short}.pot_type = 'SRP' AND {short}.to_hero AND {test}, false) AS bet_vs_missed_{s}_opp_{side}",
            f"coalesce({short}.vs_pfr AND {short}.pot_type = 'SRP' AND {short}.hero_bets AND {test}, false) AS bet_vs_missed_{s}_att_{side}",
        ]
        if prev:
            out += [
                f"coalesce({short}.vs_pfr AND {prev}.pfr_checked AND {short}.to_hero AND {test}, false) AS probe_{s}_opp_{side}",
                f"coalesce({short}.vs_pfr AND {prev}.pfr_checked AND {short}.hero_bets AND {test}, false) AS probe_{s}_att_{side}",
                f"coalesce({short}.is_pfr AND NOT coalesce({prev}.hero_bets AND {prev}.hero_ip IS NOT NULL, false) AND {short}.to_hero AND {test}, false) AS delayed_cbet_{s}_opp_{side}",
                f"coalesce({short}.is_pfr AND NOT coalesce({prev}.hero_bets AND {prev}.hero_ip IS NOT NULL, false) AND {short}.hero_bets AND {test}, false) AS delayed_cbet_{s}_att_{side}",
            ]
    out += [
        f"coalesce({short}.vs_pfr AND NOT {short}.hero_ip AND {short}.before_pfr, false) AS donk_{s}_opp",
        f"coalesce({short}.vs_pfr AND NOT {short}.hero_ip AND {short}.before_pfr AND {short}.first_is_bet, false) AS donk_{s}_att",
        f"coalesce({short}.xr_opp, false) AS xr_{s}_opp",
        f"coalesce({short}.xr_att, false) AS xr_{s}_att",
        f"EXISTS (SELECT 1 FROM acts x WHERE x.h = pf.h AND x.street = '{s}') AS saw_{s}",
        f"(SELECT agg_pct FROM agg WHERE agg.h = pf.h AND agg.street = '{s}') AS agg_pct_{s}",
        f"i{short}.players AS players_to_{s}",
        f"i{short}.heads_up AS heads_up_{s}",
        f"i{short}.hero_ip AS hero_ip_{s}",
    ]
    return ",\n    ".join(out)


FACTS = f"""
agg AS (SELECT h, street, CASE WHEN hero_n > 0 THEN round(100.0 * hero_aggr / hero_n, 2) ELSE 0.0 END AS agg_pct FROM sa),
wide AS MATERIALIZED (
  SELECT pf.* EXCLUDE (caller_i),
    pf.unopened_pot AND pf.leads AS hero_raised_first_in,
    NOT pf.unopened_pot AND pf.leads AND pf.any_limp AS is_isoraiser,
    CASE WHEN pf.hero_position IN ('EP', 'EP2') THEN 'EP' WHEN pf.hero_position IN ('MP', 'MP1', 'MP2', 'MP3') THEN 'MP'
         WHEN pf.hero_position IN ('CO', 'BTN') THEN 'LP' END AS hero_pos_group,
    stk.* EXCLUDE (h),
    {_street_columns('flop', 'f', None)},
    {_street_columns('turn', 't', 'f')},
    {_street_columns('river', 'r', 't')},
    hd.any_allin AS any_allin_preflop, hd.shown AS saw_showdown, hd.hero_won AS won_showdown,
    hd.hero_won AND f.h IS NOT NULL AS won_when_saw_flop,
    coalesce(f.trapped OR t.trapped OR r.trapped, false) OR coalesce(f.trapped, false) OR coalesce(t.trapped, false) OR coalesce(r.trapped, false) AS fold_vs_check_raise_opp,
    coalesce(f.trapped_folds, false) OR coalesce(t.trapped_folds, false) OR coalesce(r.trapped_folds, false) AS fold_vs_check_raise_att,
    coalesce(pf.pot_type = 'SRP' AND r.heads_up AND r.to_hero, false) AS river_bet_srp_opp,
    coalesce(pf.pot_type = 'SRP' AND r.heads_up AND r.hero_bets, false) AS river_bet_srp_att,
    coalesce(r.hero_aggressive AND hd.shown, false) AS w_sd_b_river_opp,
    coalesce(r.hero_aggressive AND hd.shown AND hd.hero_won, false) AS w_sd_b_river_att,
    hd.month, hd.site, hd.tournament_id, hd.file_id, hd.table_max, hd.n,
    (SELECT count(*) FROM seated s WHERE s.h = pf.h) AS n_players,
    (SELECT count(*) FROM dealt s WHERE s.h = pf.h) AS n_dealt
  FROM pf JOIN hd USING (h) JOIN stk USING (h)
  LEFT JOIN sf f ON f.h = pf.h AND f.street = 'flop'
  LEFT JOIN sf t ON t.h = pf.h AND t.street = 'turn'
  LEFT JOIN sf r ON r.h = pf.h AND r.street = 'river'
  JOIN ip if ON if.h = pf.h AND if.street = 'flop'
  JOIN ip it ON it.h = pf.h AND it.street = 'turn'
  JOIN ip ir ON ir.h = pf.h AND ir.street = 'river'),
facts AS (
  SELECT *, donk_flop_att AS donk_flop, donk_turn_att AS donk_turn, agg_pct_river AS river_agg_pct,
    bet_vs_missed_flop_att_ip OR bet_vs_missed_flop_att_oop AS flop_bet_vs_missed_cbet_srp,
    bet_vs_missed_turn_att_oop AS turn_bet_vs_missed_cbet_srp_oop,
    CASE WHEN contains(file_id, '/pko/') THEN 'pko' WHEN contains(file_id, '/myst') THEN 'mystery'
         WHEN contains(file_id, '/non-ko/') THEN 'non-ko' WHEN contains(file_id, 'bounty') THEN 'pko' ELSE 'non-ko' END AS class,
    coalesce(table_max, n_players) AS table_size
  FROM wide),
labelled AS (
  SELECT * FROM (
    SELECT *, CASE WHEN class = 'non-ko' AND table_size BETWEEN 7 AND 10 THEN 'nonko_9max_pref'
                   WHEN class = 'non-ko' AND table_size BETWEEN 3 AND 6 THEN 'nonko_6max_pref'
                   WHEN class = 'pko' THEN 'pko_pref' WHEN class = 'mystery' THEN 'mystery_pref' END AS grp FROM facts
    UNION ALL
    SELECT *, 'postflop_all' AS grp FROM facts WHERE saw_flop OR saw_turn OR saw_river)
  WHERE grp IS NOT NULL)
"""

BASE = "WITH " + DUCK_HANDS
WITH_POSITIONS = BASE + "," + POSITIONS
WITH_PREFLOP = WITH_POSITIONS + "," + PREFLOP
WITH_IP = WITH_PREFLOP + "," + IN_POSITION
WITH_STREETS = WITH_IP + "," + STREETS
WITH_FACTS = WITH_STREETS + "," + STACKS + "," + FACTS


def clause_sql(clause) -> str:
    """A predicate tree as SQL, with the same answers on NULL."""
    if clause is None:
        return "false"
    if isinstance(clause, bool):
        return str(clause).lower()
    if isinstance(clause, str):
        return f"coalesce({clause}, false)"
    if isinstance(clause, list):
        return "(" + " AND ".join(map(clause_sql, clause)) + ")"
    (op, arg), = clause.items()
    if op in ("all", "any"):
        return "(" + f" {'AND' if op == 'all' else 'OR'} ".join(map(clause_sql, arg)) + ")"
    if op == "not":
        return f"(NOT {clause_sql(arg)})"
    if op == "is_true":
        return f"coalesce({arg}, false)"
    if op == "is_false":
        return f"(NOT coalesce({arg}, false))"
    name, value = arg
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    if op == "eq":
        return f"({name} IS NOT DISTINCT FROM {lit(value)})"
    if op == "eq_field":
        return f"coalesce({name} = {value}, false)"
    if op == "in":
        return f"coalesce({name} IN ({', '.join(map(lit, value))}), false)"
    sign = {"gte": ">=", "lte": "<=", "gt": ">", "lt": "<"}[op]
    return f"coalesce({name} {sign} {lit(value)}, false)"


def metric_sql(metric: dict) -> tuple[str, str]:
    f = metric.get("filters") or {}
    tests = [f"grp IN ({', '.join(repr(g) for g in metric['applies_to_groups'])})"]
    if f.get("heads_up_only"):
        tests.append("heads_up_flop" if metric["scope"] == "preflop" else "(heads_up_flop OR NOT saw_flop)")
    if f.get("pot_type"):
        tests.append(f"pot_type IN ({', '.join(repr(p) for p in f['pot_type'])})")
    if f.get("eff_stack_min_bb") is not None:
        tests.append(f"coalesce(eff_stack_srp >= {f['eff_stack_min_bb']}, false)")
    if f.get("exclude_allin_preflop"):
        tests.append("NOT any_allin_preflop")
    opp = " AND ".join([*tests, clause_sql(metric["opportunity"])])
    return opp, f"{opp} AND {clause_sql(metric['attempt'])}"


def catalogue_sql(metrics: list[dict], keys: str = "month, grp", source: str = "labelled") -> str:
    """One scan, one row per key, unnested to the long cube."""
    cells = []
    for m in metrics:
        opp, att = metric_sql(m)
        cells.append(
            f"{{'stat_id': '{m['id']}', 'opportunities': count(*) FILTER (WHERE {opp}), 'attempts': count(*) FILTER (WHERE {att})}}"
        )
    return (
        f"SELECT {keys}, c.stat_id AS stat_id, c.opportunities AS opportunities, c.attempts AS attempts FROM ("
        f"SELECT {keys}, unnest([{', '.join(cells)}]) AS c FROM {source} GROUP BY {keys}) WHERE c.opportunities > 0"
    )
