"""The counters over hand text against counts made from the structured actions in SQL."""

from pyspark.sql import functions as F

from checks import duck, handtext
from checks.duck import OTHER_NAMES, values
from tallyhand.functions import handtext as ht
from tallyhand.operators import cube as cubes
from tallyhand.plans import counters

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


TOKENS = (
    duck.WITH_POSITIONS
    + f""",
other(n, idx, pos2) AS (VALUES {values(OTHER_NAMES)}),
seated_button AS (SELECT h FROM seated GROUP BY h HAVING bool_or(seat = button_seat)),
ord(pos2, ord) AS (VALUES ('SB', 0), ('BB', 1), ('UTG', 2), ('UTG+1', 3), ('UTG+2', 4), ('MP', 5), ('HJ', 8), ('CO', 9), ('BTN', 10), ('BTN/SB', 11)),
names AS MATERIALIZED (
  SELECT r.h, r.name, r.hero, round(r.stack / 4.0, 2) AS bb, x.pos2 AS pos, o.ord FROM seat_rank r JOIN seated_button USING (h)
  JOIN other x ON x.n = r.np AND x.idx = r.idx JOIN ord o ON o.pos2 = x.pos2),
stacks AS (SELECT h, name, stack, round(stack / 4.0, 2) AS bb FROM seated),
lasts AS (SELECT h, street, actor, arg_max(amount, slot) AS amount FROM acts WHERE street <> 'preflop' AND type IN ('CALL', 'BET', 'RAISE', 'ALLIN') GROUP BY h, street, actor),
tok AS MATERIALIZED (
  SELECT a.h, a.street, a.slot, a.actor, a.actor = a.hero AS me, n.pos, n.ord, coalesce(n.pos NOT IN ('SB', 'BB'), true) AS nb, s.bb,
    CASE a.type WHEN 'FOLD' THEN 'f' WHEN 'CHECK' THEN 'k' WHEN 'CALL' THEN 'c' ELSE 'r' END AS kind,
    a.type = 'ALLIN' OR coalesce(a.street <> 'preflop' AND a.type IN ('CALL', 'BET', 'RAISE', 'ALLIN')
      AND a.amount + CASE WHEN a.street IN ('turn', 'river') THEN coalesce(lf.amount, 0) ELSE 0 END + CASE WHEN a.street = 'river' THEN coalesce(lt.amount, 0) ELSE 0 END >= s.stack - 0.01, false) AS allin
  FROM acts a LEFT JOIN names n ON n.h = a.h AND n.name = a.actor LEFT JOIN stacks s ON s.h = a.h AND s.name = a.actor
  LEFT JOIN lasts lf ON lf.h = a.h AND lf.actor = a.actor AND lf.street = 'flop' LEFT JOIN lasts lt ON lt.h = a.h AND lt.actor = a.actor AND lt.street = 'turn'
  WHERE a.type NOT IN ('POST_SB', 'POST_BB')),
mine AS (SELECT h, street, min(slot) AS mi, arg_min(kind, slot) AS reply FROM tok WHERE me GROUP BY h, street),
p1 AS (
  SELECT t.h, any_value(m.mi) AS mi, any_value(m.reply) AS reply,
    count(*) FILTER (WHERE kind = 'r' AND slot < coalesce(m.mi, 99)) AS rb,
    min(slot) FILTER (WHERE kind = 'r' AND slot < coalesce(m.mi, 99)) AS r1,
    arg_min(pos, slot) FILTER (WHERE kind = 'r' AND slot < coalesce(m.mi, 99)) AS r1_pos,
    arg_min(bb, slot) FILTER (WHERE kind = 'r' AND slot < coalesce(m.mi, 99)) AS r1_bb,
    count(*) FILTER (WHERE kind = 'c' AND nb AND slot < coalesce(m.mi, 99)) AS nbc,
    count(*) FILTER (WHERE kind <> 'f' AND nb AND slot < coalesce(m.mi, 99)) AS front_any,
    count(*) FILTER (WHERE kind <> 'f' AND nb AND NOT me) AS nb_nonfold,
    coalesce(bool_or(kind = 'r' AND allin AND slot < coalesce(m.mi, 99)), false) AS blocked,
    coalesce(bool_or(kind = 'f' AND pos = 'SB' AND slot < m.mi), false) AS sb_folded,
    coalesce(bool_or(kind = 'f' AND pos = 'BTN' AND slot < m.mi), false) AS btn_folded,
    min(slot) FILTER (WHERE pos = 'CO') AS co_i, arg_min(kind, slot) FILTER (WHERE pos = 'CO') AS co_kind,
    arg_min(kind, slot) FILTER (WHERE pos = 'SB') AS sb_kind,
    min(slot) FILTER (WHERE pos IN ('SB', 'BB')) AS blind_i,
    min(slot) FILTER (WHERE me AND slot > m.mi) AS mi2, arg_min(kind, slot) FILTER (WHERE me AND slot > m.mi) AS reply2
  FROM tok t LEFT JOIN mine m ON m.h = t.h AND m.street = 'preflop' WHERE t.street = 'preflop' GROUP BY t.h),
p2 AS (
  SELECT t.h,
    count(*) FILTER (WHERE kind <> 'f' AND nb AND slot < r1) AS front_nonfold,
    count(*) FILTER (WHERE kind = 'c' AND slot > r1 AND slot < mi) AS c_after,
    count(*) FILTER (WHERE kind = 'c' AND nb AND slot > r1 AND slot < mi) AS nb_c_after,
    count(*) FILTER (WHERE kind = 'c' AND pos = 'SB' AND slot > r1 AND slot < mi) AS sb_c_after,
    coalesce(bool_or(bb >= 16) FILTER (WHERE slot = r1 OR (kind = 'c' AND slot > r1 AND slot < mi)), false) AS squeeze_deep,
    count(*) FILTER (WHERE kind <> 'f' AND nb AND slot < co_i) AS co_front,
    count(*) FILTER (WHERE kind = 'r' AND slot > mi AND slot < coalesce(mi2, 99)) AS r_after_me,
    count(*) FILTER (WHERE kind = 'c' AND nb AND slot > mi AND slot < coalesce(mi2, 99)) AS c_after_me,
    arg_min(pos, slot) FILTER (WHERE kind = 'r' AND slot > mi AND NOT me) AS r3_pos,
    arg_min(bb, slot) FILTER (WHERE kind = 'r' AND slot > mi AND NOT me) AS r3_bb,
    arg_min(allin, slot) FILTER (WHERE kind = 'r' AND slot > mi AND NOT me) AS r3_allin
  FROM tok t JOIN p1 USING (h) WHERE t.street = 'preflop' GROUP BY t.h),
later(pos, then_pos) AS (VALUES ('MP', 'CO'), ('MP', 'BTN'), ('MP', 'SB'), ('MP', 'BB'), ('HJ', 'CO'), ('HJ', 'BTN'), ('HJ', 'SB'), ('HJ', 'BB'),
  ('CO', 'BTN'), ('CO', 'SB'), ('CO', 'BB'), ('BTN', 'SB'), ('BTN', 'BB'), ('SB', 'BB')),
behind AS (SELECT m.h, bool_or(o.bb >= 16) AS deep FROM names m JOIN later l ON l.pos = m.pos JOIN names o ON o.h = m.h AND o.pos = l.then_pos WHERE m.name = m.hero GROUP BY m.h),
last_order(pos, o) AS (VALUES ('SB', 0), ('BB', 1), ('UTG', 2), ('UTG+1', 3), ('MP', 4), ('HJ', 6), ('CO', 7), ('BTN', 8)),
pre AS MATERIALIZED (
  SELECT p1.*, p2.* EXCLUDE (h), hd.site, hn.pos AS hpos, coalesce(lh.o, -1) > coalesce(lv.o, -1) AS will_be_ip,
    CASE WHEN hn.pos IN ('UTG', 'UTG+1', 'UTG+2') THEN 'EP' WHEN hn.pos IN ('MP', 'HJ') THEN 'MP' WHEN hn.pos IN ('CO', 'BTN') THEN hn.pos END AS class,
    NOT blocked AND hs.bb >= 16 AND coalesce(b.deep, true) AS open_ok,
    NOT blocked AND hs.bb >= 16 AND coalesce(r1_bb >= 16, true) AS defend_ok,
    NOT blocked AND hs.bb >= 16 AND squeeze_deep AS squeeze_ok,
    NOT blocked AND hs.bb >= 16 AND coalesce(vn.bb >= 16, false) AS blinds_ok,
    NOT blocked AND hs.bb >= 16 AND coalesce(r3_bb >= 16, false) AND NOT coalesce(r3_allin, false) AS fold3_ok
  FROM p1 JOIN p2 USING (h) JOIN hd USING (h) JOIN names hn ON hn.h = p1.h AND hn.name = hd.hero JOIN stacks hs ON hs.h = p1.h AND hs.name = hd.hero
  LEFT JOIN behind b ON b.h = p1.h
  LEFT JOIN names vn ON vn.h = p1.h AND hn.pos IN ('SB', 'BB') AND vn.pos = CASE hn.pos WHEN 'SB' THEN 'BB' ELSE 'SB' END
  LEFT JOIN last_order lh ON lh.pos = hn.pos LEFT JOIN last_order lv ON lv.pos = p2.r3_pos)
"""
)

_CLEAN = "mi IS NOT NULL AND rb = 1 AND front_nonfold = 0"
_THREE = "mi IS NOT NULL AND rb = 1 AND nbc = 0 AND defend_ok"
_BVB = "nb_nonfold = 0 AND blinds_ok AND EXISTS (SELECT 1 FROM names x WHERE x.h = pre.h AND x.pos = 'SB') AND EXISTS (SELECT 1 FROM names x WHERE x.h = pre.h AND x.pos = 'BB')"
_FOLD3 = "mi IS NOT NULL AND reply = 'r' AND front_any = 0 AND r_after_me = 1 AND c_after_me = 0 AND mi2 IS NOT NULL AND r3_pos IS NOT NULL AND fold3_ok"
PRE_SQL = {
    **{
        name: (f"mi IS NOT NULL AND rb = 0 AND nbc = 0 AND open_ok AND class = '{c}'", "reply = 'r'")
        for name, c in (("Early RFI", "EP"), ("Middle RFI", "MP"), ("CO Steal", "CO"), ("BTN Steal", "BTN"))
    },
    **{f"{c} 3bet": (f"{_THREE} AND class = '{c}'", "reply = 'r'") for c in ("EP", "MP", "CO", "BTN")},
    **{f"{c} Cold Call": (f"{_THREE} AND class = '{c}'", "reply = 'c'") for c in ("EP", "MP", "CO", "BTN")},
    "BTN fold to CO steal": ("mi IS NOT NULL AND hpos = 'BTN' AND co_i < mi AND co_kind = 'r' AND co_front = 0 AND defend_ok", "reply = 'f'"),
    "SB UO VPIP": (f"mi IS NOT NULL AND hpos = 'SB' AND blind_i = mi AND {_BVB}", "reply IN ('r', 'c')"),
    "SB Steal": (f"mi IS NOT NULL AND hpos = 'SB' AND blind_i = mi AND {_BVB}", "reply = 'r'"),
    "BB fold vs SB steal": (f"hpos = 'BB' AND sb_kind = 'r' AND {_BVB}", "reply = 'f'"),
    "BB raise vs SB limp UOP": (f"hpos = 'BB' AND sb_kind = 'c' AND {_BVB}", "reply = 'r'"),
    "Squeeze": ("mi IS NOT NULL AND rb = 1 AND c_after > 0 AND squeeze_ok", "reply = 'r'"),
    "Squeeze vs BTN Raiser": ("mi IS NOT NULL AND rb = 1 AND hpos = 'BB' AND r1_pos = 'BTN' AND sb_c_after > 0 AND squeeze_ok", "reply = 'r'"),
    "BB fold vs CO steal": (f"{_CLEAN} AND c_after = 0 AND hpos = 'BB' AND r1_pos = 'CO' AND defend_ok", "reply = 'f'"),
    "BB fold vs BTN steal": (f"{_CLEAN} AND c_after = 0 AND hpos = 'BB' AND r1_pos = 'BTN' AND sb_folded AND defend_ok", "reply = 'f'"),
    "BB resteal vs BTN steal": (f"{_CLEAN} AND c_after = 0 AND hpos = 'BB' AND r1_pos = 'BTN' AND sb_folded AND defend_ok", "reply = 'r'"),
    "SB fold to CO Steal": (f"{_CLEAN} AND nb_c_after = 0 AND hpos = 'SB' AND r1_pos = 'CO' AND btn_folded AND defend_ok", "reply = 'f'"),
    "SB fold to BTN Steal": (f"{_CLEAN} AND nb_c_after = 0 AND hpos = 'SB' AND r1_pos = 'BTN' AND defend_ok", "reply = 'f'"),
    "SB resteal vs BTN": (f"{_CLEAN} AND nb_c_after = 0 AND hpos = 'SB' AND r1_pos = 'BTN' AND defend_ok", "reply = 'r'"),
    "Fold to 3bet": (_FOLD3, "reply2 = 'f'"),
    "Fold to 3bet IP": (f"{_FOLD3} AND will_be_ip", "reply2 = 'f'"),
    "Fold to 3bet OOP": (f"{_FOLD3} AND NOT will_be_ip", "reply2 = 'f'"),
}

POST = (
    TOKENS
    + """,
raisers AS (SELECT h, list(actor ORDER BY slot) FILTER (WHERE kind = 'r') AS rs, list(slot ORDER BY slot) FILTER (WHERE kind = 'r') AS rslots,
    coalesce(bool_or(me AND allin), false) AS hero_allin_pre, min(slot) FILTER (WHERE kind IN ('r', 'c')) AS entry_i, min(slot) FILTER (WHERE me AND kind = 'r') AS my_raise_i,
    min(slot) FILTER (WHERE kind = 'r' AND NOT me) AS opp_raise_i, max(slot) FILTER (WHERE me AND kind = 'c') AS my_last_call_i
  FROM tok WHERE street = 'preflop' GROUP BY h),
third AS (SELECT r.h, min(t.slot) AS first_of_three FROM raisers r JOIN tok t ON t.h = r.h AND t.street = 'preflop' AND t.actor = r.rs[2] AND t.kind = 'r' GROUP BY r.h),
fp AS (SELECT h, count(DISTINCT actor) AS n, bool_or(me) AS me_in, max(ord) FILTER (WHERE NOT me) AS vo, max(ord) FILTER (WHERE me) AS ho, list(DISTINCT actor) AS who FROM tok WHERE street = 'flop' GROUP BY h),
tp AS (SELECT h, count(DISTINCT actor) AS n, bool_or(me) AS me_in, max(ord) FILTER (WHERE NOT me) AS vo, max(ord) FILTER (WHERE me) AS ho FROM tok t
  WHERE street = 'flop' AND NOT EXISTS (SELECT 1 FROM tok f WHERE f.h = t.h AND f.street = 'flop' AND f.actor = t.actor AND f.kind = 'f') GROUP BY h),
st AS MATERIALIZED (
  SELECT t.h, t.street, any_value(m.mi) AS mi, any_value(m.reply) AS reply, arg_min(me, slot) AS first_me, arg_min(kind, slot) AS first_kind, arg_min(actor, slot) AS first_actor, min(slot) AS s0,
    coalesce(bool_or(me AND kind = 'r'), false) AS hero_r, coalesce(bool_or(me AND kind = 'c'), false) AS hero_c, coalesce(bool_or(me AND kind = 'f'), false) AS hero_f,
    coalesce(bool_or(allin AND slot < m.mi), false) AS allin_before, bool_or(allin) AS any_allin,
    min(slot) FILTER (WHERE me AND kind = 'r') AS my_r, max(slot) FILTER (WHERE NOT me AND kind = 'c') AS v_last_call,
    min(slot) FILTER (WHERE NOT me AND kind = 'r') AS v_r, max(slot) FILTER (WHERE me AND kind = 'c') AS my_last_c,
    coalesce(bool_or(kind = 'r' AND NOT me AND slot < m.mi), false) AS r_before
  FROM tok t LEFT JOIN mine m ON m.h = t.h AND m.street = t.street WHERE t.street <> 'preflop' GROUP BY t.h, t.street),
prv AS (SELECT s.h, s.street, t.kind AS prev_kind, t.allin AS prev_allin FROM st s JOIN tok t ON t.h = s.h AND t.street = s.street AND t.slot = s.mi - 1),
second AS (SELECT s.h, t.kind AS k2, t.allin AS a2, t.me AS m2, coalesce((SELECT bool_or(x.me AND x.kind = 'r') FROM tok x WHERE x.h = s.h AND x.street = 'flop' AND x.slot > s.s0 + 1), false) AS hero_r_after
  FROM st s JOIN tok t ON t.h = s.h AND t.street = 'flop' AND t.slot = s.s0 + 1 WHERE s.street = 'flop'),
trap AS (SELECT a.h, min(a.slot) AS i FROM tok a JOIN tok b ON b.h = a.h AND b.street = 'flop' AND b.slot = a.slot + 1 AND b.me AND b.kind = 'r'
  JOIN tok c ON c.h = a.h AND c.street = 'flop' AND c.slot = a.slot + 2 AND c.actor = a.actor AND c.kind = 'r' WHERE a.street = 'flop' AND NOT a.me AND a.kind = 'k' GROUP BY a.h),
trap_f AS (SELECT t.h, coalesce(bool_or(x.me AND x.kind = 'f' AND x.slot > t.i + 2), false) AS folds FROM trap t JOIN tok x ON x.h = t.h AND x.street = 'flop' GROUP BY t.h),
pfr_checks AS (SELECT t.h, true AS y FROM tok t JOIN raisers r USING (h) JOIN st s ON s.h = t.h AND s.street = 'flop' WHERE t.street = 'flop' AND t.slot > s.s0 AND t.kind = 'k' AND t.actor = r.rs[1] GROUP BY t.h),
post AS MATERIALIZED (
  SELECT hd.h, hd.site, hd.shown, hd.hero_won AS won, hn.pos AS hpos,
    coalesce(r.rs[1] = hd.hero, false) AS pfr_me, r.rs[1] AS pfr, coalesce(r.rs[2] = hd.hero, false) AS three_me, r.rs[2] IS NULL AS single, coalesce(r.rs[3] = hd.hero, false) AS four_me,
    coalesce(r.rs[2] <> hd.hero AND r.my_last_call_i > th.first_of_three, false) AS called_three, r.hero_allin_pre,
    coalesce(r.entry_i = r.my_raise_i, false) AS unopened, coalesce(r.my_last_call_i > r.opp_raise_i, false) AS called_opp, r.my_last_call_i IS NOT NULL AS called_any,
    f.h IS NOT NULL AS has_flop, fp.n = 2 AS hu, coalesce(fp.me_in, false) AS in_flop, coalesce(fp.n, 0) AS n_flop, coalesce(list_contains(fp.who, r.rs[1]), false) AS pfr_in,
    CASE WHEN fp.me_in AND fp.ho IS NOT NULL THEN coalesce(fp.vo, -1) <= fp.ho END AS ip,
    tp.n = 2 AS thu, CASE WHEN tp.me_in AND tp.ho IS NOT NULL THEN coalesce(tp.vo, -1) <= tp.ho END AS tip,
    f.mi AS f_mi, f.first_me AS f_first, f.first_kind AS f_kind, f.first_actor AS f_actor, f.reply AS f_reply, f.hero_r AS f_r, f.hero_c AS f_c, f.hero_f AS f_f, f.allin_before AS f_ab, f.any_allin AS f_any,
    f.my_r AS f_my_r, f.v_last_call AS f_vlc, f.v_r AS f_vr, f.my_last_c AS f_mlc, pv.prev_kind, pv.prev_allin,
    sd.k2, sd.a2, sd.m2, sd.hero_r_after, tr.h IS NOT NULL AS trapped, coalesce(tf.folds, false) AS trap_folds, coalesce(pc.y, false) AS pfr_checks,
    t.h IS NOT NULL AS has_turn, t.mi AS t_mi, t.first_me AS t_first, t.first_kind AS t_kind, t.reply AS t_reply, t.hero_f AS t_f, t.any_allin AS t_any, t.v_r AS t_vr, t.s0 AS t_s0,
    rv.h IS NOT NULL AS has_river, rv.mi AS r_mi, rv.hero_r AS r_r, rv.hero_c AS r_c, rv.r_before
  FROM hd JOIN raisers r USING (h) LEFT JOIN third th USING (h) LEFT JOIN names hn ON hn.h = hd.h AND hn.name = hd.hero
  LEFT JOIN fp USING (h) LEFT JOIN tp USING (h) LEFT JOIN st f ON f.h = hd.h AND f.street = 'flop' LEFT JOIN st t ON t.h = hd.h AND t.street = 'turn' LEFT JOIN st rv ON rv.h = hd.h AND rv.street = 'river'
  LEFT JOIN prv pv ON pv.h = hd.h AND pv.street = 'flop' LEFT JOIN second sd ON sd.h = hd.h LEFT JOIN trap tr ON tr.h = hd.h LEFT JOIN trap_f tf ON tf.h = hd.h LEFT JOIN pfr_checks pc ON pc.h = hd.h)
"""
)

_PLACED = "has_flop AND hpos IS NOT NULL"
_OPENER = "pfr_me AND NOT three_me AND NOT called_three AND NOT four_me"
_OPEN = f"{_PLACED} AND {_OPENER} AND unopened AND NOT hero_allin_pre AND hu"
_TO_ME = "prev_kind = 'k' AND NOT f_ab"
_CALLED = "NOT pfr_me AND NOT three_me AND called_opp"
_FACING = f"{_PLACED} AND {_CALLED} AND NOT hero_allin_pre AND hu AND ip AND prev_kind = 'r' AND NOT prev_allin"
_TURN = f"{_PLACED} AND has_turn"
_CPFR = "pfr IS NOT NULL AND NOT pfr_me AND called_any"
_EARLY = "(hero_allin_pre OR coalesce(f_any, false) OR coalesce(t_any, false))"
_PASSIVE = f"{_TURN} AND single AND {_CPFR} AND NOT ip AND f_first AND f_kind = 'k'"
POST_SQL = {
    "Flop CBet IP %": (f"{_OPEN} AND hpos NOT IN ('SB', 'BB') AND ip AND {_TO_ME}", "f_r"),
    "Flop CBet 3BetPot IP": (f"{_PLACED} AND three_me AND NOT pfr_me AND NOT hero_allin_pre AND ip AND hu AND pfr_in AND {_TO_ME}", "f_r"),
    "Flop CBet OOP%": (f"{_OPEN} AND hpos NOT IN ('SB', 'BB', 'BTN/SB') AND NOT ip AND f_first", "f_kind = 'r'"),
    "Flop fold vs Cbet IP": (_FACING, "f_f"),
    "Flop raise Cbet IP": (_FACING, "f_r"),
    "Flop raise Cbet OOP": (f"{_PLACED} AND NOT pfr_me AND hu AND NOT ip AND f_first AND f_kind = 'k' AND k2 = 'r' AND NOT a2 AND NOT m2", "hero_r_after"),
    "Fold vs Check Raise": (f"{_PLACED} AND hu AND trapped", "trap_folds"),
    "Flop bet vs missed Cbet SRP": (f"{_PLACED} AND single AND {_CALLED} AND NOT hero_allin_pre AND hu AND ip AND f_actor = pfr AND f_kind = 'k' AND f_mi IS NOT NULL AND NOT f_ab", "f_r"),
    "Turn CBet IP%": (f"{_TURN} AND {_OPENER} AND ip AND f_my_r < f_vlc AND thu AND tip AND t_kind = 'k' AND t_mi IS NOT NULL", "t_reply = 'r'"),
    "Turn Cbet OOP%": (f"{_TURN} AND {_OPENER} AND NOT ip AND f_my_r < f_vlc AND thu AND NOT tip AND t_first", "t_kind = 'r'"),
    "Turn donk bet": (f"{_TURN} AND f_c AND thu AND NOT tip AND t_first", "t_kind = 'r'"),
    "Turn donk bet SRP vs PFR": (f"{_TURN} AND single AND {_CPFR} AND f_c AND thu AND NOT tip AND t_first", "t_kind = 'r'"),
    "Bet turn vs Missed Flop Cbet OOP SRP": (f"{_PASSIVE} AND pfr_checks AND thu AND NOT tip AND t_first", "t_kind = 'r'"),
    "Turn Fold vs CBet OOP": (f"{_PASSIVE} AND f_vr < f_mlc AND thu AND NOT tip AND t_first AND t_kind = 'k' AND t_vr > t_s0", "t_f"),
    "WTSD%": (f"has_flop AND in_flop AND NOT {_EARLY}", "shown"),
    "W$SD%": (f"has_flop AND in_flop AND shown AND NOT {_EARLY}", "won"),
    "W$WSF Rating": ("has_flop AND in_flop", "won"),
    "River bet - Single Rsd Pot": (f"has_river AND has_flop AND single AND NOT {_EARLY} AND hu AND r_mi IS NOT NULL AND NOT r_before", "r_r"),
    "W$SD% B River": ("has_river AND shown AND has_flop AND hu AND r_r", "won"),
}


def _count(source: str, table: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT site, '{name}' AS stat_id, count(*) FILTER (WHERE {opp}) AS opportunities, count(*) FILTER (WHERE {opp} AND coalesce({att}, false)) AS attempts"
        f" FROM {source} GROUP BY site HAVING count(*) FILTER (WHERE {opp}) > 0"
        for name, (opp, att) in table.items()
    )


def _counts(spark, sf_dir, names):
    flagged, stats = counters.with_flags(counters.read_hands(handtext.texts(spark, sf_dir)), list(names))
    return counters.count_flags(flagged, [(n, None) for n in stats], ["site"])


@query("preflop_counters", f"{TOKENS} {_count('pre', PRE_SQL)}")
def preflop_counters(spark, sf_dir):
    return _counts(spark, sf_dir, PRE_SQL)


_RIVER_AGG = f"has_river AND NOT {_EARLY}"


@query(
    "postflop_counters",
    f"""{POST} {_count('post', POST_SQL)} UNION ALL SELECT site, 'River Agg %', count(*) FILTER (WHERE {_RIVER_AGG} AND r_c), count(*) FILTER (WHERE {_RIVER_AGG} AND r_r) FROM post GROUP BY site
      HAVING count(*) FILTER (WHERE {_RIVER_AGG} AND (r_c OR r_r)) > 0""",
)
def postflop_counters(spark, sf_dir):
    return _counts(spark, sf_dir, [*POST_SQL, "River Agg %"])


@query(
    "seat_vpip",
    f"""{TOKENS}, parts AS ({_count('pre', {k: v for k, v in PRE_SQL.items() if k.endswith(('3bet', 'Cold Call')) and not k.startswith('Fold')})})
    SELECT site, split_part(stat_id, ' ', 1) || ' VPIP' AS stat_id, max(opportunities) AS opportunities, CAST(sum(attempts) AS BIGINT) AS attempts FROM parts GROUP BY 1, 2""",
)
def seat_vpip(spark, sf_dir):
    names = [k for k in PRE_SQL if k.endswith(("3bet", "Cold Call"))]
    return cubes.vpip_from_parts(_counts(spark, sf_dir, names), ["site"], ["EP", "MP", "CO", "BTN"])


@query("flop_player_sums", f"{POST} SELECT site, CAST(sum(CASE WHEN has_flop AND in_flop THEN n_flop ELSE 0 END) AS BIGINT) AS player_sum FROM post GROUP BY site")
def flop_player_sums(spark, sf_dir):
    return counters.flop_player_sums(handtext.texts(spark, sf_dir), ["site"])


@query(
    "win_rating",
    f"""{POST}, c AS (SELECT site, count(*) FILTER (WHERE has_flop AND in_flop) AS o, count(*) FILTER (WHERE has_flop AND in_flop AND won) AS a, sum(CASE WHEN has_flop AND in_flop THEN n_flop ELSE 0 END) AS p FROM post GROUP BY site)
    SELECT site, round(CAST(a AS DOUBLE) / o * (CAST(p AS DOUBLE) / o), 2) AS rating FROM c""",
)
def win_rating(spark, sf_dir):
    from tallyhand.functions.scoring import performance_ratio

    flagged, stats = counters.with_flags(counters.read_hands(handtext.texts(spark, sf_dir)))
    i = stats.index(cubes.WIN_RATING)
    sums = flagged.groupBy("site").agg(
        F.sum(F.col(f"o{i}").cast("int")).alias("o"), F.sum(F.col(f"a{i}").cast("int")).alias("a"), F.sum("player_sum").alias("p")
    )
    return sums.select("site", performance_ratio(F.col("a"), F.col("o"), F.col("p")).alias("rating"))


# --- the same hands as five sites print them ----------------------------------------------------

# only seat lines with "in chips" tell what the all-in arithmetic needs
_CHIPS = "coalesce(a.street <> 'preflop' AND a.h % 6 IN (0, 1) AND a.type"


def _of_sites(sql: str) -> str:
    return sql.replace("coalesce(a.street <> 'preflop' AND a.type", _CHIPS)


def _printed(spark, sf_dir, names):
    flagged, stats = counters.with_flags(counters.read_hands(handtext.site_texts(spark, sf_dir)), list(names))
    return counters.count_flags(flagged, [(n, None) for n in stats], ["site"])


@query("site_preflop_counters", f"SELECT * FROM ({_of_sites(TOKENS)} {_count('pre', PRE_SQL)}) WHERE site <> 'other'")
def site_preflop_counters(spark, sf_dir):
    """Pre-flop counters of hands that each site prints in its own form."""
    return _printed(spark, sf_dir, PRE_SQL)


@query("site_postflop_counters", f"SELECT * FROM ({_of_sites(POST)} {_count('post', POST_SQL)}) WHERE site <> 'other'")
def site_postflop_counters(spark, sf_dir):
    """Post-flop counters likewise."""
    return _printed(spark, sf_dir, POST_SQL)


@query(
    "site_players",
    f"""{duck.BASE}, n AS (SELECT h, count(*) AS n_seats FROM seated GROUP BY h), w AS (SELECT h, count(DISTINCT actor) + 1 AS n_who FROM acts WHERE street = 'preflop' GROUP BY h),
    p AS (SELECT h, site, CAST(CASE WHEN site = '888' THEN n_who ELSE n_seats END AS INT) AS players FROM hd JOIN n USING (h) JOIN w USING (h) WHERE site <> 'other')
    SELECT h, site, players, CASE WHEN players < 4 THEN 'discard' WHEN players <= 6 THEN '6-max' ELSE '9-max' END AS format,
      CASE site WHEN 'gg' THEN 'ggpoker' WHEN '888' THEN '888poker' ELSE site END AS detected FROM p""",
)
def site_players(spark, sf_dir):
    """Players, table format and site told from each site's text."""
    t = F.col("text")
    return handtext.site_texts(spark, sf_dir).select(
        "h", "site", ht.active_players(t).alias("players"), ht.table_format(t).alias("format"), ht.source_site(t, F.lit("x.txt")).alias("detected")
    )


@query(
    "site_action_rows",
    f"""{duck.BASE} SELECT h, street, CAST(row_number() OVER (PARTITION BY h, street ORDER BY slot) - 1 AS INT) AS pos, actor AS player,
      CASE WHEN type = 'FOLD' THEN 'folds' WHEN type = 'CHECK' THEN 'checks' WHEN type = 'CALL' THEN 'calls' WHEN type = 'BET' THEN 'bets' ELSE 'raises' END AS verb,
      CASE WHEN street = 'preflop' OR type IN ('FOLD', 'CHECK') THEN 0.0 ELSE round(amount, 2) END AS amount, type = 'ALLIN' AS allin
    FROM acts JOIN hd USING (h) WHERE type NOT IN ('POST_SB', 'POST_BB') AND site <> 'other'""",
)
def site_action_rows(spark, sf_dir):
    """Action lines of all five forms, with who did what and for how much."""
    return handtext.site_texts(spark, sf_dir).select("h", F.inline(ht.hand_actions(F.col("text"))))
