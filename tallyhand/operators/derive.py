"""Per-hand facts from ordered actions.

Every step is a narrow projection over the hand row: no shuffle, no window, and
the arrays it reads are bounded by the rules of the game. The result columns feed
the metric catalogue, which is the first (and only) wide stage.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tallyhand.functions import seats
from tallyhand.functions.columns import any_of, lookup, steady_round, yes
from tallyhand.functions.words import ANY, HERO, NOT_HERO, RAISER, but, has, street_word

POST_STREETS = ["flop", "turn", "river"]
OPENING = ["RAISE", "ALLIN"]
RAISING = ["RAISE", "RERAISE", "ALLIN"]
AGGRESSIVE = ["BET", "RAISE", "ALLIN"]

# regex classes over the verb letters
_OPEN, _RAISE, _AGGR, _VOLUNTARY = "[ra]", "[rea]", "[bra]", "[creab]"
_NOT_AGGR = "[^bra]"

_NO_ACTIONS = "array<struct<actor:string,type:string,amount:double,to_amount:double,allin:boolean,raw_offset:int>>"


def _actions(street: str) -> Column:
    return F.coalesce(F.col(f"streets.{street}.actions"), F.array().cast(_NO_ACTIONS))


def _actors(actions: Column, kinds: list[str]) -> Column:
    return F.transform(F.filter(actions, lambda a: a["type"].isin(kinds)), lambda a: a["actor"])


def _last(arr: Column) -> Column:
    return F.get(arr, F.size(arr) - 1)


def _named(name: Column) -> Column:
    return F.nullif(name, F.lit(""))


def with_actors(hands: DataFrame) -> DataFrame:
    """Who raised when; the roster; seat positions."""
    df = hands.withColumns({f"_a_{s}": _actions(s) for s in ["preflop", *POST_STREETS, "showdown"]})
    df = df.withColumns(
        {
            "_openers": _actors(F.col("_a_preflop"), OPENING),
            "_raisers": _actors(F.col("_a_preflop"), RAISING),
            "_betters": _actors(F.col("_a_preflop"), AGGRESSIVE),
            "positions": seats.named_positions(F.col("players"), F.col("button_seat")),
            "_roster": F.array_distinct(
                F.flatten(F.array(*[F.transform(F.col(f"_a_{s}"), lambda a: a["actor"]) for s in ["preflop", *POST_STREETS]]))
            ),
        }
    )
    return df.withColumns(
        {
            "open_raiser": F.get("_openers", F.lit(0)),
            "three_bettor": F.get("_raisers", F.lit(1)),
            "four_bettor": F.get("_raisers", F.lit(2)),
            "pot_type": F.when(F.size("_raisers") == 0, "none")
            .when(F.size("_raisers") == 1, "SRP")
            .when(F.size("_raisers") == 2, "3bet")
            .otherwise("4bet"),
            "pfr_player": F.coalesce(
                _named(F.get("_raisers", F.lit(2))),
                _named(F.get("_raisers", F.lit(1))),
                _named(F.get("_openers", F.lit(0))),
                _last(F.col("_betters")),
            ),
            "n_players": F.coalesce(F.size("players"), F.lit(0)),
        }
    )


def with_words(df: DataFrame) -> DataFrame:
    """One street word per round, plus the hero's and the opener's position."""
    hero, pfr, roster = F.col("hero"), F.col("pfr_player"), F.col("_roster")
    return df.withColumns(
        {
            **{f"_w_{s}": street_word(F.col(f"_a_{s}"), hero, pfr, roster) for s in ["preflop", *POST_STREETS]},
            "hero_position": seats.position_of(F.col("positions"), hero),
            "open_raiser_position": seats.position_of(F.col("positions"), F.col("open_raiser")),
        }
    )


def pot_at_flop(bb: Column, sb: Column, ante: Column, n_in: Column, actions: Column) -> Column:
    """Pot when the flop comes, in big blinds.

    The state is (pot, price to call, what each actor has in); it is folded over the
    actions, so a raise given only as an increment still prices the next call.
    """
    posts = F.filter(actions, lambda a: a["type"].isin("POST_SB", "POST_BB", "POST_ANTE"))
    blind_money = sb + bb + F.when(ante > 0, ante * n_in).otherwise(F.lit(0.0))

    def put_in(acc: Column, who: Column) -> Column:
        return F.coalesce(F.try_element_at(acc["put"], who), F.lit(0.0))

    def set_put(acc: Column, who: Column, total: Column) -> Column:
        rest = F.map_filter(acc["put"], lambda k, _: k != who)
        return F.map_concat(rest, F.create_map(who, total))

    def state(pot: Column, price: Column, put: Column) -> Column:
        return F.struct(pot.alias("pot"), price.alias("price"), put.alias("put"))

    start = state(F.lit(0.0), bb, F.create_map().cast("map<string,double>"))

    def post(acc: Column, a: Column) -> Column:
        money = F.coalesce(a["amount"], F.lit(0.0))
        return F.when(
            (money != 0) & a["actor"].isNotNull(),
            state(acc["pot"] + money, acc["price"], set_put(acc, a["actor"], put_in(acc, a["actor"]) + money)),
        ).otherwise(acc)

    def play(acc: Column, a: Column) -> Column:
        mine, to, amount = put_in(acc, a["actor"]), F.coalesce(a["to_amount"], F.lit(0.0)), F.coalesce(a["amount"], F.lit(0.0))
        called = F.greatest(mine, acc["price"])
        return (
            F.when(a["actor"].isNull(), acc)
            .when(
                a["type"] == "CALL",
                state(acc["pot"] + called - mine, acc["price"], set_put(acc, a["actor"], called)),
            )
            .when(
                a["type"].isin(RAISING) & (to > 0),
                state(acc["pot"] + F.greatest(F.lit(0.0), to - mine), to, set_put(acc, a["actor"], to)),
            )
            .when(
                a["type"].isin(RAISING) & (amount != 0),
                state(acc["pot"] + amount, mine + amount, set_put(acc, a["actor"], mine + amount)),
            )
            .otherwise(acc)
        )

    posted = F.aggregate(posts, start, post)
    funded = F.transform(
        F.array(posted),
        lambda s: state(F.when((s["price"] > 0) & (s["pot"] == 0), blind_money).otherwise(s["pot"]), s["price"], s["put"]),
    )
    played = F.aggregate(actions, F.get(funded, F.lit(0)), play, lambda s: s["pot"])
    return F.when(
        bb > 0,
        F.when(F.size(actions) == 0, steady_round(blind_money / bb, 2)).when(played > 0, steady_round(played / bb, 2)),
    )


def with_preflop(df: DataFrame) -> DataFrame:
    w, hero = F.col("_w_preflop"), F.col("hero")
    opener_pos, hero_pos = F.col("open_raiser_position"), F.col("hero_position")
    has_hero = F.coalesce(hero, F.lit("")) != ""
    unopened = has(w, f"^(?:{NOT_HERO}[^reac])*(?:H|$)")
    leads = has(w, f"^(?:{NOT_HERO}[^ra])*H{_OPEN}")
    any_limp = has(w, f"^(?:{ANY}[^reac])*{ANY}c")
    bb = F.coalesce(F.try_element_at("blinds", F.lit("bb")), F.lit(0.0))
    sb = F.coalesce(F.try_element_at("blinds", F.lit("sb")), F.lit(0.0))
    ante = F.coalesce(F.try_element_at("blinds", F.lit("ante")), F.lit(0.0))
    n_in = F.when(F.coalesce(F.size("players_dealt_in"), F.lit(0)) > 0, F.size("players_dealt_in")).otherwise(
        F.col("n_players")
    )

    def did(pos: str, kind: str) -> Column:
        who = seats.player_at(F.col("positions"), F.lit(pos))
        return yes(F.exists("_a_preflop", lambda a: (a["actor"] == who) & (a["type"] == kind)))

    return df.withColumns(
        {
            "hero_vpip": has(w, f"^(?:{NOT_HERO}.|H[^creabfk])*H{_VOLUNTARY}"),
            "pot_size_bb": pot_at_flop(bb, sb, ante, n_in, F.col("_a_preflop")),
            "unopened_pot": unopened,
            "has_limper_before_hero": has_hero & has(w, f"^(?:{NOT_HERO}[^reac])*{NOT_HERO}c"),
            "hero_raised_first_in": unopened & leads,
            "is_isoraiser": ~unopened & leads & any_limp,
            "faced_3bet": yes(F.col("open_raiser") == hero) & has(w, f"H{_OPEN}.*(?:{NOT_HERO}{_RAISE}|He)"),
            "folded_to_3bet": has(w, f"^(?:H.|{NOT_HERO}[^rea])*{NOT_HERO}{_RAISE}(?:{NOT_HERO}.)*Hf"),
            "is_squeeze": has(w, f"{ANY}{_OPEN}.*{ANY}c.*H{_RAISE}"),
            "is_resteal_vs_btn": yes(F.col("open_raiser") != hero)
            & yes(opener_pos == "BTN")
            & yes(hero_pos.isin("SB", "BB"))
            & yes(F.col("three_bettor") == hero),
            "freeplay_bb": ~has(w, f"{ANY}{_OPEN}") & did("SB", "CALL") & did("BB", "CHECK"),
            "hero_pos_group": seats.bucket_of(hero_pos),
            "hero_is_three_bettor": yes(F.col("three_bettor") == hero),
        }
    )


def with_position_play(df: DataFrame) -> DataFrame:
    """Players left per street, heads-up flags and whether the hero acts last."""

    def still_in(before: Column, street: str) -> Column:
        folded = _actors(F.col(f"_a_{street}"), ["FOLD"])
        return F.filter(before, lambda p: ~F.array_contains(folded, p))

    dealt = F.coalesce(F.col("players_dealt_in"), F.array().cast("array<string>"))
    df = df.withColumn("_in_flop", still_in(dealt, "preflop"))
    df = df.withColumn("_in_turn", still_in(F.col("_in_flop"), "flop"))
    df = df.withColumn("_in_river", still_in(F.col("_in_turn"), "turn"))

    def hero_last(street: str) -> Column:
        pair, acts = F.col(f"_in_{street}"), F.col(f"_a_{street}")
        first = F.get(F.filter(acts, lambda a: F.array_contains(pair, a["actor"])), F.lit(0))["actor"]
        return F.when((F.size(pair) == 2) & F.array_contains(pair, F.col("hero")), first != F.col("hero"))

    out = {}
    for s in POST_STREETS:
        out[f"players_to_{s}"] = F.size(f"_in_{s}")
        out[f"heads_up_{s}"] = F.size(f"_in_{s}") == 2
        out[f"hero_ip_{s}"] = hero_last(s)
    return df.withColumns(out)


def with_stacks(df: DataFrame) -> DataFrame:
    """Effective and opponent stacks in big blinds. All eight fields are filled."""
    hero, players, positions = F.col("hero"), F.col("players"), F.col("positions")
    bb = F.coalesce(F.try_element_at("blinds", F.lit("bb")), F.lit(0.0))

    def chips(name: Column) -> Column:
        return F.get(F.filter(players, lambda p: p["name"] == name), F.lit(0))["stack_chips"]

    def in_bb(value: Column) -> Column:
        return F.when(bb > 0, F.round(value / bb, 2))

    def both(one: Column, two: Column) -> Column:
        return F.when(one.isNotNull() & two.isNotNull(), F.least(one, two))

    folded = _actors(F.col("_a_preflop"), ["FOLD"])
    alive = F.filter(F.transform(players, lambda p: p["name"]), lambda n: ~F.array_contains(folded, n))
    villain = F.when(F.get(alive, F.lit(1)) == hero, F.get(alive, F.lit(0))).otherwise(F.get(alive, F.lit(1)))
    heads_up = (F.size("_a_preflop") > 0) & (F.size(alive) == 2) & F.array_contains(alive, hero)

    hero_turn = lookup(seats.PLAY_ORDER, F.col("hero_position"))
    later = F.filter(positions, lambda x: lookup(seats.PLAY_ORDER, x["pos"]) > hero_turn)
    later_chips = F.filter(F.transform(later, lambda x: chips(x["name"])), lambda v: v.isNotNull())
    later_mean = F.when(
        F.size(later_chips) > 0,
        F.aggregate(later_chips, F.lit(0.0), lambda acc, v: acc + v) / F.size(later_chips),
    )

    seen = F.instr("_w_preflop", HERO)
    before_hero = F.when(seen > 0, F.slice("_a_preflop", 1, ((seen - 1) / 2).cast("int"))).otherwise(F.col("_a_preflop"))
    first_caller = F.get(F.filter(before_hero, lambda a: a["type"] == "CALL"), F.lit(0))["actor"]
    other_blind = F.when(F.col("hero_position") == "SB", seats.player_at(positions, F.lit("BB"))).when(
        F.col("hero_position") == "BB", seats.player_at(positions, F.lit("SB"))
    )

    return df.withColumns(
        {
            "eff_stack_srp": F.when(heads_up, in_bb(both(chips(hero), chips(villain)))),
            "eff_stack_vs_3bet": in_bb(both(chips(hero), chips(F.col("three_bettor")))),
            "hero_stack_bb": in_bb(chips(hero)),
            "avg_stacks_after_hero_bb": in_bb(later_mean),
            "raiser_stack_bb": in_bb(chips(F.col("open_raiser"))),
            "three_bettor_stack_bb": in_bb(chips(F.col("three_bettor"))),
            "squeeze_avg_stack_bb": F.when(
                F.coalesce(hero, F.lit("")) != "",
                in_bb((chips(F.col("open_raiser")) + chips(first_caller)) / 2),
            ),
            "bvb_villain_stack_bb": in_bb(chips(other_blind)),
        }
    )


def stack_rules(min_bb: float = 16.0) -> dict[str, Column]:
    """Stack tests of an opportunity, average form, over the columns of ``with_stacks``.

    Nobody left behind the hero passes the opening test; an unknown raiser, caller,
    3-bettor or blind fails the others.
    """
    deep = lambda name: yes(F.col(name) >= min_bb)
    hero = deep("hero_stack_bb")
    behind = F.coalesce(F.col("avg_stacks_after_hero_bb") >= min_bb, F.lit(True))
    return {
        "open_ok": hero & behind,
        "defend_ok": hero & deep("raiser_stack_bb"),
        "squeeze_ok": hero & deep("squeeze_avg_stack_bb"),
        "fold3_ok": hero & deep("three_bettor_stack_bb"),
        "blinds_ok": hero & deep("bvb_villain_stack_bb"),
    }


def faces_check_raise(word: Column) -> tuple[Column, Column]:
    """(faced, folded): someone who checked before a hero bet raises after it.

    The set of players who may check-raise depends on the bet in question, so the
    answer pattern is built per bet; the static test in front keeps that off
    almost every row.
    """
    faced = has(word, rf"({ANY})k.*H{_AGGR}.*\1{_OPEN}")

    def folds_after(i: Column) -> Column:
        checkers = F.regexp_replace(F.substring(word, F.lit(1), i * 2), f"{ANY}[^k]|k", "")
        rest = F.substring(word, i * 2 + 3, F.length(word))
        bet_here = F.substring(word, i * 2 + 1, F.lit(2)).rlike(f"H{_AGGR}")
        pattern = F.concat(
            F.lit("^(?:[^"), checkers, F.lit("][a-z]|["), checkers, F.lit("][^ra])*["), checkers,
            F.lit(f"]{_OPEN}(?:{NOT_HERO}.)*Hf"),
        )
        return bet_here & (checkers != "") & F.regexp(rest, pattern)

    bets = F.sequence(F.lit(0), (F.length(word) / 2 - 1).cast("int"))
    return faced, F.when(faced, F.exists(bets, folds_after)).otherwise(F.lit(False))


def with_postflop(df: DataFrame) -> DataFrame:
    word = {s: F.col(f"_w_{s}") for s in POST_STREETS}
    hero, pfr = F.col("hero"), F.col("pfr_player")
    has_hero = F.coalesce(hero, F.lit("")) != ""
    is_pfr = yes(hero == pfr)
    vs_pfr = has_hero & pfr.isNotNull() & (pfr != "") & ~is_pfr
    saw = {s: F.size(f"_a_{s}") > 0 for s in POST_STREETS}
    won = has_hero & yes(F.array_contains("winners", hero))
    showdown = (F.size("_a_showdown") > 0) | any_of(
        *[has(F.col(f"_w_{s}"), f"{ANY}[sm]") for s in ["preflop", *POST_STREETS]]
    )

    def live(s: str) -> Column:
        return has_hero & saw["flop"] & saw[s]

    def in_place(s: str, side: str) -> Column:
        ip = F.col(f"hero_ip_{s}")
        return yes(ip) if side == "ip" else yes(~ip)

    # nobody has bet when the hero's turn comes / the hero then bets
    to_hero = {s: live(s) & has(word[s], f"^(?:{NOT_HERO}{_NOT_AGGR})*H") for s in POST_STREETS}
    hero_bets = {s: live(s) & has(word[s], f"^(?:{NOT_HERO}{_NOT_AGGR})*H{_AGGR}") for s in POST_STREETS}
    raiser_checked = {s: has(word[s], f"^(?:{but('P')}.|P[^kbra])*Pk") for s in POST_STREETS}

    def answer(s: str, verb: str) -> Column:
        return live(s) & vs_pfr & has(
            word[s], f"^(?:{NOT_HERO}{_NOT_AGGR})*{RAISER}{_AGGR}(?:{NOT_HERO}.)*{HERO}{verb}"
        )

    out: dict[str, Column] = {}
    for s, prev in zip(POST_STREETS, [None, "flop", "turn"]):
        out[f"saw_{s}"] = saw[s]
        hero_acts = F.regexp_count(word[s], F.lit("H"))
        out[f"agg_pct_{s}"] = F.when(
            has_hero & saw[s],
            F.when(
                hero_acts > 0, F.round(100.0 * F.regexp_count(word[s], F.lit(f"H{_AGGR}")) / hero_acts, 2)
            ).otherwise(F.lit(0.0)),
        )
        probing = vs_pfr & raiser_checked[prev] if prev else F.lit(False)
        missed = vs_pfr & (F.col("pot_type") == "SRP")
        for side in ("ip", "oop"):
            here = in_place(s, side)
            out[f"cbet_{s}_opp_{side}"] = is_pfr & here & to_hero[s]
            out[f"cbet_{s}_att_{side}"] = is_pfr & here & hero_bets[s]
            for name, verb in (("fold", "f"), ("call", "c"), ("raise", _AGGR)):
                out[f"vs_cbet_{s}_{name}_{side}"] = here & answer(s, verb)
            out[f"probe_{s}_opp_{side}"] = probing & here & to_hero[s]
            out[f"probe_{s}_att_{side}"] = probing & here & hero_bets[s]
            out[f"bet_vs_missed_{s}_opp_{side}"] = missed & here & to_hero[s]
            out[f"bet_vs_missed_{s}_att_{side}"] = missed & here & hero_bets[s]
        donk = live(s) & vs_pfr & in_place(s, "oop")
        out[f"donk_{s}_opp"] = donk & has(word[s], f"^(?:{but('HP')}.)*H")
        out[f"donk_{s}_att"] = donk & has(word[s], f"^(?:{but('HP')}.)*H{_AGGR}")
        out[f"xr_{s}_opp"] = live(s) & has(word[s], f"Hk.*{ANY}{_AGGR}")
        out[f"xr_{s}_att"] = live(s) & has(
            word[s], f"^(?:{NOT_HERO}.|H[^k])*Hk(?:{ANY}{_NOT_AGGR})*{ANY}{_AGGR}(?:{NOT_HERO}.)*H{_OPEN}"
        )
    for s, prev in (("turn", "flop"), ("river", "turn")):
        quiet = is_pfr & ~(hero_bets[prev] & F.col(f"hero_ip_{prev}").isNotNull())
        for side in ("ip", "oop"):
            out[f"delayed_cbet_{s}_opp_{side}"] = quiet & in_place(s, side) & to_hero[s]
            out[f"delayed_cbet_{s}_att_{side}"] = quiet & in_place(s, side) & hero_bets[s]

    traps = [faces_check_raise(word[s]) for s in POST_STREETS]
    river_srp = (F.col("pot_type") == "SRP") & F.col("heads_up_river")
    bet_river = live("river") & showdown & has(word["river"], f"H{_AGGR}")
    out |= {
        "saw_showdown": showdown,
        "won_showdown": won,
        "won_when_saw_flop": saw["flop"] & won,
        "fold_vs_check_raise_opp": any_of(*[live(s) & t[0] for s, t in zip(POST_STREETS, traps)]),
        "fold_vs_check_raise_att": any_of(*[live(s) & t[1] for s, t in zip(POST_STREETS, traps)]),
        "river_bet_srp_opp": river_srp & to_hero["river"],
        "river_bet_srp_att": river_srp & hero_bets["river"],
        "w_sd_b_river_opp": bet_river,
        "w_sd_b_river_att": bet_river & won,
    }
    df = df.withColumns(out)
    return df.withColumns(
        {
            "wtsd": F.col("saw_showdown") & F.col("saw_flop") & has_hero,
            "w_sd": F.col("won_showdown") & F.col("saw_flop") & has_hero,
            "w_wsf": F.col("won_when_saw_flop") & has_hero,
            "river_agg_pct": F.col("agg_pct_river"),
            "donk_flop": F.col("donk_flop_att"),
            "donk_turn": F.col("donk_turn_att"),
            "flop_bet_vs_missed_cbet_srp": F.col("bet_vs_missed_flop_att_ip") | F.col("bet_vs_missed_flop_att_oop"),
            "turn_bet_vs_missed_cbet_srp_oop": F.col("bet_vs_missed_turn_att_oop"),
            "any_allin_preflop": F.coalesce(F.col("any_allin_preflop"), F.lit(False)),
            "table_max_resolved": F.when(F.coalesce("table_max", F.lit(0)) != 0, F.col("table_max")).otherwise(
                F.col("n_players")
            ),
        }
    )


def derive_facts(hands: DataFrame) -> DataFrame:
    """Hands plus every derived fact as a flat column."""
    df = with_actors(hands)
    for step in (with_words, with_preflop, with_position_play, with_stacks, with_postflop):
        df = step(df)
    return df.drop(*[c for c in df.columns if c.startswith("_")])


# which fact belongs to which part of the nested form
def _section(name: str) -> str:
    if name in ("positions", "table_max_resolved", "hero_pos_group"):
        return "positions"
    if name.startswith(("players_to_", "heads_up_", "hero_ip_")):
        return "ip"
    if name.endswith("_stack_bb") or name.startswith(("eff_stack_", "avg_stacks_")):
        return "stacks"
    if name == "any_allin_preflop":
        return "flags"
    if name in PREFLOP_FACTS:
        return "preflop"
    return "postflop"


PREFLOP_FACTS = [
    "open_raiser", "open_raiser_position", "three_bettor", "four_bettor", "pot_type", "hero_position",
    "hero_vpip", "pot_size_bb", "unopened_pot", "has_limper_before_hero", "hero_raised_first_in",
    "is_isoraiser", "faced_3bet", "folded_to_3bet", "is_squeeze", "is_resteal_vs_btn", "freeplay_bb",
    "hero_is_three_bettor",
]


def enrich_hands(hands: DataFrame) -> DataFrame:
    """Hands plus one nested ``derived`` column (positions, preflop, ip, stacks, flags, postflop)."""
    flat = derive_facts(hands)
    facts = [c for c in flat.columns if c not in hands.columns or c == "any_allin_preflop"]
    facts = [c for c in facts if c != "n_players"]
    parts: dict[str, list[str]] = {}
    for name in facts:
        parts.setdefault(_section(name), []).append(name)
    derived = F.struct(*[F.struct(*cols).alias(part) for part, cols in parts.items()]).alias("derived")
    return flat.select(*hands.columns, derived)


def hand_context(enriched: DataFrame) -> DataFrame:
    """Flatten ``derived`` again for readers of stored enriched hands.

    Missing booleans become False; the three-valued in-position flags, the stacks
    and the percentages keep their NULL.
    """
    parts = enriched.schema["derived"].dataType
    cols = []
    for part in parts.fields:
        for field in part.dataType.fields:
            col = F.col(f"derived.{part.name}.{field.name}")
            if field.dataType.typeName() == "boolean" and not field.name.startswith("hero_ip_"):
                col = F.coalesce(col, F.lit(False))
            cols.append(col.alias(field.name))
    base = [c for c in enriched.columns if c not in ("derived", "any_allin_preflop")]
    return enriched.select(*base, *cols)
