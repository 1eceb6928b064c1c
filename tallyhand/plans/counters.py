"""Counters over raw hand text: the second, older metric family.

A hand's text is read once into seats, stacks and action arrays; each street then
becomes a word (see ``functions.words``) whose upper-case letters are *positions*
here. Opportunity and attempt are patterns over those words. The counts go through
the same one-shuffle job as the catalogue.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tallyhand.functions import handtext as ht
from tallyhand.functions import seats, words
from tallyhand.functions.columns import lookup, yes
from tallyhand.functions.words import has
from tallyhand.operators.cube import vpip_from_parts
from tallyhand.plans.opportunities import count_flags

MIN_BB = 16.0

# position letters; the hero is H, anybody without a known seat gets a letter of their own
LETTER = {
    "SB": "S", "BB": "D", "UTG": "U", "UTG+1": "V", "UTG+2": "W", "MP": "M", "HJ": "J", "CO": "C",
    "BTN": "B", "BTN/SB": "T",
}
# order of play after the flop
POST_ORDER = {
    "SB": 0, "BB": 1, "UTG": 2, "UTG+1": 3, "UTG+2": 4, "MP": 5, "MP+1": 6, "MP+2": 7, "HJ": 8, "CO": 9,
    "BTN": 10, "BTN/SB": 11,
}
# The order used to tell who will be last after a 3-bet; names that
# are not listed come before all others.
LAST_ORDER = {"SB": 0, "BB": 1, "UTG": 2, "UTG+1": 3, "MP": 4, "MP+1": 5, "HJ": 6, "CO": 7, "BTN": 8}
# order used to find who is still to act when the hero may open
OPEN_ORDER = {"MP": 1, "HJ": 1, "CO": 2, "BTN": 3, "SB": 4, "BB": 5}

ANY, NH = words.ANY, words.NOT_HERO  # anybody; anybody but the hero
NB = words.but("HSD")  # neither the hero nor a blind
QUIET = "[fkz]"  # fold, check, bare all-in line
RAISED, CALLED = "[rx]", "[cy]"
# before or after a raise, nobody raises and only blinds call
_FLAT = f"(?:{NB}{QUIET}|[SD][fkzcy])*"
# everybody but the blinds folds
_FOLDED = f"(?:{NB}f|[SD][a-z])*"


def read_hands(hands: DataFrame, text: str = "text") -> DataFrame:
    """Parse hand texts into the columns the counters need.

    All of a hand's actors are listed once, so two without a known seat are never taken for one.
    """
    t = F.col(text)
    df = hands.withColumns(
        {
            "_hero": ht.hero_name(t),
            "_seats": ht.seat_list(t),
            "_button": ht.button_seat(t),
            "_stacks": ht.stack_list(t),
            "_chips": ht.chip_list(t),
            "_bb": ht.big_blind(t),
            "_ante": ht.ante(t),
            **{f"_a_{s}": ht.street_actions(t, s) for s in ("preflop", "flop", "turn", "river")},
            **{f"_has_{s}": ht.reached(t, s) for s in ("flop", "turn", "river")},
            "_showdown": ht.showdown_seen(t),
        }
    )
    seated = F.array_contains(F.transform("_seats", lambda s: s["seat"]), F.col("_button"))
    empty = F.array().cast("array<struct<name:string,pos:string>>")
    df = df.withColumns(
        {
            "_positions": F.when(
                yes(seated), seats.named_positions(F.col("_seats"), F.col("_button"), seats.NAMED_SEATS)
            ).otherwise(empty),
            "_at_showdown": ht.hero_at_showdown(t, F.col("_hero")),
            "_won": ht.hero_won(t, F.col("_hero")),
        }
    )
    return mark_allins(df)


def is_hero(name: Column) -> Column:
    return yes(name == F.col("_hero")) | (name == "Hero")


def mark_allins(df: DataFrame) -> DataFrame:
    """Add all-ins that only arithmetic shows.

    What a player adds over a street telescopes to their last amount on it, so a bet
    is all-in when it plus the last amounts of earlier streets reaches the starting
    stack without the ante (pre-flop money is not tracked). No running state needed.
    """

    def last_on(street: str, player: Column) -> Column:
        mine = F.filter(f"_a_{street}", lambda b: (b["player"] == player) & b["verb"].isin("calls", "raises", "bets") & (b["amount"] > 0))
        return F.coalesce(F.get(mine, F.size(mine) - 1)["amount"], F.lit(0.0))

    def marked(street: str, earlier: list[str]) -> Column:
        def mark(a: Column) -> Column:
            stack = F.get(F.filter("_chips", lambda s: s["name"] == a["player"]), F.lit(0))["chips"]
            spent = a["amount"]
            for s in earlier:
                spent = spent + last_on(s, a["player"])
            paid = a["verb"].isin("calls", "raises", "bets") & (a["amount"] > 0)
            return a.withField("allin", a["allin"] | yes(paid & (spent >= stack - F.col("_ante") - 0.01)))

        return F.transform(f"_a_{street}", mark)

    return df.withColumns(
        {
            "_a_flop": marked("flop", []),
            "_a_turn": marked("turn", ["flop"]),
            "_a_river": marked("river", ["flop", "turn"]),
        }
    )


def with_words(df: DataFrame) -> DataFrame:
    def letter(name: Column) -> Column:
        return F.when(is_hero(name), "H").otherwise(
            F.coalesce(lookup(LETTER, seats.position_of(F.col("_positions"), name)), words.more_letter(F.array_position("_unseated", name)))
        )

    def verb(a: Column) -> Column:
        raised, called = a["verb"].isin("raises", "bets"), a["verb"] == "calls"
        return (
            F.when(raised, F.when(a["allin"], "x").otherwise("r"))
            .when(called, F.when(a["allin"], "y").otherwise("c"))
            .when(a["verb"] == "folds", "f")
            .when(a["verb"] == "checks", "k")
            .otherwise("z")
        )

    def word(street: str) -> Column:
        return F.array_join(F.transform(f"_a_{street}", lambda a: F.concat(letter(a["player"]), verb(a))), "")

    actors = lambda s: F.array_distinct(F.transform(f"_a_{s}", lambda a: F.when(is_hero(a["player"]), F.lit("Hero")).otherwise(a["player"])))
    folded = lambda s: F.transform(F.filter(f"_a_{s}", lambda a: a["verb"] == "folds"), lambda a: F.when(is_hero(a["player"]), F.lit("Hero")).otherwise(a["player"]))
    seated = F.transform("_positions", lambda p: F.when(is_hero(p["name"]), F.lit("Hero")).otherwise(p["name"]))
    hero_key = F.get(F.filter("_positions", lambda p: is_hero(p["name"])), F.lit(0))
    raisers = F.transform(F.filter("_a_preflop", lambda a: a["verb"].isin("raises", "bets")), lambda a: F.when(is_hero(a["player"]), F.lit("Hero")).otherwise(a["player"]))
    acted = F.flatten(F.array(*[F.transform(f"_a_{s}", lambda a: a["player"]) for s in ("preflop", "flop", "turn", "river")]))
    df = df.withColumn("_unseated", F.array_except(acted, F.transform("_positions", lambda p: p["name"])))
    df = df.withColumns(
        {
            **{f"_w_{s}": word(s) for s in ("preflop", "flop", "turn", "river")},
            "_hero_pos": hero_key["pos"],
            "_raisers": raisers,
            "_flop_players": F.when(
                F.col("_has_flop"),
                F.when(F.size("_a_flop") > 0, actors("flop")).otherwise(F.array_except(seated, folded("preflop"))),
            ).otherwise(F.array().cast("array<string>")),
            "_turn_players": F.when(F.size("_a_flop") > 0, F.array_except(actors("flop"), folded("flop"))).otherwise(seated),
        }
    )

    def last_to_act(players: str) -> Column:
        def order(name: Column) -> Column:
            pos = F.when(name == "Hero", F.col("_hero_pos")).otherwise(seats.position_of(F.col("_positions"), name))
            return lookup(POST_ORDER, pos)

        mine = lookup(POST_ORDER, F.col("_hero_pos"))
        later = F.exists(players, lambda p: yes((p != "Hero") & (order(p) > mine)))
        return F.when(F.array_contains(players, "Hero") & mine.isNotNull(), ~later)

    return df.withColumns({"_ip_flop": last_to_act("_flop_players"), "_ip_turn": last_to_act("_turn_players")})


# --- before the flop -----------------------------------------------------------------


def stack_bb(name: Column) -> Column:
    hit = F.filter("_stacks", lambda s: s["name"] == name)
    return F.when(F.col("_bb") > 0, F.round(F.get(hit, F.size(hit) - 1)["chips"] / F.col("_bb"), 2))


def with_stack_rules(df: DataFrame) -> DataFrame:
    """The stack and all-in rules an opportunity must pass, one column per kind.

    An all-in call before the hero does not block, an all-in raise does. Unknown
    opponent stacks pass for openings, defences and squeezes, and fail elsewhere.
    """
    hero_hit = F.filter("_stacks", lambda s: is_hero(s["name"]))
    hero_bb = F.when(F.col("_bb") > 0, F.round(F.get(hero_hit, F.size(hero_hit) - 1)["chips"] / F.col("_bb"), 2))
    w = F.col("_w_preflop")
    hero_at = F.instr(w, "H")
    before = F.when(hero_at > 0, F.slice("_a_preflop", F.lit(1), ((hero_at - 1) / 2).cast("int"))).otherwise(F.col("_a_preflop"))
    raised = lambda a: a["verb"].isin("raises", "bets")
    raiser = F.get(F.filter(before, raised), F.lit(0))["player"]
    # callers after the first raise, still before the hero
    first_raise = F.array_position(F.transform(before, raised), F.lit(True)).cast("int")
    callers = F.when(
        first_raise > 0,
        F.filter(F.slice(before, first_raise + 1, F.size(before)), lambda a: a["verb"] == "calls"),
    )
    open_rank = lookup(OPEN_ORDER, F.col("_hero_pos"))
    behind = F.filter(
        F.transform(
            F.filter("_positions", lambda p: ~is_hero(p["name"]) & yes(lookup(OPEN_ORDER, p["pos"]) > open_rank)),
            lambda p: F.coalesce(stack_bb(p["name"]), F.lit(0.0)),
        ),
        lambda v: v > 0,
    )
    squeezed = F.filter(
        F.array_append(F.transform(callers, lambda a: F.coalesce(stack_bb(a["player"]), F.lit(0.0))), F.coalesce(stack_bb(raiser), F.lit(0.0))),
        lambda v: v > 0,
    )
    blind = F.when(F.col("_hero_pos") == "SB", F.lit("BB")).when(F.col("_hero_pos") == "BB", F.lit("SB"))
    # the raise after the hero's own
    reraise_at = F.floor(F.length(F.regexp_extract(w, f"^(.*?H{RAISED}(?:{NH}[^rx])*){NH}{RAISED}", 1)) / 2).cast("int")
    threebettor = F.when(has(w, f"^(?:{NH}.)*H{RAISED}(?:{NH}[^rx])*{NH}{RAISED}"), F.get("_a_preflop", reraise_at))
    # a blocking all-in is one before the hero's first action
    sound = ~has(w, f"^(?:{NH}[a-z])*{NH}x") & (F.coalesce(hero_bb, F.lit(0.0)) >= MIN_BB)
    raiser_bb = F.coalesce(stack_bb(raiser), F.lit(0.0))
    return df.withColumns(
        {
            "_ok_open": sound
            & (open_rank.isNull() | (F.size(behind) == 0) | F.exists(behind, lambda v: v >= MIN_BB)),
            "_ok_defend": sound & ((raiser_bb == 0) | (raiser_bb >= MIN_BB)),
            "_ok_squeeze": sound & yes((F.size(squeezed) == 0) | F.exists(squeezed, lambda v: v >= MIN_BB)),
            "_ok_blinds": sound & yes(stack_bb(seats.player_at(F.col("_positions"), blind)) >= MIN_BB),
            "_ok_fold3": sound & yes(stack_bb(threebettor["player"]) >= MIN_BB) & ~yes(threebettor["allin"]),
            "_three_pos": seats.position_of(F.col("_positions"), threebettor["player"]),
        }
    )


def preflop_flags() -> dict[str, tuple[Column, Column]]:
    """Opportunity and attempt per pre-flop counter."""
    w, pos = F.col("_w_preflop"), F.col("_hero_pos")
    ready = (F.size("_positions") > 0) & (w != "")
    cls = lookup(seats.NAMED_CLASS, pos)
    out: dict[str, tuple[Column, Column]] = {}

    def add(name: str, where: Column, pattern: str, attempt: str) -> None:
        """The pattern ends where the hero acts; the attempt is what the hero then does."""
        opp = ready & yes(where) & has(w, f"{pattern}H")
        out[name] = (opp, opp & has(w, f"{pattern}H{attempt}"))

    no_raise = f"^{_FLAT}"
    for name, seat in (("Early RFI", "EP"), ("Middle RFI", "MP"), ("CO Steal", "CO"), ("BTN Steal", "BTN")):
        add(name, (cls == seat) & F.col("_ok_open"), no_raise, RAISED)
    one_raise = f"^{_FLAT}{NH}{RAISED}{_FLAT}"
    for seat in ("EP", "MP", "CO", "BTN"):
        add(f"{seat} 3bet", (cls == seat) & F.col("_ok_defend"), one_raise, RAISED)
        add(f"{seat} Cold Call", (cls == seat) & F.col("_ok_defend"), one_raise, CALLED)
    add(
        "BTN fold to CO steal", (pos == "BTN") & F.col("_ok_defend"),
        f"^(?:{words.but('CDHS')}f|[SD].)*C{RAISED}(?:{NH}.)*", "f",
    )

    blinds_only = has(w, f"^(?:{NB}f|[SDH].)*$") & F.exists("_positions", lambda p: p["pos"] == "SB") & F.exists(
        "_positions", lambda p: p["pos"] == "BB"
    ) & F.col("_ok_blinds")
    add("SB UO VPIP", (pos == "SB") & blinds_only, f"^(?:{NB}f)*", f"[rxcy]")
    add("SB Steal", (pos == "SB") & blinds_only, f"^(?:{NB}f)*", RAISED)
    for name, sb_does, answer in (("BB fold vs SB steal", RAISED, "f"), ("BB raise vs SB limp UOP", CALLED, RAISED)):
        opp = ready & yes((pos == "BB") & blinds_only) & has(w, f"^(?:{words.but('S')}.)*S{sb_does}")
        out[name] = (opp, opp & has(w, f"^(?:{NH}.)*H{answer}"))

    calm = f"(?:{NH}[fkzcy])*"
    add("Squeeze", F.col("_ok_squeeze"), f"^{calm}{NH}{RAISED}{calm}{NH}{CALLED}{calm}", RAISED)
    add("Squeeze vs BTN Raiser", (pos == "BB") & F.col("_ok_squeeze"), f"^{calm}B{RAISED}{calm}S{CALLED}{calm}", RAISED)

    # a clean steal: only folds in front of the raiser (blinds aside), no caller behind
    front = f"^(?:{NB}f|[SD][fkzcy])*"
    bb, sb = (pos == "BB") & F.col("_ok_defend"), (pos == "SB") & F.col("_ok_defend")
    sb_folds, btn_folds = has(w, f"^(?:{NH}.)*Sf(?:{NH}.)*H"), has(w, f"^(?:{NH}.)*Bf(?:{NH}.)*H")
    behind_bb, behind_sb = f"(?:{NH}{QUIET})*", _FLAT
    add("BB fold vs CO steal", bb, f"{front}C{RAISED}{behind_bb}", "f")
    add("BB fold vs BTN steal", bb & sb_folds, f"{front}B{RAISED}{behind_bb}", "f")
    add("BB resteal vs BTN steal", bb & sb_folds, f"{front}B{RAISED}{behind_bb}", RAISED)
    add("SB fold to CO Steal", sb & btn_folds, f"{front}C{RAISED}{behind_sb}", "f")
    add("SB fold to BTN Steal", sb, f"{front}B{RAISED}{behind_sb}", "f")
    add("SB resteal vs BTN", sb, f"{front}B{RAISED}{behind_sb}", RAISED)

    opened = f"^{_FOLDED}H{RAISED}{_FLAT}[A-GI-Y]{RAISED}{_FLAT}"
    mine, theirs = (F.coalesce(lookup(LAST_ORDER, c), F.lit(-1)) for c in (pos, F.col("_three_pos")))
    add("Fold to 3bet", pos.isNotNull() & F.col("_ok_fold3"), opened, "f")
    add("Fold to 3bet IP", pos.isNotNull() & F.col("_ok_fold3") & (mine > theirs), opened, "f")
    add("Fold to 3bet OOP", pos.isNotNull() & F.col("_ok_fold3") & (mine <= theirs), opened, "f")
    return out


# --- after the flop ---------------------------------------------------------------------


def postflop_flags() -> dict[str, tuple[Column, Column]]:
    """Opportunity and attempt per post-flop counter."""
    pre, flop, turn, river = (F.col(f"_w_{s}") for s in ("preflop", "flop", "turn", "river"))
    pos, raisers = F.col("_hero_pos"), F.col("_raisers")
    known = F.col("_hero").isNotNull()
    placed = known & F.col("_has_flop") & pos.isNotNull()
    pfr, three = F.get(raisers, F.lit(0)), F.get(raisers, F.lit(1))
    hero_pfr, hero_three, hero_four = yes(pfr == "Hero"), yes(three == "Hero"), yes(F.get(raisers, F.lit(2)) == "Hero")
    single = three.isNull()
    called_three = yes(three != "Hero") & has(
        pre, rf"^(?=(?:{ANY}[^rx])*{ANY}{RAISED}(?:{ANY}[^rx])*({NH}){RAISED}).*?\1{RAISED}.*H{CALLED}"
    )
    hero_in = has(pre, "H[xyz]")
    heads_up, turn_two = F.size("_flop_players") == 2, F.size("_turn_players") == 2
    ip, oop = yes(F.col("_ip_flop")), yes(~F.col("_ip_flop"))
    turn_ip, turn_oop = turn_two & yes(F.col("_ip_turn")), turn_two & yes(~F.col("_ip_turn"))
    opener = hero_pfr & ~hero_three & ~called_three & ~hero_four
    unopened = has(pre, f"^(?:{ANY}[^rxcy])*H{RAISED}")
    clean_open = placed & opener & unopened & ~hero_in & heads_up
    called_raise = ~hero_pfr & ~hero_three & has(pre, f"{NH}{RAISED}.*H{CALLED}")
    checked_to = has(flop, f"^(?:{NH}[^xyz])*{NH}kH")
    bets_flop = has(flop, f"H{RAISED}")
    out: dict[str, tuple[Column, Column]] = {}

    def add(name: str, opp: Column, att: Column) -> None:
        opp = yes(opp)
        out[name] = (opp, opp & yes(att))

    add("Flop CBet IP %", clean_open & ~pos.isin("SB", "BB") & ip & checked_to, bets_flop)
    pfr_saw_flop = yes(F.array_contains("_flop_players", pfr))
    add("Flop CBet 3BetPot IP", placed & hero_three & ~hero_pfr & ~hero_in & ip & heads_up & pfr_saw_flop & checked_to, bets_flop)
    add("Flop CBet OOP%", clean_open & ~pos.isin("SB", "BB", "BTN/SB") & oop & has(flop, "^H"), has(flop, f"^H{RAISED}"))

    facing = placed & called_raise & ~hero_in & heads_up & ip & has(flop, f"^(?:{NH}.)*{NH}rH")
    add("Flop fold vs Cbet IP", facing, has(flop, "Hf"))
    add("Flop raise Cbet IP", facing, bets_flop)
    add("Flop raise Cbet OOP", placed & ~hero_pfr & heads_up & oop & has(flop, f"^Hk{NH}r"), has(flop, f"^Hk{NH}r.*H{RAISED}"))
    trapped = rf"({NH})kH{RAISED}\1{RAISED}"
    add("Fold vs Check Raise", placed & heads_up & has(flop, trapped), has(flop, trapped + ".*Hf"))
    leads = yes(F.get("_a_flop", F.lit(0))["player"] == pfr)
    add(
        "Flop bet vs missed Cbet SRP",
        placed & single & called_raise & ~hero_in & heads_up & ip & leads & has(flop, f"^{NH}k") & has(flop, f"^(?:{NH}[^xyz])*H"),
        bets_flop,
    )

    on_turn = placed & F.col("_has_turn")
    got_called = has(flop, f"H{RAISED}.*{NH}{CALLED}")
    first, first_bet = has(turn, "^H"), has(turn, f"^H{RAISED}")
    add("Turn CBet IP%", on_turn & opener & ip & got_called & turn_ip & has(turn, f"^{ANY}k") & has(turn, "H"), has(turn, f"^(?:{NH}.)*H{RAISED}"))
    add("Turn Cbet OOP%", on_turn & opener & oop & got_called & turn_oop & first, first_bet)
    called_flop = has(flop, f"H{CALLED}")
    called_pfr = yes(pfr != "Hero") & has(pre, f"H{CALLED}")
    add("Turn donk bet", on_turn & called_flop & turn_oop & first, first_bet)
    add("Turn donk bet SRP vs PFR", on_turn & single & called_pfr & called_flop & turn_oop & first, first_bet)
    passive = on_turn & single & called_pfr & oop & has(flop, "^Hk")
    pfr_checks = F.exists(F.slice("_a_flop", 2, F.greatest(F.size("_a_flop"), F.lit(1))), lambda a: yes((a["player"] == pfr) & (a["verb"] == "checks")))
    add("Bet turn vs Missed Flop Cbet OOP SRP", passive & pfr_checks & turn_oop & first, first_bet)
    add(
        "Turn Fold vs CBet OOP",
        passive & has(flop, f"{NH}{RAISED}.*H{CALLED}") & turn_oop & has(turn, f"^Hk.*{NH}{RAISED}"),
        has(turn, "Hf"),
    )

    early_allin = hero_in | has(flop, "[xyz]") | has(turn, "[xyz]")
    saw_flop = known & F.col("_has_flop") & F.array_contains("_flop_players", "Hero")
    shown = F.col("_showdown") & F.col("_at_showdown")
    won = F.col("_won")
    add("WTSD%", saw_flop & ~early_allin, shown)
    add("W$SD%", saw_flop & shown & ~early_allin, won)
    add("W$WSF Rating", saw_flop, won)
    on_river = known & F.col("_has_river") & (river != "")
    # a ratio, so attempts do not need an opportunity here
    active = on_river & ~early_allin
    out["River Agg %"] = (yes(active & has(river, f"H{CALLED}")), yes(active & has(river, f"H{RAISED}")))
    add(
        "River bet - Single Rsd Pot",
        on_river & (flop != "") & single & ~early_allin & heads_up & has(river, f"^(?:{NH}[^rx])*H"),
        has(river, f"H{RAISED}"),
    )
    add("W$SD% B River", on_river & F.col("_showdown") & F.col("_has_flop") & (flop != "") & heads_up & has(river, f"H{RAISED}"), won)
    return out


def with_flags(parsed: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Flag columns ``o0, a0, ...`` and the counter names in that order; with ``names`` only of those counters."""
    df = with_stack_rules(with_words(parsed))
    every = {**preflop_flags(), **postflop_flags()}
    flags = {name: pair for name, pair in every.items() if names is None or name in names}
    cols = {}
    for i, (opp, att) in enumerate(flags.values()):
        cols[f"o{i}"], cols[f"a{i}"] = opp, att
    cols["player_sum"] = F.when(every["W$WSF Rating"][0], F.size("_flop_players")).otherwise(F.lit(0))
    return df.withColumns(cols), list(flags)


def count_text_hands(hands: DataFrame, keys: list[str], text: str = "text", only: list[str] | None = None) -> DataFrame:
    """(keys..., stat_id, opportunities, attempts) of all counters, or ``only`` some, VPIP rows included."""
    flagged, names = with_flags(read_hands(hands, text), only)
    cube = count_flags(flagged, [(n, None) for n in names], keys)
    return cube.unionByName(vpip_from_parts(cube, keys, ["EP", "MP", "CO", "BTN"]))


def flop_player_sums(hands: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Players at the flop, summed over the hands where the hero saw it (for the win rating)."""
    flagged, _ = with_flags(read_hands(hands, text))
    return flagged.groupBy(*keys).agg(F.sum("player_sum").cast("bigint").alias("player_sum"))
