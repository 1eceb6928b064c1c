"""The metric catalogue as data, built by rule where metrics come in families.

A metric: id, label, family, scope, applies_to_groups, filters, opportunity,
attempt. Adding one is an edit here (or a YAML/dict from the caller), never new
counting code.
"""

PREFLOP_GROUPS = ["nonko_9max_pref", "nonko_6max_pref", "pko_pref"]
POSTFLOP_GROUPS = [*PREFLOP_GROUPS, "postflop", "postflop_all"]
MIN_BB = 16

_TRUE = lambda name: {"is_true": name}
_FALSE = lambda name: {"is_false": name}
_NOT = lambda clause: {"not": clause}
_DEEP = lambda name: {"gte": [name, MIN_BB]}


def _pre(id_, label, family, pots, opportunity, attempt):
    return {
        "id": id_,
        "label": label,
        "family": family,
        "scope": "preflop",
        "applies_to_groups": PREFLOP_GROUPS,
        "filters": {
            "heads_up_only": True,
            "pot_type": pots,
            "eff_stack_min_bb": MIN_BB,
            "exclude_allin_preflop": True,
        },
        "opportunity": {"all": [*opportunity, _DEEP("hero_stack_bb")]},
        "attempt": attempt,
    }


def _post(id_, label, family, opportunity, attempt=None, pots=("SRP", "3bet")):
    return {
        "id": id_,
        "label": label,
        "family": family,
        "scope": "postflop",
        "applies_to_groups": POSTFLOP_GROUPS,
        "filters": {"heads_up_only": True, "pot_type": list(pots), "exclude_allin_preflop": True},
        "opportunity": opportunity,
        "attempt": attempt if attempt is not None else opportunity,
    }


def _seat(pos: str) -> dict:
    """EP and MP are buckets, the rest are single seats."""
    return {"eq": ["hero_pos_group" if pos in ("EP", "MP") else "hero_position", pos]}


def preflop_metrics(by_seat: bool) -> list[dict]:
    """The 33 preflop metrics.

    ``by_seat=False`` keeps two comparisons literal, as stored catalogues have
    them: ``open_raiser`` (a player name) against a seat, ``three_bettor`` (a
    player name) against the word "hero". ``by_seat=True`` compares the opener's
    seat, and the 3-bettor with the hero's name.
    """
    opener = lambda pos: {"eq": ["open_raiser_position" if by_seat else "open_raiser", pos]}
    hero_3bets = {"eq_field": ["three_bettor", "hero"]} if by_seat else {"eq": ["three_bettor", "hero"]}
    unopened, vpip, first_in = _TRUE("unopened_pot"), _TRUE("hero_vpip"), _TRUE("hero_raised_first_in")
    behind, versus, blind = (
        _DEEP("avg_stacks_after_hero_bb"),
        _DEEP("raiser_stack_bb"),
        _DEEP("bvb_villain_stack_bb"),
    )
    # in corrected form a hand the small blind opened is not unopened for the big blind
    sb_opened = [opener("SB")] if by_seat else [opener("SB"), unopened]
    out = []
    for pos, id_, label in [
        ("EP", "RFI_EARLY", "Early RFI"),
        ("MP", "RFI_MIDDLE", "Middle RFI"),
        ("CO", "RFI_CO_STEAL", "CO Steal"),
        ("BTN", "RFI_BTN_STEAL", "BTN Steal"),
    ]:
        out.append(_pre(id_, label, "RFI", ["SRP"], [_seat(pos), unopened, behind], first_in))
    out += [
        _pre("SB_UO_VPIP", "SB UO VPIP", "BvB", ["SRP"], [_seat("SB"), unopened, blind], vpip),
        _pre("BB_FOLD_TO_SB_STEAL", "BB Fold vs SB Steal", "BvB", ["SRP"], [_seat("BB"), *sb_opened, blind], _NOT("hero_vpip")),
        _pre("BB_RAISE_VS_SB_LIMP_UOP", "BB Raise vs SB Limp", "BvB", ["SRP"], [_seat("BB"), _TRUE("has_limper_before_hero"), blind], first_in),
        _pre("SB_STEAL", "SB Steal", "BvB", ["SRP"], [_seat("SB"), unopened, blind], first_in),
    ]
    for pos in ("EP", "MP", "CO", "BTN"):
        facing = [_seat(pos), _NOT("unopened_pot"), _NOT("has_limper_before_hero"), versus]
        out += [
            _pre(f"{pos}_3BET", f"{pos} 3-Bet", "3BET_RANGE", ["3bet"], facing, hero_3bets),
            _pre(f"{pos}_COLD_CALL", f"{pos} Cold Call", "CC_RANGE", ["SRP"], facing, {"all": [vpip, _NOT("hero_raised_first_in")]}),
            _pre(f"{pos}_VPIP", f"{pos} VPIP", "VPIP", ["SRP"], [_seat(pos)], vpip),
        ]
    out.append(_pre("BTN_FOLD_TO_CO_STEAL", "BTN Fold vs CO Steal", "FOLD_RANGE", ["SRP"], [_seat("BTN"), opener("CO"), versus], _NOT("hero_vpip")))
    for suffix, label, where in (("_IP", " IP", [_TRUE("hero_ip_flop")]), ("_OOP", " OOP", [_FALSE("hero_ip_flop")]), ("", "", [])):
        out.append(
            _pre(f"FOLD_TO_3BET{suffix}", f"Fold to 3-Bet{label}", "VS_3BET", ["3bet"], [_TRUE("faced_3bet"), *where, _DEEP("three_bettor_stack_bb")], _TRUE("folded_to_3bet"))
        )
    squeeze = [_TRUE("is_squeeze"), _DEEP("squeeze_avg_stack_bb")]
    out += [
        _pre("SQUEEZE", "Squeeze", "SQUEEZE", ["3bet"], squeeze, hero_3bets),
        _pre("SQUEEZE_VS_BTN_RAISER", "Squeeze vs BTN Raiser", "SQUEEZE", ["3bet"], [*squeeze, opener("BTN")], hero_3bets),
    ]
    for pos, against in (("CO", versus), ("BTN", versus), ("SB", blind)):
        out.append(_pre(f"BB_FOLD_VS_{pos}_STEAL", f"BB Fold vs {pos} Steal", "BB_DEFENSE", ["SRP"], [_seat("BB"), opener(pos), against], _NOT("hero_vpip")))
    out.append(_pre("BB_RESTEAL_VS_BTN_STEAL", "BB Resteal vs BTN", "BB_DEFENSE", ["3bet"], [_seat("BB"), _TRUE("is_resteal_vs_btn"), versus], hero_3bets))
    for pos in ("CO", "BTN"):
        out.append(_pre(f"SB_FOLD_TO_{pos}_STEAL", f"SB Fold vs {pos} Steal", "SB_DEFENSE", ["SRP"], [_seat("SB"), opener(pos), versus], _NOT("hero_vpip")))
    out.append(_pre("SB_RESTEAL_VS_BTN", "SB Resteal vs BTN", "SB_DEFENSE", ["3bet"], [_seat("SB"), opener("BTN"), versus], hero_3bets))
    return out


def postflop_metrics() -> list[dict]:
    """The 33 postflop metrics."""
    srp = ("SRP",)
    out = []
    for street in ("FLOP", "TURN"):
        low = street.lower()
        for side in ("IP", "OOP"):
            out.append(
                _post(
                    f"POST_CBET_{street}_{side}", f"{street.title()} CBet {side}",
                    "POSTFLOP_CBET" if street == "FLOP" else "POSTFLOP_TURN",
                    _TRUE(f"cbet_{low}_opp_{side.lower()}"), _TRUE(f"cbet_{low}_att_{side.lower()}"),
                )
            )
    out.append(_post("POST_CBET_FLOP_3BETPOT_IP", "Flop CBet 3Bet Pot IP", "POSTFLOP_CBET", _TRUE("cbet_flop_opp_ip"), _TRUE("cbet_flop_att_ip"), ("3bet",)))

    def not_leading(street, side):
        where = _TRUE if side == "ip" else _FALSE
        return {"all": [where(f"hero_ip_{street}"), _NOT(f"cbet_{street}_opp_{side}")]}

    def any_answer(side):
        return {"any": [_TRUE(f"vs_cbet_flop_{verb}_{side}") for verb in ("fold", "call", "raise")]}

    vs = lambda verb, side: _TRUE(f"vs_cbet_flop_{verb}_{side}")
    out += [
        _post("POST_VS_CBET_FLOP_FOLD_IP", "Fold vs Flop CBet IP", "POSTFLOP_VS_CBET", not_leading("flop", "ip"), vs("fold", "ip")),
        _post("POST_VS_CBET_FLOP_RAISE_IP", "Raise vs Flop CBet IP", "POSTFLOP_VS_CBET", not_leading("flop", "ip"), vs("raise", "ip")),
        _post("POST_VS_CBET_FLOP_RAISE_OOP", "Raise vs Flop CBet OOP", "POSTFLOP_VS_CBET", not_leading("flop", "oop"), vs("raise", "oop")),
        _post("POST_VS_CBET_FLOP_FOLD_OOP", "Fold vs Flop CBet OOP", "POSTFLOP_VS_CBET", vs("fold", "oop")),
        _post("POST_VS_CBET_FLOP_CALL_IP", "Call vs Flop CBet IP", "POSTFLOP_VS_CBET", any_answer("ip"), vs("call", "ip")),
        _post("POST_VS_CBET_FLOP_CALL_OOP", "Call vs Flop CBet OOP", "POSTFLOP_VS_CBET", any_answer("oop"), vs("call", "oop")),
        _post("POST_BET_VS_MISSED_CBET_SRP_FLOP", "Bet vs Missed CBet Flop", "POSTFLOP_MISSED_CBET", _TRUE("flop_bet_vs_missed_cbet_srp"), pots=srp),
        _post("POST_DONK_FLOP", "Donk bet Flop", "POSTFLOP_DONK", _TRUE("donk_flop")),
        _post("POST_DONK_TURN", "Donk Turn", "POSTFLOP_TURN", _TRUE("donk_turn")),
        _post("POST_DONK_TURN_SRP_VS_PFR", "Donk Turn SRP vs PFR", "POSTFLOP_TURN", {"all": [_TRUE("donk_turn"), {"eq": ["pot_type", "SRP"]}]}, _TRUE("donk_turn"), srp),
        _post("POST_BET_TURN_VS_MISSED_FLOP_CBET_OOP_SRP", "Turn Bet vs Missed Flop CBet OOP", "POSTFLOP_TURN", _TRUE("turn_bet_vs_missed_cbet_srp_oop"), pots=srp),
        _post("POST_TURN_FOLD_VS_CBET_OOP", "Turn Fold vs CBet OOP", "POSTFLOP_TURN", not_leading("turn", "oop"), _TRUE("vs_cbet_turn_fold_oop")),
        _post(
            "POST_BET_VS_MISS_TURN", "Bet vs Missed CBet Turn", "POSTFLOP_TURN",
            {"any": [_TRUE(f"bet_vs_missed_turn_opp_{s}") for s in ("ip", "oop")]},
            {"any": [_TRUE(f"bet_vs_missed_turn_att_{s}") for s in ("ip", "oop")]}, srp,
        ),
        _post("POST_XR_FLOP", "Check-Raise Flop", "POSTFLOP_XR", _TRUE("xr_flop_opp"), _TRUE("xr_flop_att")),
    ]
    for move, label in (("PROBE", "Probe"), ("DELAYED_CBET", "Delayed CBet")):
        for side in ("IP", "OOP"):
            fact = f"{move.lower()}_turn_%s_{side.lower()}"
            out.append(_post(f"POST_{move}_TURN_ATT_{side}", f"{label} Turn {side}", "POSTFLOP_TURN", _TRUE(fact % "opp"), _TRUE(fact % "att")))
    saw, shown, won = _TRUE("saw_flop"), _TRUE("saw_showdown"), _TRUE("won_showdown")
    river_active = {"gt": ["river_agg_pct", 0]}
    out += [
        _post("POST_WTSD", "Went to Showdown", "POSTFLOP_RIVER", saw, shown),
        _post("POST_W$SD", "Won at Showdown", "POSTFLOP_RIVER", shown, won),
        _post("POST_W$WSF", "Won When Saw Flop", "POSTFLOP_RIVER", saw, _TRUE("won_when_saw_flop")),
        _post("POST_RIVER_AGG_PCT", "River Aggression %", "POSTFLOP_RIVER", river_active, {"gte": ["river_agg_pct", 0.5]}),
        _post("POST_RIVER_BET_SINGLE_RAISED_POT", "River Bet SRP", "POSTFLOP_RIVER", {"all": [{"eq": ["pot_type", "SRP"]}, _TRUE("hero_ip_river")]}, river_active, srp),
        _post("POST_W$SD_B_RIVER", "Won at SD After River Bet", "POSTFLOP_RIVER", {"all": [shown, river_active]}, won),
        _post("POST_WWSF", "Won When Saw Flop", "POSTFLOP_SHOWDOWN", saw, _TRUE("won_when_saw_flop")),
    ]
    for street in ("FLOP", "TURN", "RIVER"):
        low = street.lower()
        out.append(_post(f"POST_AGG_PCT_{street}", f"Aggression % {street.title()}", "POSTFLOP_AGGRESSION", _TRUE(f"saw_{low}"), {"gte": [f"agg_pct_{low}", 0]}))
    return out


def catalogue(by_seat: bool = False) -> list[dict]:
    return validate(preflop_metrics(by_seat) + postflop_metrics())


REQUIRED = ("id", "label", "family", "scope", "applies_to_groups", "opportunity", "attempt")


def validate(metrics: list[dict]) -> list[dict]:
    """Required fields present, ids unique; returns the list for chaining."""
    if not metrics:
        raise ValueError("the catalogue is empty")
    seen = set()
    for metric in metrics:
        missing = [k for k in REQUIRED if k not in metric]
        if missing:
            raise ValueError(f"metric {metric.get('id')!r} lacks {missing}")
        if metric["id"] in seen:
            raise ValueError(f"metric id used twice: {metric['id']!r}")
        seen.add(metric["id"])
    return metrics


def load_yaml(text: str) -> list[dict]:
    """A catalogue from YAML text with ``version`` and a ``stats`` list."""
    import yaml  # only callers with YAML catalogues need it

    doc = yaml.safe_load(text)
    if not isinstance(doc, dict) or doc.get("version") is None or not isinstance(doc.get("stats"), list):
        raise ValueError("a catalogue file needs 'version' and a list 'stats'")
    return validate(doc["stats"])


def for_group(metrics: list[dict], group: str) -> list[dict]:
    return [m for m in metrics if group in m["applies_to_groups"]]


def for_family(metrics: list[dict], family: str) -> list[dict]:
    return [m for m in metrics if m["family"] == family]
