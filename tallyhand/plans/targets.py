"""Score targets and weights: fixed values that decide a score.

Small tables, stated plainly and in full for each group; callers may pass their own.
"""

# Ideal percentage per pre-flop catalogue metric and group.
PREFLOP_IDEALS = {
    "nonko_9max_pref": {
        "RFI_EARLY": 19.0,
        "RFI_MIDDLE": 19.0,
        "RFI_CO_STEAL": 35.0,
        "RFI_BTN_STEAL": 45.0,
        "SB_UO_VPIP": 50.0,
        "BB_FOLD_TO_SB_STEAL": 40.0,
        "BB_RAISE_VS_SB_LIMP_UOP": 25.0,
        "SB_STEAL": 40.0,
        "EP_3BET": 8.0,
        "MP_3BET": 9.0,
        "CO_3BET": 10.0,
        "BTN_3BET": 12.0,
        "EP_COLD_CALL": 5.0,
        "MP_COLD_CALL": 6.0,
        "CO_COLD_CALL": 8.0,
        "BTN_COLD_CALL": 10.0,
        "EP_VPIP": 14.0,
        "MP_VPIP": 16.0,
        "CO_VPIP": 25.0,
        "BTN_VPIP": 35.0,
        "BTN_FOLD_TO_CO_STEAL": 60.0,
        "FOLD_TO_3BET_IP": 55.0,
        "FOLD_TO_3BET_OOP": 60.0,
        "FOLD_TO_3BET": 57.0,
        "SQUEEZE": 8.0,
        "SQUEEZE_VS_BTN_RAISER": 10.0,
        "BB_FOLD_VS_CO_STEAL": 50.0,
        "BB_FOLD_VS_BTN_STEAL": 40.0,
        "BB_FOLD_VS_SB_STEAL": 30.0,
        "BB_RESTEAL_VS_BTN_STEAL": 15.0,
        "SB_FOLD_TO_CO_STEAL": 75.0,
        "SB_FOLD_TO_BTN_STEAL": 65.0,
        "SB_RESTEAL_VS_BTN": 12.0,
    },
    "nonko_6max_pref": {
        "RFI_EARLY": 21.0,
        "RFI_MIDDLE": 21.0,
        "RFI_CO_STEAL": 37.0,
        "RFI_BTN_STEAL": 47.0,
        "SB_UO_VPIP": 52.0,
        "BB_FOLD_TO_SB_STEAL": 38.0,
        "BB_RAISE_VS_SB_LIMP_UOP": 27.0,
        "SB_STEAL": 42.0,
        "EP_3BET": 9.0,
        "MP_3BET": 10.0,
        "CO_3BET": 11.0,
        "BTN_3BET": 13.0,
        "EP_COLD_CALL": 6.0,
        "MP_COLD_CALL": 7.0,
        "CO_COLD_CALL": 9.0,
        "BTN_COLD_CALL": 11.0,
        "EP_VPIP": 16.0,
        "MP_VPIP": 18.0,
        "CO_VPIP": 27.0,
        "BTN_VPIP": 37.0,
        "BTN_FOLD_TO_CO_STEAL": 58.0,
        "FOLD_TO_3BET_IP": 53.0,
        "FOLD_TO_3BET_OOP": 58.0,
        "FOLD_TO_3BET": 55.0,
        "SQUEEZE": 10.0,
        "SQUEEZE_VS_BTN_RAISER": 12.0,
        "BB_FOLD_VS_CO_STEAL": 48.0,
        "BB_FOLD_VS_BTN_STEAL": 38.0,
        "BB_FOLD_VS_SB_STEAL": 28.0,
        "BB_RESTEAL_VS_BTN_STEAL": 17.0,
        "SB_FOLD_TO_CO_STEAL": 73.0,
        "SB_FOLD_TO_BTN_STEAL": 63.0,
        "SB_RESTEAL_VS_BTN": 14.0,
    },
    "pko_pref": {
        "RFI_EARLY": 20.0,
        "RFI_MIDDLE": 20.0,
        "RFI_CO_STEAL": 36.0,
        "RFI_BTN_STEAL": 46.0,
        "SB_UO_VPIP": 51.0,
        "BB_FOLD_TO_SB_STEAL": 39.0,
        "BB_RAISE_VS_SB_LIMP_UOP": 26.0,
        "SB_STEAL": 41.0,
        "EP_3BET": 8.5,
        "MP_3BET": 9.5,
        "CO_3BET": 10.5,
        "BTN_3BET": 12.5,
        "EP_COLD_CALL": 5.5,
        "MP_COLD_CALL": 6.5,
        "CO_COLD_CALL": 8.5,
        "BTN_COLD_CALL": 10.5,
        "EP_VPIP": 15.0,
        "MP_VPIP": 17.0,
        "CO_VPIP": 26.0,
        "BTN_VPIP": 36.0,
        "BTN_FOLD_TO_CO_STEAL": 59.0,
        "FOLD_TO_3BET_IP": 54.0,
        "FOLD_TO_3BET_OOP": 59.0,
        "FOLD_TO_3BET": 56.0,
        "SQUEEZE": 9.0,
        "SQUEEZE_VS_BTN_RAISER": 11.0,
        "BB_FOLD_VS_CO_STEAL": 49.0,
        "BB_FOLD_VS_BTN_STEAL": 39.0,
        "BB_FOLD_VS_SB_STEAL": 29.0,
        "BB_RESTEAL_VS_BTN_STEAL": 16.0,
        "SB_FOLD_TO_CO_STEAL": 74.0,
        "SB_FOLD_TO_BTN_STEAL": 64.0,
        "SB_RESTEAL_VS_BTN": 13.0,
    },
}

# Ideal percentage per post-flop catalogue metric (all hands).
POSTFLOP_IDEALS = {
    "POST_CBET_FLOP_IP": 60.0, "POST_CBET_FLOP_3BETPOT_IP": 55.0, "POST_CBET_FLOP_OOP": 50.0, "POST_CBET_TURN_IP": 55.0, "POST_CBET_TURN_OOP": 45.0,
    "POST_VS_CBET_FLOP_FOLD_IP": 40.0, "POST_VS_CBET_FLOP_FOLD_OOP": 45.0, "POST_VS_CBET_FLOP_CALL_IP": 45.0,
    "POST_VS_CBET_FLOP_CALL_OOP": 40.0, "POST_VS_CBET_FLOP_RAISE_IP": 12.0, "POST_VS_CBET_FLOP_RAISE_OOP": 15.0,
    "POST_PROBE_TURN_ATT_IP": 50.0, "POST_PROBE_TURN_ATT_OOP": 40.0, "POST_DELAYED_CBET_TURN_ATT_IP": 45.0, "POST_DELAYED_CBET_TURN_ATT_OOP": 40.0,
    "POST_DONK_FLOP": 5.0, "POST_DONK_TURN": 8.0, "POST_DONK_TURN_SRP_VS_PFR": 10.0, "POST_XR_FLOP": 12.0,
    "POST_BET_VS_MISSED_CBET_SRP_FLOP": 50.0, "POST_BET_VS_MISS_TURN": 50.0, "POST_BET_TURN_VS_MISSED_FLOP_CBET_OOP_SRP": 45.0, "POST_TURN_FOLD_VS_CBET_OOP": 35.0,
    "POST_WTSD": 28.5, "POST_W$SD": 52.5, "POST_WWSF": 46.0, "POST_W$SD_B_RIVER": 60.0,
    "POST_AGG_PCT_FLOP": 32.0, "POST_AGG_PCT_TURN": 28.0, "POST_AGG_PCT_RIVER": 22.0, "POST_RIVER_AGG_PCT": 22.0, "POST_RIVER_BET_SINGLE_RAISED_POT": 25.0,
}


def catalogue_ideals() -> list[tuple[str, str, float]]:
    """(stat_id, grp, ideal) rows."""
    preflop = [(stat, grp, ideal) for grp, ideals in PREFLOP_IDEALS.items() for stat, ideal in ideals.items()]
    return preflop + [(stat, "postflop_all", ideal) for stat, ideal in POSTFLOP_IDEALS.items()]


# Step scoring of the catalogue path.
STEP = {"step_down": 2.0, "step_up": 4.0, "points_down": 10.0, "points_up": 10.0}
MIN_OPPORTUNITIES_MONTH = 10
COMBINED = {"nonko_pref": ["nonko_9max_pref", "nonko_6max_pref"]}
GROUP_WEIGHTS = {"nonko_pref": 0.5, "pko_pref": 0.25, "postflop_all": 0.25}
SUBGROUP_WEIGHTS = {
    "RFI": 0.2, "BvB": 0.15, "3BET_RANGE": 0.1, "CC_RANGE": 0.05, "VPIP": 0.05, "FOLD_RANGE": 0.05,
    "VS_3BET": 0.1, "SQUEEZE": 0.05, "BB_DEFENSE": 0.1, "SB_DEFENSE": 0.05,
    "POSTFLOP_CBET": 0.20, "POSTFLOP_VS_CBET": 0.20, "POSTFLOP_PROBE_DELAYED": 0.10, "POSTFLOP_DONK": 0.05,
    "POSTFLOP_XR": 0.05, "POSTFLOP_MISSED_CBET": 0.05, "POSTFLOP_SHOWDOWN": 0.20, "POSTFLOP_AGGRESSION": 0.15,
}
# Metric weights inside their subgroup.
STAT_WEIGHTS = {
    "RFI": {"RFI_EARLY": 0.25, "RFI_MIDDLE": 0.25, "RFI_CO_STEAL": 0.25, "RFI_BTN_STEAL": 0.25},
    "BvB": {"SB_UO_VPIP": 0.25, "BB_FOLD_TO_SB_STEAL": 0.25, "BB_RAISE_VS_SB_LIMP_UOP": 0.25, "SB_STEAL": 0.25},
    "3BET_RANGE": {"EP_3BET": 0.25, "MP_3BET": 0.25, "CO_3BET": 0.25, "BTN_3BET": 0.25},
    "CC_RANGE": {"EP_COLD_CALL": 0.25, "MP_COLD_CALL": 0.25, "CO_COLD_CALL": 0.25, "BTN_COLD_CALL": 0.25},
    "VPIP": {"EP_VPIP": 0.25, "MP_VPIP": 0.25, "CO_VPIP": 0.25, "BTN_VPIP": 0.25},
    "FOLD_RANGE": {"BTN_FOLD_TO_CO_STEAL": 1.0},
    "VS_3BET": {"FOLD_TO_3BET_IP": 0.33, "FOLD_TO_3BET_OOP": 0.33, "FOLD_TO_3BET": 0.34},
    "SQUEEZE": {"SQUEEZE": 0.5, "SQUEEZE_VS_BTN_RAISER": 0.5},
    "BB_DEFENSE": {"BB_FOLD_VS_CO_STEAL": 0.25, "BB_FOLD_VS_BTN_STEAL": 0.25, "BB_FOLD_VS_SB_STEAL": 0.25, "BB_RESTEAL_VS_BTN_STEAL": 0.25},
    "SB_DEFENSE": {"SB_FOLD_TO_CO_STEAL": 0.33, "SB_FOLD_TO_BTN_STEAL": 0.33, "SB_RESTEAL_VS_BTN": 0.34},
    "POSTFLOP_CBET": {"POST_CBET_FLOP_IP": 0.30, "POST_CBET_FLOP_3BETPOT_IP": 0.20, "POST_CBET_FLOP_OOP": 0.25, "POST_CBET_TURN_IP": 0.15, "POST_CBET_TURN_OOP": 0.10},
    "POSTFLOP_VS_CBET": {"POST_VS_CBET_FLOP_FOLD_IP": 0.20, "POST_VS_CBET_FLOP_FOLD_OOP": 0.15, "POST_VS_CBET_FLOP_CALL_IP": 0.15, "POST_VS_CBET_FLOP_CALL_OOP": 0.15, "POST_VS_CBET_FLOP_RAISE_IP": 0.20, "POST_VS_CBET_FLOP_RAISE_OOP": 0.15},
    "POSTFLOP_PROBE_DELAYED": {"POST_PROBE_TURN_ATT_IP": 0.30, "POST_PROBE_TURN_ATT_OOP": 0.20, "POST_DELAYED_CBET_TURN_ATT_IP": 0.25, "POST_DELAYED_CBET_TURN_ATT_OOP": 0.25},
    "POSTFLOP_DONK": {"POST_DONK_FLOP": 0.50, "POST_DONK_TURN": 0.30, "POST_DONK_TURN_SRP_VS_PFR": 0.20},
    "POSTFLOP_XR": {"POST_XR_FLOP": 1.0},
    "POSTFLOP_MISSED_CBET": {"POST_BET_VS_MISSED_CBET_SRP_FLOP": 0.50, "POST_BET_VS_MISS_TURN": 0.50},
    "POSTFLOP_SHOWDOWN": {"POST_WTSD": 0.25, "POST_W$SD": 0.30, "POST_WWSF": 0.25, "POST_W$SD_B_RIVER": 0.20},
    "POSTFLOP_AGGRESSION": {"POST_AGG_PCT_FLOP": 0.30, "POST_AGG_PCT_TURN": 0.30, "POST_AGG_PCT_RIVER": 0.30, "POST_RIVER_AGG_PCT": 0.10},
}

# Targets of the text-counter path per group and metric: ideal, width of a tier
# below and above as a share of the ideal (999 = no upper limit), weight in the group.
COUNTER_GROUPS = ["nonko_9max", "nonko_6max", "pko"]
COUNTER_TARGETS = {
    "nonko_9max": {
        "Early RFI": (19.0, 2.0, 4.0, 0.1),
        "Middle RFI": (23.0, 2.0, 3.0, 0.2),
        "CO Steal": (36.0, 2.0, 6.0, 0.3),
        "BTN Steal": (48.0, 1.0, 8.0, 0.4),
        "SB UO VPIP": (83.0, 1.0, 999.0, 0.25),
        "BB fold vs SB steal": (30.0, 12.0, 3.0, 0.25),
        "BB raise vs SB limp UOP": (57.0, 3.0, 18.0, 0.25),
        "SB Steal": (28.0, 2.0, 100.0, 0.25),
        "EP VPIP": (8.0, 4.0, 4.0, 0.25),
        "MP VPIP": (11.0, 3.0, 3.0, 0.25),
        "CO VPIP": (15.0, 3.0, 3.0, 0.25),
        "BTN VPIP": (21.0, 3.0, 3.0, 0.2),
        "BTN fold to CO steal": (74.0, 6.0, 2.0, 0.05),
        "Fold to 3bet IP": (55.0, 7.0, 7.0, 0.5),
        "Fold to 3bet OOP": (50.0, 7.0, 7.0, 0.5),
        "Squeeze": (7.0, 4.0, 9.0, 0.7),
        "Squeeze vs BTN Raiser": (12.0, 4.0, 9.0, 0.3),
        "BB fold vs CO steal": (23.0, 8.0, 4.0, 0.3),
        "BB fold vs BTN steal": (19.0, 8.0, 4.0, 0.35),
        "BB resteal vs BTN steal": (16.0, 3.0, 12.0, 0.2),
        "SB fold to CO Steal": (80.0, 5.0, 10.0, 0.33),
        "SB fold to BTN Steal": (75.0, 5.0, 10.0, 0.33),
        "SB resteal vs BTN": (10.0, 2.0, 3.0, 0.34),
    },
    "nonko_6max": {
        "Early RFI": (23.0, 2.0, 4.0, 0.1),
        "Middle RFI": (28.0, 2.0, 3.0, 0.2),
        "CO Steal": (34.0, 2.0, 6.0, 0.3),
        "BTN Steal": (47.0, 1.0, 8.0, 0.4),
        "SB UO VPIP": (82.0, 1.0, 999.0, 0.25),
        "BB fold vs SB steal": (30.0, 12.0, 3.0, 0.25),
        "BB raise vs SB limp UOP": (55.0, 3.0, 18.0, 0.25),
        "SB Steal": (28.0, 2.0, 100.0, 0.25),
        "MP VPIP": (13.0, 4.0, 3.0, 0.25),
        "CO VPIP": (18.0, 3.5, 3.0, 0.25),
        "BTN VPIP": (23.0, 3.0, 3.0, 0.25),
        "BTN fold to CO steal": (73.0, 6.0, 2.0, 0.25),
        "Fold to 3bet IP": (55.0, 7.0, 7.0, 0.5),
        "Fold to 3bet OOP": (50.0, 7.0, 7.0, 0.5),
        "Squeeze": (7.0, 4.0, 9.0, 0.7),
        "Squeeze vs BTN Raiser": (12.0, 4.0, 9.0, 0.3),
        "BB fold vs CO steal": (24.0, 8.0, 4.0, 0.3),
        "BB fold vs BTN steal": (20.0, 8.0, 4.0, 0.35),
        "BB resteal vs BTN steal": (16.0, 3.0, 12.0, 0.2),
        "SB fold to CO Steal": (78.0, 5.0, 10.0, 0.33),
        "SB fold to BTN Steal": (73.0, 5.0, 10.0, 0.33),
        "SB resteal vs BTN": (11.0, 2.0, 3.0, 0.34),
    },
    "pko": {
        "Early RFI": (22.0, 2.0, 4.0, 0.1),
        "Middle RFI": (27.0, 2.0, 3.0, 0.2),
        "CO Steal": (38.0, 2.0, 6.0, 0.3),
        "BTN Steal": (53.0, 1.0, 8.0, 0.4),
        "SB UO VPIP": (83.0, 1.0, 999.0, 0.25),
        "BB fold vs SB steal": (24.0, 12.0, 3.0, 0.25),
        "BB raise vs SB limp UOP": (57.0, 3.0, 18.0, 0.25),
        "SB Steal": (28.0, 2.0, 100.0, 0.25),
        "EP VPIP": (13.0, 4.0, 4.0, 0.2),
        "MP VPIP": (15.5, 3.0, 3.0, 0.2),
        "CO VPIP": (22.0, 3.0, 3.0, 0.2),
        "BTN VPIP": (26.5, 3.0, 3.0, 0.2),
        "BTN fold to CO steal": (68.0, 6.0, 2.0, 0.2),
        "Fold to 3bet IP": (48.0, 7.0, 7.0, 0.5),
        "Fold to 3bet OOP": (44.0, 7.0, 7.0, 0.5),
        "Squeeze": (9.0, 4.0, 9.0, 0.7),
        "Squeeze vs BTN Raiser": (13.0, 4.0, 9.0, 0.3),
        "BB fold vs CO steal": (17.5, 8.0, 4.0, 0.3),
        "BB fold vs BTN steal": (15.0, 8.0, 4.0, 0.35),
        "BB resteal vs BTN steal": (18.0, 3.0, 12.0, 0.2),
    },
}


def counter_targets() -> list[tuple[str, str, float, float, float, float]]:
    """(grp, stat_id, ideal, down_pct, up_pct, weight) rows of the scored metrics."""
    return [(grp, stat, *row) for grp, table in COUNTER_TARGETS.items() for stat, row in table.items()]


# Post-flop targets (subgroup, ideal, step below, step above, weight);
# steps are absolute points here.
POSTFLOP_TARGETS = {
    "Flop CBet IP %": ("Flop Cbet", 90.0, 1.8, 5.4, 0.40),
    "Flop CBet 3BetPot IP": ("Flop Cbet", 90.0, 1.8, 5.4, 0.20),
    "Flop CBet OOP%": ("Flop Cbet", 37.0, 0.74, 1.48, 0.40),
    "Flop fold vs Cbet IP": ("Vs Cbet", 31.0, 1.86, 1.24, 0.30),
    "Flop raise Cbet IP": ("Vs Cbet", 12.5, 0.25, 6.25, 0.10),
    "Flop raise Cbet OOP": ("Vs Cbet", 20.0, 0.4, 4.0, 0.40),
    "Fold vs Check Raise": ("Vs Cbet", 32.0, 0.64, 12.8, 0.20),
    "Flop bet vs missed Cbet SRP": ("vs Skipped Cbet", 60.0, 1.8, 7.2, 1.0),
    "Turn CBet IP%": ("Turn Play", 60.0, 1.2, 12.0, 0.50),
    "Turn Cbet OOP%": ("Turn Play", 50.0, 1.0, 5.0, 0.10),
    "Turn donk bet": ("Turn Play", 8.0, 0.24, 2.0, 0.05),
    "Turn donk bet SRP vs PFR": ("Turn Play", 12.0, 0.36, 3.0, 0.05),
    "Bet turn vs Missed Flop Cbet OOP SRP": ("Turn Play", 45.0, 0.9, 4.5, 0.20),
    "Turn Fold vs CBet OOP": ("Turn Play", 43.0, 2.15, 2.15, 0.10),
    "WTSD%": ("River play", 30.0, 0.9, 0.9, 0.15),
    "W$SD%": ("River play", 50.0, 1.0, 1.0, 0.15),
    "W$WSF Rating": ("River play", None, 0.0, 0.0, 0.0),
    "River Agg %": ("River play", 2.5, 0.05, 0.15, 0.15),
    "River bet - Single Rsd Pot": ("River play", 45.0, 1.35, 1.8, 0.40),
    "W$SD% B River": ("River play", 57.0, 0.855, 0.855, 0.15),
}
POSTFLOP_SUBGROUP_WEIGHTS = {
    "Flop Cbet": 0.35, "Vs Cbet": 0.20, "vs Skipped Cbet": 0.10, "Turn Play": 0.20, "River play": 0.15,
}

# Category weights. Per category: weights, whether they are rescaled to
# the metrics that have a score, decimals kept of a percentage before it is scored
# (None = all), decimals of the category score.
CATEGORY_STATS = {
    "rfi": ({"Early RFI": 0.1, "Middle RFI": 0.2, "CO Steal": 0.3, "BTN Steal": 0.4}, True, None, 1),
    "bvb": ({"SB UO VPIP": 0.25, "BB fold vs SB steal": 0.25, "BB raise vs SB limp UOP": 0.25, "SB Steal": 0.25}, True, None, 1),
    "vs_3bet": ({"Fold to 3bet IP": 0.5, "Fold to 3bet OOP": 0.5}, False, None, 1),
    "squeeze": ({"Squeeze": 0.7, "Squeeze vs BTN Raiser": 0.3}, True, 1, 1),
    "bb_defense": ({"BB fold vs CO steal": 0.30, "BB fold vs BTN steal": 0.35, "BB fold vs SB steal": 0.15, "BB resteal vs BTN steal": 0.20}, True, 1, 1),
    "sb_defense": ({"SB fold to CO Steal": 0.4, "SB fold to BTN Steal": 0.4, "SB resteal vs BTN": 0.2}, True, None, 2),
}
THREEBET_CC = {
    "nonko_9max": {"EP VPIP": 0.10, "MP VPIP": 0.10, "CO VPIP": 0.30, "BTN VPIP": 0.30, "BTN fold to CO steal": 0.20},
    "nonko_6max": {"MP VPIP": 0.10, "CO VPIP": 0.35, "BTN VPIP": 0.35, "BTN fold to CO steal": 0.20},
    "pko": {"MP VPIP": 0.10, "CO VPIP": 0.35, "BTN VPIP": 0.35, "BTN fold to CO steal": 0.20},
}
# Small-blind defence has its own targets (ideal, down, up) per group.
SB_DEFENSE_TARGETS = {
    "nonko_9max": {"SB fold to CO Steal": (76.0, 3.0, 3.0), "SB fold to BTN Steal": (72.0, 3.0, 3.0), "SB resteal vs BTN": (14.0, 3.0, 18.0)},
    "nonko_6max": {"SB fold to CO Steal": (81.0, 3.0, 3.0), "SB fold to BTN Steal": (77.0, 3.0, 3.0), "SB resteal vs BTN": (14.0, 3.0, 18.0)},
    "pko": {"SB fold to CO Steal": (70.0, 3.0, 1.5), "SB fold to BTN Steal": (65.0, 3.0, 1.5), "SB resteal vs BTN": (15.0, 3.0, 18.0)},
}
CATEGORY_WEIGHTS = {
    "rfi": 0.25, "bvb": 0.15, "threbet_cc": 0.20, "vs_3bet": 0.10, "squeeze": 0.10, "bb_defense": 0.10, "sb_defense": 0.10,
}
CATEGORY_LABELS = {
    "rfi": "RFI", "bvb": "BvB", "threbet_cc": "3b & CC", "vs_3bet": "vs 3b IP/OOP", "squeeze": "Squeeze",
    "bb_defense": "Defesa da BB", "sb_defense": "Defesa da SB",
}


def category_table() -> list[tuple]:
    """(grp, category, stat_id, weight, rescale, pct_decimals, decimals, ideal, down_pct, up_pct) rows."""
    goal = {(g, s): (ideal, down, up) for g, s, ideal, down, up, _ in counter_targets()}
    rows = []
    for grp in COUNTER_GROUPS:
        categories = {**CATEGORY_STATS, "threbet_cc": (THREEBET_CC[grp], False, None, 1)}
        for category, (weights, *how) in categories.items():
            own = SB_DEFENSE_TARGETS[grp] if category == "sb_defense" else {}
            for stat, weight in weights.items():
                target = own.get(stat) or goal.get((grp, stat))
                if target:
                    rows.append((grp, category, stat, weight, *how, *target))
    return rows


def normalise_weights(weights: dict[str, float], mode: str = "auto") -> dict[str, float]:
    """Weights that add up to 1: ``auto`` rescales, ``strict`` raises, ``off`` keeps them."""
    total = sum(float(v) for v in weights.values())
    if not weights or total == 0 or abs(total - 1.0) < 1e-9 or mode == "off":
        return weights
    if mode == "strict":
        raise ValueError(f"weights add up to {total:.4f}, not 1")
    return {k: float(v) / total for k, v in weights.items()}
