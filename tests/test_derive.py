"""Facts of hand-made hands: short action lists with known answers."""

import pytest

from tallyhand.functions import seats
from tallyhand.operators import derive
from tallyhand.plans import catalogue, opportunities
from tallyhand.schemas import HAND

VERBS = {"f": "FOLD", "k": "CHECK", "c": "CALL", "b": "BET", "r": "RAISE", "e": "RERAISE", "a": "ALLIN", "s": "POST_SB", "p": "POST_BB"}


def street(text, amounts=None):
    """``"A:r B:c"`` -> actions; ``A:r=12`` sets to_amount."""
    acts = []
    for i, part in enumerate(text.split()):
        who, what = part.split(":")
        verb, _, to = what.partition("=")
        acts.append((who, VERBS[verb], (amounts or {}).get(i), float(to) if to else None, verb == "a", i))
    return (acts, None)


def hand(pre="", flop="", turn="", river="", players="ABCDEF", button=1, hero="A", winners=None, show=False, allin=False, file_id="f", stacks=200.0, table_max=None, stamp="2024-05-31T23:30:00Z"):
    names = list(players)
    shown = ([(hero, "SHOW", None, None, False, 99)], None) if show else None
    return (
        "gg", "T1", None, None, file_id, stamp, None, button, table_max, {"sb": 1.0, "bb": 2.0},
        [(i + 1, n, stacks, n == hero) for i, n in enumerate(names)], names, hero,
        (street(pre), street(flop), street(turn), street(river), shown), allin, winners or [], {"hand_start": 0},
    )


@pytest.fixture(scope="module")
def facts(spark):
    def run(*hands):
        rows = derive.derive_facts(spark.createDataFrame(list(hands), HAND)).collect()
        return rows if len(rows) > 1 else rows[0]

    return run


def test_seat_names():
    assert seats.seat_names(2) == ["BTN", "SB"]
    assert seats.seat_names(4) == ["BTN", "SB", "BB", "CO"]
    assert seats.seat_names(5) == ["BTN", "SB", "BB", "MP", "CO"]
    assert seats.seat_names(7) == ["BTN", "SB", "BB", "EP", "EP2", "MP1", "CO"]
    assert len(seats.seat_names(9)) == 9


def test_positions_from_button(facts):
    r = facts(hand("D:f", button=3))
    assert {p.name: p.pos for p in r.positions} == {"C": "BTN", "D": "SB", "E": "BB", "F": "EP", "A": "MP", "B": "CO"}
    assert (r.hero_position, r.hero_pos_group) == ("MP", "MP")


def test_button_on_empty_seat_falls_back(facts):
    r = facts(hand("A:f", players="ABC", button=8))
    assert {p.name: p.pos for p in r.positions}["A"] == "BTN"


def test_first_in_and_pot_types(facts):
    a, b, c, d = facts(
        hand("D:f E:f F:f A:r B:f C:c"),
        hand("D:c E:f F:f A:r B:f C:f D:c"),
        hand("D:r E:f F:f A:r B:f C:f D:c"),
        hand("D:r A:r D:r A:c"),
    )
    assert (a.hero_raised_first_in, a.unopened_pot, a.pot_type, a.is_isoraiser) == (True, True, "SRP", False)
    assert (b.hero_raised_first_in, b.is_isoraiser, b.has_limper_before_hero) == (False, True, True)
    assert (c.pot_type, c.three_bettor, c.hero_is_three_bettor) == ("3bet", "A", True)
    assert (d.pot_type, d.four_bettor) == ("4bet", "D")


def test_facing_a_three_bet(facts):
    r = facts(hand("A:r B:f C:r A:f"))
    assert r.faced_3bet and r.folded_to_3bet
    assert not facts(hand("A:r B:f C:r A:c")).folded_to_3bet


def test_squeeze_and_resteal(facts):
    assert facts(hand("D:r E:c A:r")).is_squeeze
    assert not facts(hand("D:r A:r")).is_squeeze
    r = facts(hand("B:r A:r", players="ABC", button=2, hero="A"))
    assert r.hero_position == "BB" and r.is_resteal_vs_btn


def test_vpip_ignores_posts_and_stops_at_fold(facts):
    assert facts(hand("A:s B:p A:c")).hero_vpip
    assert not facts(hand("A:f A:c")).hero_vpip


def test_pot_size(facts):
    # blinds 1+2, raise to 6, call 6, the big blind posts are not in the actions
    assert facts(hand("A:r=6 B:c")).pot_size_bb == pytest.approx((3 + 6 + 6) / 2)
    assert facts(hand("")).pot_size_bb == pytest.approx(1.5)


def test_position_and_players(facts):
    r = facts(hand("D:f E:f F:f A:r B:f C:c", flop="C:k A:b C:c", turn="C:k A:k"))
    assert (r.players_to_flop, r.heads_up_flop, r.hero_ip_flop) == (2, True, True)
    assert r.players_to_river == 2 and r.hero_ip_river is None


def test_cbet_in_position(facts):
    r = facts(hand("D:f E:f F:f A:r B:f C:c", flop="C:k A:b C:f"))
    assert r.cbet_flop_opp_ip and r.cbet_flop_att_ip and not r.cbet_flop_opp_oop
    quiet = facts(hand("D:f E:f F:f A:r B:f C:c", flop="C:k A:k", turn="C:k A:b"))
    assert quiet.cbet_flop_opp_ip and not quiet.cbet_flop_att_ip
    assert quiet.delayed_cbet_turn_opp_ip and quiet.delayed_cbet_turn_att_ip


def test_facing_a_cbet(facts):
    r = facts(hand("D:r E:f F:f A:c B:f C:f", flop="D:b A:r D:f"))
    assert r.vs_cbet_flop_raise_ip and not r.vs_cbet_flop_fold_ip


def test_probe_donk_missed(facts):
    r = facts(hand("A:f B:f C:c D:r E:f F:f C:c", flop="C:k D:k", turn="C:b D:f", hero="C"))
    assert r.hero_ip_turn is False and r.probe_turn_opp_oop and r.probe_turn_att_oop
    assert r.donk_turn_opp and r.donk_turn_att
    missed = facts(hand("A:f B:f C:c D:r E:f F:f C:c", flop="D:k C:b", hero="C"))
    assert missed.bet_vs_missed_flop_att_ip and missed.flop_bet_vs_missed_cbet_srp


def test_check_raise_and_answer(facts):
    r = facts(hand("A:c B:r A:c", flop="A:k B:b A:r B:f"))
    assert r.xr_flop_opp and r.xr_flop_att
    trapped = facts(hand("A:r B:c", flop="B:k A:b B:r A:f"))
    assert trapped.fold_vs_check_raise_opp and trapped.fold_vs_check_raise_att
    called = facts(hand("A:r B:c", flop="B:k A:b B:r A:c B:b A:f"))
    assert called.fold_vs_check_raise_opp and not called.fold_vs_check_raise_att


def test_check_raise_counts_only_the_first_raiser(facts):
    # C check-raises first and the hero calls; the later fold answers nobody
    r = facts(hand("A:r B:c C:c", flop="B:k C:k A:b C:r A:c B:r A:f"))
    assert r.fold_vs_check_raise_opp and not r.fold_vs_check_raise_att


def test_aggression_and_showdown(facts):
    r = facts(hand("A:r B:c", flop="B:k A:b B:c", turn="B:k A:k", river="B:b A:c", winners=["A"], show=True))
    assert (r.agg_pct_flop, r.agg_pct_turn, r.agg_pct_river) == (100.0, 0.0, 0.0)
    assert r.saw_showdown and r.won_showdown and r.won_when_saw_flop and r.wtsd


def test_no_flop_means_no_postflop_facts(facts):
    r = facts(hand("A:r B:f", turn="A:b"))
    assert not r.cbet_turn_opp_ip and not r.cbet_turn_opp_oop and not r.wtsd


def test_stacks(facts):
    r = facts(hand("D:f E:f F:f A:r B:f C:r A:f", stacks=100.0))
    assert (r.hero_stack_bb, r.raiser_stack_bb, r.three_bettor_stack_bb) == (50.0, 50.0, 50.0)
    assert r.eff_stack_srp is None  # the hero folded


def test_groups_month_and_counts(spark):
    rows = [
        hand("D:f E:f F:f A:r B:f C:c", flop="C:k A:b C:f", stamp="2024-05-31T23:30:00Z"),
        hand("D:f E:f F:f A:f B:f", file_id="/x/pko/f", stamp="2024-05-31T22:30:00Z"),
        hand("D:f E:f F:f A:r B:f C:c", flop="C:k A:k", file_id="/myst/f", stamp=""),
    ]
    facts = opportunities.with_month_and_groups(derive.derive_facts(spark.createDataFrame(rows, HAND)))
    got = {(r.month, tuple(r.groups)) for r in facts.collect()}
    assert got == {
        ("2024-06", ("nonko_6max_pref", "postflop_all")), ("2024-05", ("pko_pref",)), ("1970-01", ("mystery_pref", "postflop_all")),
    }
    cube = opportunities.with_percentage(opportunities.count_hands(facts, catalogue.catalogue()))
    by = {(r.grp, r.stat_id): (r.opportunities, r.attempts, r.percentage) for r in cube.collect()}
    assert by[("postflop_all", "POST_CBET_FLOP_IP")][:2] in {(1, 1), (1, 0)}
    assert by[("nonko_6max_pref", "RFI_BTN_STEAL")] == (1, 1, 100.0)
    assert all(att <= opp for opp, att, _ in by.values())


def test_enrich_and_flatten_round_trip(spark, tmp_path):
    hands = spark.createDataFrame([hand("D:f A:r B:c", flop="B:k A:b")], HAND)
    nested = derive.enrich_hands(hands)
    assert set(nested.schema["derived"].dataType.names) == {"positions", "preflop", "ip", "stacks", "flags", "postflop"}
    path = str(tmp_path / "enriched")
    nested.write.parquet(path)
    back = derive.hand_context(spark.read.parquet(path)).first()
    flat = derive.derive_facts(hands).first()
    for name in ("pot_type", "hero_ip_flop", "cbet_flop_att_ip", "hero_stack_bb", "donk_flop"):
        assert back[name] == flat[name]
