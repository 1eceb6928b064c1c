import pytest
from pyspark.sql import functions as F

from tallyhand.functions import handtext as ht
from tallyhand.functions import numbers, timecols, tourney
from tallyhand.operators import classify, records, segments
from tallyhand.plans import counters


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "text, value",
    [("1,234.56", 1234.56), ("1.234,56", 1234.56), ("12,50", 12.5), ("1,000", 1000.0), ("1.000", 1000.0), ("R$ 12.34", 12.34), ("abc", 0.0), ("", 0.0), ("1,200,300", 1200300.0)],
)
def test_amount(spark, text, value):
    # a text with several separators of one kind keeps the rule of the last one
    if text == "1,200,300":
        value = 1200300.0
    assert one(spark, numbers.amount(F.lit(text))) == pytest.approx(value)


@pytest.mark.parametrize("text, value", [("(1,234.5)", 1234.5), ("$12,50", 12.5), ("1,234", 1234.0), ("x", None)])
def test_amount_simple(spark, text, value):
    assert one(spark, numbers.amount_simple(F.lit(text))) == value


@pytest.mark.parametrize(
    "text, month",
    [("2024-06-30T23:30:00Z", "2024-07"), ("2024/06/30 21:01:17", "2024-06"), ("2024-12-31 23:59:59", "2024-12"), ("nope", "1970-01"), (None, "1970-01")],
)
def test_month_bucket(spark, text, month):
    assert one(spark, timecols.month_bucket(F.lit(text).cast("string"))) == month


def test_month_fallback(spark):
    assert one(spark, timecols.month_bucket(F.lit("?"), F.lit(" 2023-04 "))) == "2023-04"


@pytest.mark.parametrize(
    "text, name, cls",
    [("Mystery Bounty", "a.txt", "mystery"), ("plain", "ko.txt", "PKO"), ("poker", "a.txt", "non-KO"), ("", "a.txt", "unknown"), ("��x", "a", "unknown")],
)
def test_class_with_reason(spark, text, name, cls):
    assert one(spark, tourney.class_with_reason(F.lit(text), F.lit(name))).class_name == cls


HAND = """PokerStars Hand #77: Tournament #5, $1+$1 USD Hold'em No Limit - Level I (1/2) - 2024/02/03 19:21:42 ET
Table '5 1' 6-max Seat #1 is the button
Seat 1: Al Bo (200 in chips)
Seat 2: Cy (200 in chips, $2 bounty)
Seat 3: Di (1,200 in chips) out of hand (moved from another table)
Seat 4: Ed (90 in chips)
Seat 5: Fay (300 in chips)
Cy: posts small blind 1
Ed: posts big blind 2
*** HOLE CARDS ***
Dealt to Al Bo [Ah Kd]
Fay: folds
Al Bo: raises 2 to 6
Cy: folds
Ed: calls 4
*** FLOP *** [2c 3d 4h]
Ed: checks
Al Bo: bets 8
Ed: calls 8
*** TURN *** [2c 3d 4h] [5s]
Ed: checks
Al Bo: bets 20
Ed: raises 62 to 82 and is all-in
Al Bo: folds
Ed collected 70 from pot
*** SUMMARY ***
Seat 1: Al Bo (button) folded on the Turn
Seat 4: Ed (big blind) collected (70)
"""


def test_reading_a_hand(spark):
    t = F.lit(HAND)
    assert one(spark, ht.hero_name(t)) == "Al Bo"
    assert [(s.seat, s.name) for s in one(spark, ht.seat_list(t))] == [(1, "Al Bo"), (2, "Cy"), (4, "Ed"), (5, "Fay")]
    assert {s.name: s.chips for s in one(spark, ht.stack_list(t))}["Di"] == 1200.0
    assert one(spark, ht.big_blind(t)) == 2.0
    pre = one(spark, ht.street_actions(t, "preflop"))
    assert [(a.player, a.verb) for a in pre] == [("Fay", "folds"), ("Al Bo", "raises"), ("Cy", "folds"), ("Ed", "calls")]
    turn = one(spark, ht.street_actions(t, "turn"))
    assert [(a.player, a.verb, a.amount, a.allin) for a in turn] == [
        ("Ed", "checks", 0.0, False), ("Al Bo", "bets", 20.0, False), ("Ed", "raises", 82.0, True), ("Al Bo", "folds", 0.0, False),
    ]
    assert one(spark, ht.active_players(t)) == 4
    assert one(spark, ht.hand_id(t)) == "77" and one(spark, ht.tournament_id(t)) == "5"
    assert not one(spark, ht.hero_won(t, F.lit("Al Bo"))) and one(spark, ht.hero_won(t, F.lit("Ed")))
    assert not one(spark, ht.showdown_seen(t))


def test_actions_of_all_streets(spark):
    rows = spark.createDataFrame([(1, HAND), (2, HAND.split("*** FLOP")[0]), (3, "no hand"), (4, None), (4, HAND)], "h int, text string")
    got = rows.select("h", F.inline(ht.hand_actions(F.col("text")))).collect()
    assert {h: sum(r.h == h for r in got) for h in (1, 2, 3, 4)} == {1: 11, 2: 4, 3: 0, 4: 11}
    flop = [(r.pos, r.player, r.verb, r.amount, r.allin) for r in got if r.h == 1 and r.street == "flop"]
    assert sorted(flop) == [(0, "Ed", "checks", 0.0, False), (1, "Al Bo", "bets", 8.0, False), (2, "Ed", "calls", 8.0, False)]
    for street in ht.STREET_OPEN:
        each = rows.where("h = 1").select(F.posexplode(ht.street_actions(F.col("text"), street)).alias("pos", "a")).select("pos", "a.*").collect()
        assert sorted(tuple(r) for r in each) == sorted((r.pos, r.player, r.verb, r.amount, r.allin) for r in got if r.h == 1 and r.street == street)


def test_top_section_is_cut_once(spark):
    # bound once, however many phrases and rules look at it
    cuts = lambda col: spark.createDataFrame([], "text string").select(col.alias("x"))._jdf.queryExecution().analyzed().toString().count("** Summary **")
    t = F.col("text")
    assert (cuts(ht.is_summary(t)), cuts(ht.is_cash_game(t)), cuts(tourney.class_from_text(t))) == (1, 1, 3)


def test_names_without_colon(spark):
    text = "** Dealing down cards **\nbob raises [1.400]\nal: folds\n** Dealing flop **\nbob bets [350]\nal b calls $[350]\n** Summary **"
    assert [(a.player, a.verb) for a in one(spark, ht.street_actions(F.lit(text), "preflop"))] == [("bob", "raises"), ("al", "folds")]
    flop = one(spark, ht.street_actions(F.lit(text), "flop"))
    assert [(a.player, a.verb, a.amount) for a in flop] == [("bob", "bets", 350.0), ("al b", "calls", 350.0)]


def test_counting_a_text(spark):
    rows = spark.createDataFrame([(HAND, "x")], "text string, k string")
    got = {r.stat_id: (r.opportunities, r.attempts) for r in counters.count_text_hands(rows, ["k"]).collect()}
    assert got["BTN Steal"] == (1, 1)
    assert got["Flop CBet IP %"] == (1, 1)
    assert got["Turn CBet IP%"] == (1, 1)
    assert got["W$WSF Rating"] == (1, 0)
    assert "WTSD%" not in got  # an all-in before the river


def test_arithmetic_allin(spark):
    # Ed has 90 chips: 8 on the flop and 82 on the turn reach the stack without the words
    rows = spark.createDataFrame([(HAND.replace(" and is all-in", ""),)], "text string")
    turn = counters.read_hands(rows).first()["_a_turn"]
    assert [a.allin for a in turn] == [False, False, True, False]


def test_classify_hand(spark):
    rows = spark.createDataFrame([(HAND, "a.txt"), (HAND, "Mystery.txt"), (HAND.replace("Tournament #5, ", ""), "b.txt")], "text string, file_id string")
    got = {r.file_id: (r.grp, r.discard_reason) for r in classify.classify_hands(rows).collect()}
    assert got == {"a.txt": ("pko", None), "Mystery.txt": (None, "mystery"), "b.txt": (None, "cash_game")}


def test_split_with_summary_and_continuation(spark):
    text = f"intro\n\n{HAND}\n\nmore\n\n\nTournament Results x\n\nSeat 1: z Dealt to z\n\ntail\n\n{HAND}"
    files = spark.createDataFrame([("f", text)], "file_id string, text string")
    hands = segments.split_hands(files).orderBy("hand_index").collect()
    assert [h.text.split("\n\n")[-1] for h in hands] == ["more", "tail", HAND.strip()]
    counts = segments.split_counts(files).first()
    assert (counts.total_segments, counts.tournament_summary, counts.hands) == (7, 1, 3)


def test_fingerprint_is_one_pass(spark):
    import hashlib

    text = "  A\r\nB\n\n\nC\n "
    want = hashlib.sha1("a\nb\n\nc".encode()).hexdigest()
    assert one(spark, records.fingerprint(F.lit(text))) == want


def test_first_record_wins_with_a_hot_key(spark):
    rows = spark.range(0, 3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS hand_id", "3000 - id AS pos", "id")
    got = records.first_records(rows, "hand_id", ["pos"])
    assert got.count() == 2001
    assert got.where("hand_id = 'hot'").first().id == 2997


def test_stacks_are_read_line_by_line(spark):
    text = "Seat 1: a (1,500 in chips)\nSeat 2: b (€12.5)\nSeat 3: c ( 35.459 )\nchat: I have 500 in chips\nSeat 4: d (100 in chips, $2 bounty)"
    got = one(spark, ht.stack_list(F.lit(text)))
    assert [s.name for s in got] == ["a", "b", "c", "d"] and got[0].chips == 1500.0 and got[3].chips == 100.0


def test_control_characters_are_only_text(spark):
    text = "*** HOLE CARDS ***\nodd\u0001name: calls 5\nb\u0002: folds\n*** FLOP ***\nx"
    got = one(spark, ht.street_actions(F.lit(text), "preflop"))
    assert [(a.player, a.verb) for a in got] == [("odd\u0001name", "calls"), ("b\u0002", "folds")]


def test_a_name_with_a_quote_end(spark):
    name = "we\\Eird"
    text = f"*** SUMMARY ***\nSeat 1: {name} (button) collected (5)"
    assert one(spark, ht.hero_won(F.lit(text), F.lit(name))) is True
    assert one(spark, ht.hero_won(F.lit(text), F.lit("zz"))) is False


def test_every_actor_has_a_letter(spark):
    from tallyhand.functions import words

    names = [f"p{i}" for i in range(60)]
    row = spark.createDataFrame([([(n, "CALL") for n in names], names)], "a array<struct<actor string, type string>>, r array<string>")
    word = row.select(words.street_word(F.col("a"), F.lit("p3"), F.lit("p4"), F.col("r")).alias("w")).first().w
    assert len(word) == 120 and len(set(word[::2])) == 60
    assert row.select(F.lit(word).rlike(f"^(?:{words.ANY}c)*$")).first()[0]


def test_positions_of_a_crowd(spark):
    from tallyhand.functions import seats

    players = spark.createDataFrame([([(i, f"p{i}") for i in range(1, 15)],)], "p array<struct<seat int, name string>>")
    got = players.select(seats.named_positions(F.col("p"), F.lit(1))).first()[0]
    assert [x.pos for x in got] == seats.FULL_TABLE
