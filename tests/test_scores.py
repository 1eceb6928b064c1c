import pytest
from pyspark.sql import functions as F

from tallyhand.functions import scoring
from tallyhand.operators import months
from tallyhand.plans import scorecard, targets


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "pct, score", [(90.0, 100.0), (95.4, 100.0), (95.5, 90.0), (100.8, 90.0), (88.2, 100.0), (86.3, 80.0), (0.0, 0.0)]
)
def test_step_edges_are_inclusive(spark, pct, score):
    assert one(spark, scoring.score_step(F.lit(pct), F.lit(90.0), 1.8, 5.4)) == score


@pytest.mark.parametrize("pct, score", [(19.0, 100.0), (18.7, 100.0), (18.5, 90.0), (18.1, 80.0), (19.7, 100.0), (0.0, 0.0)])
def test_tier(spark, pct, score):
    assert one(spark, scoring.score_tier(F.lit(pct), F.lit(19.0), 2.0, 4.0)) == score


def test_tier_without_ideal(spark):
    assert one(spark, scoring.score_tier(F.lit(5.0), F.lit(None).cast("double"), 2.0, 4.0)) == 0.0


def test_linear(spark):
    assert one(spark, scoring.score_linear(F.lit(42.0), F.lit(40.0), 2.0, 4.0)) == 95.0


def test_ratios(spark):
    assert one(spark, scoring.action_ratio(F.lit(3), F.lit(0))) == 10.0
    assert one(spark, scoring.action_ratio(F.lit(0), F.lit(0))) == 0.0
    # 5 wins of 10 with 2.5 players on average: twice 0.5 / 0.4
    assert one(spark, scoring.performance_ratio(F.lit(5), F.lit(10), F.lit(25))) == 1.25


def cube(spark, rows):
    return spark.createDataFrame(rows, "month string, grp string, stat_id string, opportunities bigint, attempts bigint")


def test_month_blend(spark):
    scores = spark.createDataFrame([("2024-03", "g", 90.0), ("2024-02", "g", 80.0), ("2024-01", "g", 60.0)], "month string, grp string, score double")
    assert months.blend_months(months.weigh_months(scores, "2024-03"), ["grp"]).first().score == pytest.approx(81.0)


def test_every_user_has_own_months(spark):
    rows = [("a", "2024-03", 90.0), ("a", "2024-01", 60.0), ("b", "2019-05", 40.0), ("b", None, 1.0), (None, "2018-01", 7.0)]
    scores = spark.createDataFrame(rows, "user string, month string, score double")
    got = months.blend_months(months.weigh_months(scores, by=["user"]), ["user"]).collect()
    assert {r.user: r.score for r in got} == {"a": pytest.approx(75.0), "b": 40.0, None: 7.0}
    four = {1: [1.0], 2: [0.5, 0.5], 3: [0.4, 0.3, 0.3], 4: [0.4, 0.3, 0.2, 0.1]}
    rows = [("a", f"2024-0{m}", float(m)) for m in range(1, 6)]
    frame = spark.createDataFrame(rows, "user string, month string, score double")
    assert months.blend_months(months.weigh_months(frame, table=four), ["user"]).first().score == pytest.approx(0.4 * 5 + 0.3 * 4 + 0.2 * 3 + 0.1 * 2)


def test_blend_rescales_missing_months(spark):
    scores = spark.createDataFrame([("2024-03", "g", 90.0), ("2024-02", "g", None), ("2024-01", "g", 60.0)], "month string, grp string, score double")
    got = months.blend_months(months.weigh_months(scores), ["grp"]).first()
    assert got.score == pytest.approx((90 * 0.5 + 60 * 0.2) / 0.7) and got.months_used == 2


def test_usable_months_skip_small_samples(spark):
    rows = [("2024-04", "g", "s", 5, 1), ("2024-03", "g", "s", 20, 10), ("2024-02", "g", "s", 20, 5), ("unknown", "g", "s", 30, 30)]
    got = {r.month: (r["rank"], r.weight) for r in months.usable_months(cube(spark, rows), ["grp", "stat_id"]).collect()}
    assert got == {"2024-03": (1, 0.5), "2024-02": (2, 0.3), "unknown": (3, 0.2)}


def test_weight_tables(spark):
    weights = [r.w for r in spark.createDataFrame([(1,), (2,)], "r int").select(months.decay_weight(F.col("r"), F.lit(2), months.MAIN_DECAY).alias("w")).collect()]
    assert sorted(weights) == [0.3, 0.7]


def test_normalise_weights():
    assert targets.normalise_weights({"a": 1.0, "b": 3.0}) == {"a": 0.25, "b": 0.75}
    assert targets.normalise_weights({"a": 1.0, "b": 3.0}, "off") == {"a": 1.0, "b": 3.0}
    with pytest.raises(ValueError):
        targets.normalise_weights({"a": 2.0}, "strict")


def test_target_tables_are_complete():
    assert {g for g, *_ in targets.counter_targets()} == set(targets.COUNTER_GROUPS)
    for stats in targets.STAT_WEIGHTS.values():
        assert sum(stats.values()) == pytest.approx(1.0)
    ideals = {(s, g): i for s, g, i in targets.catalogue_ideals()}
    assert ideals[("EP_3BET", "pko_pref")] == 8.5


def test_scorecard_of_one_metric(spark):
    rows = [("2024-01", "nonko_9max_pref", "RFI_EARLY", 100, 19), ("2024-01", "nonko_6max_pref", "RFI_EARLY", 100, 21), ("2024-01", "pko_pref", "RFI_EARLY", 100, 29)]
    card = scorecard.stat_level(cube(spark, rows), scorecard.ideals_frame(spark))
    by = {r.grp: (r.pct_time_decay, r.score_time_decay) for r in card.collect()}
    assert by == {"nonko_9max_pref": (19.0, 100.0), "nonko_6max_pref": (21.0, 100.0), "nonko_pref": (20.0, 100.0), "pko_pref": (29.0, 80.0)}
    subs = scorecard.subgroup_level(card, scorecard.stat_weights_frame(spark))
    groups = scorecard.group_level(subs, scorecard.weights_frame(spark, "subgroup", targets.SUBGROUP_WEIGHTS))
    by = {r.grp: r.score for r in groups.collect()}
    assert by["nonko_pref"] == 20.0 and by["pko_pref"] == 16.0
    weights = scorecard.weights_frame(spark, "grp", targets.GROUP_WEIGHTS)
    assert scorecard.overall(groups, weights).first()[0] == pytest.approx(14.0)
    assert scorecard.overall(groups, weights, "skip").first()[0] == pytest.approx(18.67)


def test_carry_forward_in_chunks_equals_one_window(spark):
    rows = spark.range(0, 400).selectExpr("id % 2 AS f", "id AS pos", "CASE WHEN id % 37 = 5 THEN concat('2024-', lpad(id % 12 + 1, 2, '0')) END AS month")
    plain = {(r.f, r.pos): r.month for r in months.carry_month_forward(rows, "f", "pos").collect()}
    chunked = {(r.f, r.pos): r.month for r in months.carry_month_forward(rows, "f", "pos", chunk=16).collect()}
    assert plain == chunked


def test_rows_without_a_place_keep_their_month(spark):
    rows = [("f", 1, "2024-01"), ("f", 2, None), ("f", None, None), ("f", None, "2024-09"), (None, 3, "2024-05"), (None, 4, None), (None, None, None)]
    frame = spark.createDataFrame(rows, "f string, pos long, month string")
    got = sorted(months.carry_month_forward(frame, "f", "pos", chunk=1).collect(), key=repr)
    want = [("f", 1, "2024-01"), ("f", 2, "2024-01"), ("f", None, None), ("f", None, "2024-09"), (None, 3, "2024-05"), (None, 4, None), (None, None, None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
