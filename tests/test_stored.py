"""What is stored and read again: ids by day, bucketed tables, run states, room jobs, months without a window."""

import itertools

import pytest
from pyspark.sql import functions as F

from checks import facts, files, tables
from tallyhand.functions import timecols
from tallyhand.operators import cube as cubes
from tallyhand.operators import months, quality, reports, runstate
from tallyhand.plans import rooms
from tallyhand.sources import readers, sinks
from tallyhand.streaming import incremental


def count_all(df):
    return df.groupBy("month").agg(F.count("*").alias("opportunities")).selectExpr("month", "'g' grp", "'s' stat_id", "opportunities", "0L attempts")


def test_a_batch_reads_the_ids_of_its_days_only(spark, tmp_path):
    cube, ids = str(tmp_path / "cube"), tmp_path / "ids"
    batch = lambda *rows: spark.createDataFrame(rows, "hand_id string, month string, at string").withColumn("event_time", F.to_timestamp("at"))
    add = incremental.merge_counts(count_all, cube, str(ids), "one")
    add(batch(("a", "2024-05", "2024-05-01 10:00:00"), ("b", "2024-05", "2024-05-02 10:00:00"), ("n", "2024-05", None)), 0)
    add(batch(("c", "2019-01", "2019-01-07 10:00:00")), 1)
    # ids of days that no later batch has are made unreadable; a batch that read them would fail
    for folder in [*ids.glob("run=*/batch=*/day=2019-01-07"), *ids.glob("run=*/batch=*/day=2024-05-02")]:
        for part in folder.glob("*.parquet"):
            part.write_bytes(b"not a table")
            (folder / f".{part.name}.crc").unlink(missing_ok=True)
    add(batch(("a", "2024-05", "2024-05-01 10:00:00"), ("d", "2024-05", "2024-05-01 23:59:59"), ("n", "2024-05", None)), 2)
    assert {r.month: r.opportunities for r in incremental.read_counts(spark, cube).collect()} == {"2024-05": 4, "2019-01": 1}
    with pytest.raises(Exception):  # noqa: B017, PT011
        add(batch(("c", "2019-01", "2019-01-07 10:00:00")), 3)


def test_stored_drill_down_has_no_exchange_on_either_side(spark, sf_dir, tmp_path):
    hits = facts.stat_hits(spark, sf_dir)
    month = timecols.month_bucket(F.col("timestamp_utc"))
    hands = tables.hands(spark, sf_dir).select(F.col("h").cast("string").alias("hand_id"), "site", "file_id", month.alias("month"))
    sinks.write_bucketed(hits, "test_hits", str(tmp_path / "hits"), buckets=8)
    sinks.write_bucketed(hands, "test_hands", str(tmp_path / "hands"), buckets=8)
    asked = ("POST_CBET_FLOP_OOP", "postflop_all", "attempts")
    chosen = sorted(r.month for r in hits.where("grp = 'postflop_all'").select("month").distinct().collect())[:2]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        some = reports.drill_down_stored(spark, "test_hits", "test_hands", *asked, months=chosen)
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("PartitionFilters: [month") + plan.count("PartitionFilters: [isnotnull(month") >= 1
        want = reports.drill_down(hits.where(F.col("month").isin(chosen)), hands.where(F.col("month").isin(chosen)), *asked)
        assert sorted(some.collect()) == sorted(want.select(*some.columns).collect())
        for name in ("test_hits", "test_hands"):
            read = spark.table(name).where(F.col("month").isin(chosen))._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [" in read and chosen[0] in read
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("test_hits", "test_hands"):
            spark.sql(f"DROP TABLE {name}")


def state(spark, run, version, cells):
    """cells: (month, valid ids, discarded)."""
    cube = spark.createDataFrame([(m, "g", "s", len(v), len(v) // 2) for m, v, _ in cells], "month string, grp string, stat_id string, opportunities long, attempts long")
    lost = spark.createDataFrame([(m, "other", d) for m, _, d in cells if d], "month string, reason string, hands long")
    ids = spark.createDataFrame([(m, "g", i) for m, v, _ in cells for i in v], "month string, grp string, hand_id string")
    return runstate.run_state(run, version, cube, lost, ids)


def test_run_states_merge_in_any_order(spark):
    states = [
        state(spark, "a", 1, [("2024-01", "xyz", 2), ("2024-02", "uv", 0), (None, "w", 1)]),
        state(spark, "b", 1, [("2024-01", "zq", 1)]),
        state(spark, "a", 2, [("2024-01", "x", 5)]),
    ]
    merge, rows = runstate.merge_states, lambda s: [sorted(map(repr, t.collect())) for t in s]
    want = rows(merge(*states))
    for a, b, c in itertools.permutations(states):
        assert rows(merge(merge(a, b), c)) == want and rows(merge(a, merge(b, c, b))) == want
    done = merge(*states)
    assert {r["name"]: r["hands"] for r in runstate.hands(done).collect()} == {"group:g": 6, "valid": 6, "discard:other": 7, "discarded": 7, "total": 13}
    assert {r["name"]: r["hands"] for r in runstate.hands(done, ["2024-01"]).collect()} == {"group:g": 3, "valid": 3, "discard:other": 6, "discarded": 6, "total": 9}
    assert {(r["month"], r["opportunities"], r["attempts"]) for r in runstate.counters(done).collect()} == {("2024-01", 3, 1), ("2024-02", 2, 1), (None, 1, 0)}
    left = runstate.without_months(done, "a", ["2024-01", "2024-02"])
    assert {r["name"]: r["hands"] for r in runstate.hands(left).collect()} == {"group:g": 3, "valid": 3, "discard:other": 2, "discarded": 2, "total": 5}


def test_room_job_accounts_for_every_segment(spark, sf_dir, tmp_path):
    hand = "Seat 1: a (5 in chips)\nSeat 2: b (5 in chips)\n*** HOLE CARDS ***\nDealt to a [Ah Kd]\na: folds"
    text = "\n\n".join(["lost preamble", f"PokerStars Hand #1: Tournament #7\n{hand}", "Poker Hand #2: no seats at all", "Tournament Results\n1st: a", f"PokerStars Hand #3: cash\n{hand}"])
    done = rooms.run_rooms(spark.createDataFrame([("f", text, "s"), ("empty", "", "s"), ("null", None, "s")], "file_id string, text string, source string"), str(tmp_path))
    total = done.totals.first().asDict()
    assert done.parsed == 4 and total["total_hands"] == 4 and total["residual"] == 0 and total["valid_hands"] == 0
    assert (total["less_than_4_players"], total["tournament_summary"], total["cash_game"], total["other"]) == (1, 1, 1, 1)
    assert done.records.where("discard_reason IS NULL").count() == 0 and done.counters.count() == 0
    names = {r["name"]: r["hands"] for r in done.samples.collect()}
    ids = {r["name"]: r["count"] for r in done.sample_ids.groupBy("name").count().collect()}
    assert names["total"] == ids["total"] == 4


def test_months_of_a_frame_and_of_users(spark):
    rows = spark.createDataFrame([("u", "2024-01", 1), ("u", "2024-03", 2), ("u", "unknown", 3), (None, "2024-02", 4), (None, "2024-05", 5), ("v", None, 6)], "user string, month string, n int")
    whole = {r.n: (r["rank"], r["of"]) for r in months.with_month_rank(rows).collect()}
    assert whole == {5: (1, 5), 2: (2, 5), 4: (3, 5), 1: (4, 5), 3: (5, 5)}
    of_users = {r.n: (r["rank"], r["of"]) for r in months.with_month_rank(rows, ["user"], unknown_is_newest=True).collect()}
    assert of_users == {3: (1, 3), 2: (2, 3), 1: (3, 3), 5: (1, 2), 4: (2, 2)}
    for by in (None, ["user"]):
        assert "Window" not in months.with_month_rank(rows, by)._jdf.queryExecution().optimizedPlan().toString()


def test_checks_read_their_rows_once(spark, sf_dir):
    records = files.runs.hand_records(spark, sf_dir)
    plan = quality.sums_within_total(records)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") == 1 or plan.count("FileScan") == records._jdf.queryExecution().executedPlan().toString().count("FileScan")
    ids = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1"), ("c", None)], "hand_id string, month string")
    known = spark.createDataFrame([("a",), ("z",), ("z",)], "hand_id string")
    assert {r["check"]: r["ids"] for r in quality.month_id_report(ids, known).collect()} == {"duplicate_ids": 1, "extra_ids": 2, "monthly_ids": 3, "global_ids": 2}
    assert {r["check"]: r["ids"] for r in quality.month_id_report(ids.limit(0), known.limit(0)).collect()} == {"duplicate_ids": 0, "extra_ids": 0, "monthly_ids": 0, "global_ids": 0}


@pytest.mark.parametrize(("text", "month"), [
    ("86400", "1970-01"), ("-86400", "1969-12"), ("1700000000", "2023-11"), ("1700000000.5", "2023-11"), ("0", "1970-01"), ("4102444800", "2100-01"), ("99999999999999999999", None),
    ("20240607", "2024-06"), ("2024", "2024-01"), ("20241399", "1970-08"), ("12", "1970-01"), ("1e5", None), ("", None),
])
def test_bare_numbers_are_seconds(spark, text, month):
    row = spark.createDataFrame([(text,)], "t string").select(timecols.month_of(timecols.parse_stamp(F.col("t"))).alias("m")).first()
    assert row.m == month


def test_the_first_row_is_the_files_first(spark, tmp_path):
    rows = [{"a": str(i), "b": "x" * 50} for i in range(2000)]
    (tmp_path / "b.csv").write_text("a,b\n" + "\n".join(f"{r['a']},{r['b']}" for r in rows))
    (tmp_path / "c.csv").write_text("a,b\nlater,y")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert readers.room_sheet(spark, str(tmp_path)).first().a == "0"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert readers.first_row(spark.createDataFrame([], "a string, o long"), "o").count() == 0


def test_hands_per_month_takes_the_stamp_first(spark):
    rows = spark.createDataFrame([("2024-01-31T23:30:00Z", "2023-01"), (None, "2023-01"), ("junk", None), (None, "not a month")], "timestamp_utc string, month string")
    assert {r.month: r.hands for r in cubes.hands_per_month(rows, "timestamp_utc").collect()} == {"2024-01": 1, "2023-01": 1}
    assert {r.month: r.hands for r in cubes.hands_per_month(rows, "timestamp_utc", missing="unknown").collect()} == {"2024-01": 1, "2023-01": 1, "unknown": 2}
