import json

from pyspark.sql import functions as F

from checks import tables
from tallyhand.operators import derive, reports
from tallyhand.plans import catalogue, opportunities
from tallyhand.sources import readers, sinks
from tallyhand.streaming import incremental


def test_text_files_and_decode(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_bytes("olá".encode())
    (tmp_path / "two.XML").write_bytes("olá".encode("latin-1"))
    (tmp_path / "three.csv").write_text("x")
    rows = readers.text_files(spark, str(tmp_path)).withColumn("d", readers.decode(F.col("content"))).collect()
    got = {r.name: (r.d.text, r.d.encoding, r.d.status) for r in rows}
    assert got == {"one.txt": ("olá", "utf-8", "ok"), "two.XML": ("olá", "latin-1", "ok")}
    junk = spark.createDataFrame([(bytearray(range(128, 256)) * 20,)], "c binary").select(readers.decode(F.col("c")).alias("d")).first().d
    assert junk.status == "invalid"
    empty = spark.sql("SELECT CAST('' AS BINARY) AS c").select(readers.decode(F.col("c")).alias("d")).first().d
    assert (empty.text, empty.status) == ("", "empty")
    assert readers.ignored_files(spark, str(tmp_path)).first().ignored == 1


def test_summary_names(spark):
    names = spark.createDataFrame([("x summary.txt",), ("Resumo.txt",), ("hands.txt",)], "n string")
    assert [r.n for r in names.where(readers.not_summary_file(F.col("n"))).collect()] == ["hands.txt"]


def test_bad_json_lines_are_kept(spark, tmp_path):
    path = tmp_path / "h.jsonl"
    path.write_text(json.dumps({"site": "gg", "hero": "A"}) + "\n{broken\n")
    rows = readers.hands_jsonl(spark, str(path)).cache()
    assert rows.where("bad_line IS NULL").count() == 1
    assert rows.where("bad_line IS NOT NULL").first().bad_line == "{broken"


def test_sinks_round_trip(spark, sf_dir, tmp_path):
    hands = tables.hands(spark, sf_dir)
    facts = opportunities.with_month_and_groups(derive.derive_facts(hands)).withColumn("hand_id", F.col("h").cast("string"))
    metrics = catalogue.for_family(catalogue.catalogue(), "POSTFLOP_SHOWDOWN")
    hits = opportunities.stat_hits(facts, metrics)
    sinks.write_hits(hits, str(tmp_path / "hits"))
    back = spark.read.parquet(str(tmp_path / "hits"))
    assert back.count() == hits.count() and {"month", "grp"} <= set(back.columns)
    plan = back.where("month = '2024-01' AND grp = 'postflop_all'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    enriched = derive.enrich_hands(hands).withColumn("month", F.lit("2024-01"))
    sinks.write_enriched(enriched, str(tmp_path / "enriched"))
    assert derive.hand_context(spark.read.parquet(str(tmp_path / "enriched"))).count() == hands.count()
    sinks.write_by_fields(hands.select("h", "site", "hero"), {"site": F.col("site"), "hero": F.col("hero")}, str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by")).where("field = 'site' AND group_key = 'gg'").count() == hands.where("site = 'gg'").count()
    cube = opportunities.count_hands(facts, metrics)
    sinks.write_csv(cube, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == cube.count()
    for _ in range(2):  # a retry replaces its own rows
        sinks.write_history(opportunities.with_percentage(cube), str(tmp_path / "history"), "run-1")
    sinks.write_history(opportunities.with_percentage(cube).limit(3), str(tmp_path / "history"), "run-2")
    assert spark.read.parquet(str(tmp_path / "history")).count() == cube.count() + 3
    assert dict(spark.read.parquet(str(tmp_path / "history")).dtypes)["percentage"] == "decimal(7,2)"


def test_text_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("A/B", "x one"), ("A/B", "two"), ("C", "three")], "stat_id string, text string")
    sinks.write_stat_texts(rows, str(tmp_path / "t"))
    body = "".join(p.read_text() for p in (tmp_path / "t" / "stat_id=A_B").glob("part-*"))
    assert sorted(body.split("\n\n")) == ["", "two", "x one"]
    files = spark.createDataFrame([("k", "n1", "c1"), ("k", "n2", "")], "class string, name string, text string")
    sinks.write_compiled(files, str(tmp_path / "c"))
    assert "".join(p.read_text() for p in (tmp_path / "c" / "class=k").glob("part-*")) == "=== n1 ===\nc1\n\n"


def test_room_sheets(spark, tmp_path):
    (tmp_path / "nine.csv").write_text('Total Hands,EP 3Bet,EP Cold Call,Early UO VPIP\n10,"0,105","0,2",NA\n')
    sheet = readers.room_sheet(spark, str(tmp_path / "nine.csv"))
    row = reports.wide_merge({"9MAX": sheet}).first().asDict()
    assert row == {"9MAX_Total Hands": "10", "9MAX_EP 3Bet": "10,5", "9MAX_EP Cold Call": "20,0", "9MAX_EP VPIP": "30,5"}
    assert readers.numeric_cells(sheet).first()["Early UO VPIP"] == 0.0


def counts_of(df):
    return {(r.month, r.grp, r.stat_id): (r.opportunities, r.attempts) for r in df.collect()}


def test_incremental_counts(spark, sf_dir, tmp_path):
    tables.hands(spark, sf_dir).drop("h").write.parquet(str(tmp_path / "hands"))
    hands = spark.read.parquet(str(tmp_path / "hands"))
    src, cube, ids, ck = (str(tmp_path / n) for n in ("src", "cube", "ids", "ck"))
    metrics = catalogue.for_family(catalogue.catalogue(), "POSTFLOP_RIVER")
    unique = incremental.with_identity(hands).dropDuplicates(["hand_id"])
    want = opportunities.count_hands(opportunities.with_month_and_groups(derive.derive_facts(unique)), metrics)
    expected = counts_of(want)
    half = F.pmod(F.try_element_at("raw_offsets", F.lit("hand_start")), F.lit(2))
    hands.where(half == 0).coalesce(1).write.mode("append").json(src)
    incremental.run_incremental(spark, src, cube, ids, ck, metrics).awaitTermination()
    # the second drop repeats the first half, under the name of another file, and adds the rest
    hands.withColumn("file_id", F.concat(F.lit("copy/"), F.col("file_id"))).coalesce(1).write.mode("append").json(src)
    incremental.run_incremental(spark, src, cube, ids, ck, metrics).awaitTermination()
    assert counts_of(incremental.read_counts(spark, cube)) == expected
    # a lost checkpoint starts over and finds every hand stored
    incremental.run_incremental(spark, src, cube, ids, str(tmp_path / "ck2"), metrics).awaitTermination()
    assert counts_of(incremental.read_counts(spark, cube)) == expected
    for _ in range(2):
        incremental.compact_counts(spark, cube, str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == len(expected)
    incremental.compact_ids(spark, ids, str(tmp_path / "ids2"))
    incremental.run_incremental(spark, src, cube, str(tmp_path / "ids2"), str(tmp_path / "ck3"), metrics).awaitTermination()
    assert counts_of(incremental.read_counts(spark, cube)) == expected


def test_old_hands_and_repeated_batches_count_once(spark, tmp_path):
    schema = "hand_id string, month string"
    cube, ids = str(tmp_path / "cube"), str(tmp_path / "ids")
    count = lambda df: df.groupBy("month").agg(F.count("*").alias("opportunities")).selectExpr("month", "'g' grp", "'s' stat_id", "opportunities", "0L attempts")
    first = spark.createDataFrame([("a", "2024-05"), ("b", "2024-05")], schema)
    old = spark.createDataFrame([("c", "2019-01"), ("a", "2024-05"), ("d", "2001-07")], schema)
    add = incremental.merge_counts(count, cube, ids, "one")
    for batch, number in ((first, 0), (old, 1), (old, 1)):  # the second batch is retried
        add(batch, number)
    incremental.merge_counts(count, cube, ids, "two")(first.union(old), 0)
    assert {r.month: r.opportunities for r in incremental.read_counts(spark, cube).where("opportunities > 0").collect()} == {"2024-05": 2, "2019-01": 1, "2001-07": 1}


def test_live_counts(spark, sf_dir, tmp_path):
    hands = tables.hands(spark, sf_dir).drop("h")
    src = str(tmp_path / "src")
    hands.coalesce(1).write.json(src)
    metrics = catalogue.for_family(catalogue.catalogue(), "POSTFLOP_SHOWDOWN")
    live = incremental.live_counts(incremental.hand_stream(spark, src), metrics)
    query = live.writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    query.awaitTermination()
    assert counts_of(spark.table("live")) == counts_of(opportunities.count_hands(opportunities.with_month_and_groups(derive.derive_facts(hands)), metrics))


class _Session:
    def __init__(self, settings):
        self.conf = settings


def test_state_root_prefers_the_cluster_setting():
    assert incremental.state_root(_Session({"spark.checkpoint.dir": "/shared/ck/"}), "q", "/tmp/x") == "/shared/ck/q"
    assert incremental.state_root(_Session({}), "q", "/tmp/x") == "/tmp/x/q"
