"""Files: tables written as text, JSON lines and room sheets, and read back by range, by place and by sink."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import facts, handtext, runs, tables, textcounters, texts
from checks.streams import folder
from tallyhand.functions import handtext as ht
from tallyhand.functions import timecols, tourney
from tallyhand.operators import cube as cubes
from tallyhand.operators import records, reports, runstate, segments
from tallyhand.plans import rooms
from tallyhand.sources import readers, sinks, splits

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def keep(fn):
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn

    return keep


def _part(path, at: int):
    """The value of a partition folder, counted from the end of the path."""
    return F.element_at(F.split(F.element_at(F.split(path, "/"), at), "="), -1)


# --- text by range ---------------------------------------------------------------------------


def _written_files(spark: SparkSession, sf_dir: str) -> str:
    root = f"{folder(spark)}/rooms"
    texts.files(spark, sf_dir).withColumnRenamed("text", "value").write.partitionBy("file_id").text(root)
    return root


@query("segment_hands_by_range", texts.ORACLES["segment_hands"])
def segment_hands_by_range(spark, sf_dir):
    """The hands of files that were read line by line, by range."""
    lines = splits.text_lines(spark, _written_files(spark, sf_dir))
    hands = segments.split_pieces(splits.hand_pieces(lines))
    return hands.select(_part(F.col("path"), -2).alias("file_id"), ht.hand_id(F.col("text")).alias("hand_id"), F.size(segments.blocks(F.col("text"))).alias("blocks"), "valid")


@query(
    "decoded_files",
    f"{texts.TEXTS}, {texts.FILES} SELECT file_id, length(text) + 1 AS chars, 'utf-8' AS encoding, 'ok' AS status, true AS hands FROM files",
)
def decoded_files(spark, sf_dir):
    """Every file found, decoded and tested for junk and for a summary's name."""
    files = readers.text_files(spark, _written_files(spark, sf_dir)).withColumn("d", readers.decode(F.col("content")))
    return files.select(_part(F.col("path"), -2).alias("file_id"), F.length("d.text").cast("long").alias("chars"), "d.encoding", "d.status", readers.not_summary_file(F.col("name")).alias("hands"))


# --- lines and their numbers -----------------------------------------------------------------

# an order is a line, cut off after every seventeenth; a file holds a thousand, every fourth number is there
_LINES = """SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS f, o_orderkey,
  CASE WHEN o_orderkey % 17 = 5 THEN '{"hero": "' || o_orderkey ELSE '{"hero": "c' || o_custkey || '", "tournament_id": "' || o_orderkey || '"}' END AS line FROM orders"""


def _jsonl(spark: SparkSession, sf_dir: str) -> str:
    root = f"{folder(spark)}/lines"
    tables.views(spark, sf_dir, "orders")
    rows = spark.sql(_LINES).repartition("f").sortWithinPartitions("f", "o_orderkey")
    rows.select("f", F.col("line").alias("value")).write.partitionBy("f").text(root)
    return root


@query(
    "bad_line_numbers",
    f"WITH l AS ({_LINES}) SELECT f::VARCHAR AS file, line_number, line AS bad_line FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY o_orderkey) AS line_number FROM l) WHERE o_orderkey % 17 = 5",
)
def bad_line_numbers(spark, sf_dir):
    bad = splits.bad_lines(spark, _jsonl(spark, sf_dir))
    return bad.select(_part(F.col("path"), -2).alias("file"), "line_number", "bad_line")


@query(
    "first_line_wins",
    f"""WITH l AS ({_LINES}), n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY o_orderkey) AS line_number FROM l)
    SELECT 'c' || o_custkey AS hero, arg_min(n.o_orderkey, (f, line_number))::VARCHAR AS tournament_id FROM n JOIN orders USING (o_orderkey) WHERE o_orderkey % 17 <> 5 GROUP BY 1""",
)
def first_line_wins(spark, sf_dir):
    """Of a customer's lines the first, files in order of their number."""
    hands = splits.hands_jsonl_lines(spark, _jsonl(spark, sf_dir)).where("bad_line IS NULL")
    placed = hands.select(_part(F.col("path"), -2).cast("long").alias("file"), "block", "at", "hero", "tournament_id")
    return records.first_records(placed, "hero", ["file", "block", "at"]).select("hero", "tournament_id")


# --- the job from files to reports -----------------------------------------------------------

_NAMED = "'F' || CAST(floor(h / 20) AS BIGINT) || CASE CAST(floor(h / 20) AS BIGINT) % 4 WHEN 1 THEN ' pko' WHEN 2 THEN ' mystery' WHEN 3 THEN ' bounty' ELSE '' END"
_ROOM = f"""
room AS (SELECT h, month, 'room ' || CAST(floor(h / 20) AS BIGINT) % 3 AS source, sha1(lower(replace(replace(
    CASE WHEN h % 3 = 0 THEN text || chr(10) || chr(10) || 'late note ' || h ELSE text END, chr(13) || chr(10), chr(10)), chr(10) || chr(10), chr(10)))) AS hand_id,
  CASE WHEN CAST(floor(h / 20) AS BIGINT) % 4 = 2 THEN 'mystery' WHEN n_seats < 4 THEN 'less_than_4_players' END AS discard_reason,
  CASE WHEN CAST(floor(h / 20) AS BIGINT) % 4 IN (1, 3) THEN 'pko' WHEN n_seats <= 6 THEN 'nonko_6max' ELSE 'nonko_9max' END AS grp
  FROM (SELECT *, strftime(timezone('Europe/Lisbon', timezone('UTC', hand_ts)), '%Y-%m') AS month FROM (SELECT * EXCLUDE (month) FROM texts))),
ends AS (SELECT h, 'unknown' AS month, 'room ' || CAST(floor(h / 20) AS BIGINT) % 3 AS source, 'tournament_summary' AS discard_reason FROM texts WHERE h % 5 = 4),
seg AS (SELECT h, month, source, discard_reason, CASE WHEN discard_reason IS NULL THEN grp END AS grp FROM room UNION ALL SELECT h, month, source, discard_reason, NULL FROM ends)
"""
_CELLS = ["total_hands", "valid_hands", *cubes.DISCARD_REASONS, "residual"]
_TOTAL_SQL = ", ".join(
    "count(*) AS total_hands" if c == "total_hands" else "count(*) FILTER (WHERE discard_reason IS NULL) AS valid_hands" if c == "valid_hands"
    else "0::BIGINT AS residual" if c == "residual" else f"count(*) FILTER (WHERE discard_reason = '{c}') AS {c}" for c in _CELLS
)


def _rooms(spark: SparkSession, sf_dir: str) -> rooms.Rooms:
    f = F.substring("file_id", 2, 20).cast("long")
    kind = F.when(f % 4 == 1, " pko").when(f % 4 == 2, " mystery").when(f % 4 == 3, " bounty").otherwise("")
    files = texts.files(spark, sf_dir).select(F.concat("file_id", kind).alias("file_id"), "text", F.concat(F.lit("room "), f % 3).alias("source"))
    return rooms.run_rooms(files, folder(spark))


@query(
    "room_totals",
    f"""{texts.TEXTS}, {_ROOM}, t AS (SELECT source, {_TOTAL_SQL} FROM seg GROUP BY source)
    SELECT 'total' AS kind, source AS name, item, hands FROM (UNPIVOT t ON {', '.join(_CELLS)} INTO NAME item VALUE hands)
    UNION ALL SELECT 'sample', CASE WHEN discard_reason IS NULL THEN 'group:' || grp ELSE 'discard:' || discard_reason END, 'hands', count(*) FROM seg GROUP BY 2
    UNION ALL SELECT 'sample', 'group:postflop_all', 'hands', count(*) FROM seg WHERE discard_reason IS NULL
    UNION ALL SELECT 'sample', 'total', 'hands', count(*) FROM seg
    UNION ALL SELECT 'month', month, 'hands', count(*) FROM seg WHERE discard_reason IS NULL GROUP BY month""",
)
def room_totals(spark, sf_dir):
    """Totals, samples and months of all segments, what the splitter dropped included."""
    done = _rooms(spark, sf_dir)
    cells = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("long").alias("hands")) for c in _CELLS])
    return (
        done.totals.select(F.lit("total").alias("kind"), F.col("source").alias("name"), F.inline(cells))
        .unionByName(done.samples.select(F.lit("sample").alias("kind"), "name", F.lit("hands").alias("item"), "hands"))
        .unionByName(done.months.select(F.lit("month").alias("kind"), F.col("month").alias("name"), F.lit("hands").alias("item"), "hands"))
    )


def _by_grp(source: str) -> str:
    """The flags of valid hands with their group in the place of their site."""
    return f"{source}_g AS (SELECT {source}.* REPLACE (g.grp AS site) FROM {source} JOIN seg g ON g.h = {source}.h AND g.discard_reason IS NULL)"


def _counted(source: str, table: dict) -> str:
    return textcounters._count(f"{source}_g", table).replace(f" {source}.h ", f" {source}_g.h ")


@query(
    "room_counters",
    f"""{textcounters.POST}, seatn AS (SELECT h, count(*) AS n_seats FROM seated GROUP BY h),
    seg AS (SELECT h, CASE WHEN CAST(floor(h / 20) AS BIGINT) % 4 = 2 THEN 'mystery' WHEN n_seats < 4 THEN 'few' END AS discard_reason,
      CASE WHEN CAST(floor(h / 20) AS BIGINT) % 4 IN (1, 3) THEN 'pko' WHEN n_seats <= 6 THEN 'nonko_6max' ELSE 'nonko_9max' END AS grp FROM seatn),
    {_by_grp('pre')}, {_by_grp('post')}, c AS ({_counted('pre', textcounters.PRE_SQL)} UNION ALL {_counted('post', textcounters.POST_SQL)})
    SELECT site AS grp, stat_id, opportunities, attempts FROM c""",
)
def room_counters(spark, sf_dir):
    """The text counters of valid records, over all months."""
    done = _rooms(spark, sf_dir)
    known = [*textcounters.PRE_SQL, *textcounters.POST_SQL]
    return cubes.add_up(done.counters.where(F.col("stat_id").isin(known)), ["grp", "stat_id"])


@query(
    "sample_id_lists",
    f"""{runs.DUCK_RECORDS}, n AS (SELECT hand_id, month, source, unnest(CASE WHEN discard_reason IS NULL THEN ['group:' || grp, 'group:postflop_all', 'total'] ELSE ['discard:' || discard_reason, 'total'] END) AS name FROM rec)
    SELECT name, coalesce(month, 'none') AS month, source, hand_id FROM n""",
)
def sample_id_lists(spark, sf_dir):
    """The id lists of the samples, written by name and month and read back."""
    path = f"{folder(spark)}/samples"
    sinks.write_samples(cubes.sample_ids(runs.hand_records(spark, sf_dir)), path)
    return spark.read.schema("source string, hand_id string, name string, month string").parquet(path).select("name", F.coalesce("month", F.lit("none")).alias("month"), "source", "hand_id")


# --- merging runs ----------------------------------------------------------------------------

# three runs that share hands; the first was repeated for January 1996 without every fourth hand
_RUN_ROWS = [("a", 1, "o_orderkey % 3 <> 0"), ("b", 1, "o_orderkey % 3 <> 1"), ("c", 1, "o_orderkey % 3 <> 2"), ("a", 2, "o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 AND month = '1996-01'")]
_KEPT = [("a", "o_orderkey % 3 <> 0 AND (month IS DISTINCT FROM '1996-01' OR o_orderkey % 4 <> 0)"), *[(r, c) for r, v, c in _RUN_ROWS[1:3]]]


def _states(spark: SparkSession, sf_dir: str) -> list[runstate.RunState]:
    rows, made = runs.hand_records(spark, sf_dir), []
    for run, version, cond in _RUN_ROWS:
        mine = rows.where(cond)
        valid = mine.where("discard_reason IS NULL")
        cube = valid.groupBy("month", "grp").agg(F.count("*").alias("opportunities"), F.count(F.when(F.col("o_orderkey") % 2 == 0, 1)).alias("attempts"))
        dropped = mine.where("discard_reason IS NOT NULL").groupBy("month", F.col("discard_reason").alias("reason")).agg(F.count("*").alias("hands"))
        made.append(runstate.run_state(run, version, cube.withColumn("stat_id", F.lit("even")), dropped, valid))
    return made


@query(
    "merged_run_state",
    f"""{runs.DUCK_RECORDS}, r AS ({' UNION ALL '.join(f"SELECT '{run}' AS run, * FROM rec WHERE {cond}" for run, cond in _KEPT)}),
    v AS (SELECT DISTINCT hand_id, grp FROM r WHERE discard_reason IS NULL)
    SELECT 'group:' || grp AS name, count(*) AS hands FROM v GROUP BY grp UNION ALL SELECT 'valid', count(*) FROM v
    UNION ALL SELECT 'discard:' || discard_reason, count(*) FROM r WHERE discard_reason IS NOT NULL GROUP BY discard_reason UNION ALL SELECT 'discarded', count(*) FROM r WHERE discard_reason IS NOT NULL
    UNION ALL SELECT 'total', (SELECT count(*) FROM v) + (SELECT count(*) FROM r WHERE discard_reason IS NOT NULL)""",
)
def merged_run_state(spark, sf_dir):
    a, b, c, again = _states(spark, sf_dir)
    return runstate.hands(runstate.merge_states(again, runstate.merge_states(c, a), b))


@query(
    "merged_run_counters",
    f"""{runs.DUCK_RECORDS}, r AS ({' UNION ALL '.join(f"SELECT '{run}' AS run, * FROM rec WHERE {cond}" for run, cond in _KEPT)})
    SELECT month, grp, 'even' AS stat_id, count(*) AS opportunities, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS attempts FROM r WHERE discard_reason IS NULL GROUP BY month, grp""",
)
def merged_run_counters(spark, sf_dir):
    return runstate.counters(runstate.merge_states(*_states(spark, sf_dir)))


@query(
    "merge_runs_all_months",
    f"""{runs.DUCK_RECORDS}, r AS (SELECT 0 AS run, * FROM rec WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 1, * REPLACE ('late' AS source) FROM rec WHERE o_orderkey % 3 <> 1)
    SELECT hand_id, run, source, month, grp FROM (SELECT *, row_number() OVER (PARTITION BY hand_id ORDER BY run, file_id, o_orderkey) AS rn FROM r) WHERE rn = 1""",
)
def merge_runs_all_months(spark, sf_dir):
    rows = runs.hand_records(spark, sf_dir).withColumn("hand_index", F.col("o_orderkey"))
    k = F.col("o_orderkey") % 3
    merged = records.merge_runs([rows.where(k != 0), rows.where(k != 1).withColumn("source", F.lit("late"))])
    return merged.select("hand_id", "run", "source", "month", "grp")


# --- drill-down over stored tables -----------------------------------------------------------


@query("drilldown_stored", facts.ORACLES["stat_drilldown"])
def drilldown_stored(spark, sf_dir):
    """The id index and the hands in buckets of the hand, joined without an exchange."""
    root = folder(spark)
    tag = root[-32:]
    hits = facts.stat_hits(spark, sf_dir)
    month = timecols.month_bucket(F.col("timestamp_utc"))
    hands = tables.hands(spark, sf_dir).select(F.col("h").cast("string").alias("hand_id"), "site", "file_id", month.alias("month"))
    sinks.write_bucketed(hits, f"hits_{tag}", f"{root}/hits", buckets=16)
    sinks.write_bucketed(hands, f"hands_{tag}", f"{root}/hands", buckets=16)
    found = reports.drill_down_stored(spark, f"hits_{tag}", f"hands_{tag}", "POST_CBET_FLOP_OOP", "postflop_all", "attempts")
    return found.drop("month")


# --- sinks, written and read back ------------------------------------------------------------


@query("room_sheet_first_row", "SELECT arg_min(n_name, (n_regionkey, n_nationkey)) AS name, min((n_regionkey, n_nationkey))[2] / 4.0 AS quarter FROM nation")
def room_sheet_first_row(spark, sf_dir):
    """A sheet's first row in file order, its cells with decimal commas."""
    path = f"{folder(spark)}/sheet"
    rows = tables.table(spark, sf_dir, "nation").repartition(1).sortWithinPartitions("n_regionkey", "n_nationkey")
    quarter = F.replace(F.format_string("%.2f", F.col("n_nationkey") / 4), F.lit("."), F.lit(","))
    sinks.write_csv(rows.select(F.col("n_name").alias("name"), quarter.alias("quarter")), path)
    sheet = readers.room_sheet(spark, path)
    return sheet.select("name").join(readers.numeric_cells(sheet.select("quarter")))


@query("enriched_round_trip", f"{facts.duck.BASE} SELECT strftime(hand_ts, '%Y-%m') AS month, count(*) AS hands FROM hd GROUP BY 1")
def enriched_round_trip(spark, sf_dir):
    path = f"{folder(spark)}/enriched"
    month = F.substring("timestamp_utc", 1, 7)
    sinks.write_enriched(facts.derive.enrich_hands(tables.hands(spark, sf_dir)).withColumn("month", month), path)
    return sinks.partition_summary(spark.read.schema("month string").parquet(path), "month")


@query("group_round_trip", f"{facts.duck.BASE} SELECT replace(site, ' ', '_') AS group_key, count(*) AS hands FROM hd GROUP BY 1")
def group_round_trip(spark, sf_dir):
    path = f"{folder(spark)}/groups"
    sinks.write_by_group(tables.hands(spark, sf_dir), tourney.group_key("site", []), path)
    return sinks.partition_summary(spark.read.schema("group_key string").parquet(path), "group_key")


@query(
    "fields_round_trip",
    f"{facts.duck.BASE} SELECT 'site' AS field, site AS group_key, count(*) AS hands FROM hd GROUP BY ALL UNION ALL SELECT 'hero', hero, count(*) FROM hd GROUP BY hero",
)
def fields_round_trip(spark, sf_dir):
    path = f"{folder(spark)}/fields"
    keys = {f: tourney.group_key(f, []) for f in ("site", "hero")}
    sinks.write_by_fields(tables.hands(spark, sf_dir), keys, path)
    return spark.read.schema("field string, group_key string").parquet(path).groupBy("field", "group_key").agg(F.count("*").alias("hands"))


@query("csv_round_trip", "SELECT n_nationkey::VARCHAR AS nation, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def csv_round_trip(spark, sf_dir):
    path = f"{folder(spark)}/csv"
    n, r = tables.table(spark, sf_dir, "nation"), tables.table(spark, sf_dir, "region")
    sinks.write_csv(n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("region")), path)
    return spark.read.option("header", "true").csv(path)


@query(
    "stat_texts_round_trip",
    f"{texts.TEXTS} SELECT site AS stat, count(*) AS hands, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 2) AS BIGINT) AS lines FROM texts GROUP BY site",
)
def stat_texts_round_trip(spark, sf_dir):
    """Hand texts by site: a hand ends with a blank line."""
    path = f"{folder(spark)}/texts"
    sinks.write_stat_texts(handtext.texts(spark, sf_dir).withColumn("stat_id", F.col("site")), path)
    lines = splits.text_lines(spark, path)
    return lines.groupBy(_part(F.col("path"), -2).alias("stat")).agg(F.count(F.when(F.col("line").startswith("PokerStars Hand #"), 1)).alias("hands"), F.count("*").alias("lines"))


# --- tests of whole texts: what tells a text stands at its end ---------------------------------

_TAIL = """CASE doc_id % 8 WHEN 0 THEN 'Tournament #5 Seat 1: a' WHEN 1 THEN 'Seat 1: a' || chr(10) || 'Dealt to a' WHEN 2 THEN 'PokerStars' WHEN 4 THEN 'Prize: ' ELSE '' END"""


def _tailed(spark, sf_dir, tail) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), tail).alias("text"))


@query("text_tests_whole", "SELECT doc_id, doc_id % 8 IN (2, 4) AS summary, doc_id % 8 = 1 AS cash, doc_id % 8 IN (0, 1) AS essential FROM documents")
def text_tests_whole(spark, sf_dir):
    t = F.col("text")
    return _tailed(spark, sf_dir, F.expr(_TAIL.replace("chr(10)", "'\\n'"))).select(
        "doc_id", ht.is_summary(t).alias("summary"), ht.is_cash_game(t).alias("cash"), ht.has_essentials(t).alias("essential")
    )


@query(
    "site_detection_whole",
    """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'ggpoker' WHEN 1 THEN '888.pt' WHEN 2 THEN '888poker' WHEN 3 THEN 'pokerstars' WHEN 4 THEN 'wpn' WHEN 5 THEN 'winamax' WHEN 6 THEN 'ipoker' END AS site,
      CASE doc_id % 8 WHEN 1 THEN '888.pt' WHEN 2 THEN '888poker' WHEN 3 THEN 'pokerstars' WHEN 4 THEN 'wpn' WHEN 5 THEN 'winamax' ELSE 'unknown' END AS network FROM documents""",
)
def site_detection_whole(spark, sf_dir):
    k = F.col("doc_id") % 8
    tail = (
        F.when(k == 0, "Poker Hand #TM12: ").when(k == 1, "***** 888.pt ").when(k == 2, "***** 888poker ").when(k == 3, "PokerStars Hand #1: Seat 1: Dealt to ")
        .when(k == 4, "Game Hand #1 *** HOLE CARDS *** ").when(k == 5, "Winamax Poker - ").when(k == 6, "GAME #1 TEXAS_HOLDEM ").otherwise("You finished in ")
    )
    docs = _tailed(spark, sf_dir, tail)
    return docs.select("doc_id", ht.source_site(F.col("text"), F.lit("a.txt")).alias("site"), ht.network(F.col("text")).alias("network"))


@query(
    "classes_whole",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'MYSTERY' WHEN 3 THEN 'NON_KO' ELSE 'PKO' END AS header, CASE doc_id % 4 WHEN 0 THEN 'mystery' WHEN 3 THEN 'non-KO' ELSE 'PKO' END AS file,
      CASE doc_id % 4 WHEN 0 THEN '''Mystery Bounty'' detected' WHEN 1 THEN 'buy-in with bounty part detected' WHEN 2 THEN '''Bounty Hunters'' detected' ELSE 'no special keywords found' END AS reason FROM documents""",
)
def classes_whole(spark, sf_dir):
    k = F.col("doc_id") % 4
    docs = _tailed(spark, sf_dir, F.when(k == 0, "Mystery Bounty").when(k == 1, "$5.00 + $5.00 + $1").when(k == 2, "Bounty Hunters").otherwise(""))
    given = tourney.class_with_reason(F.col("text"), F.lit("day.txt"), network_rules=True)
    return docs.select("doc_id", tourney.class_from_header(F.col("text")).alias("header"), given["class_name"].alias("file"), given["reason"].alias("reason"))


@query("months_in_whole_texts", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN '2023-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') END AS month FROM documents")
def months_in_whole_texts(spark, sf_dir):
    month = F.concat(F.lit("2023-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"))
    k = F.col("doc_id") % 3
    bare = F.translate(F.coalesce("text", F.lit("")), "0123456789", "")
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", F.concat(bare, F.lit(" "), F.when(k == 0, F.concat(month, F.lit("-15 12:00:00"))).when(k == 1, month).otherwise("")).alias("text"))
    return docs.select("doc_id", timecols.month_in_text(F.col("text")).alias("month"))
