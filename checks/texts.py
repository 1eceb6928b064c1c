"""Queries over raw text: hand texts written from the events table, documents and names."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import duck, handtext, tables
from tallyhand.functions import handtext as ht
from tallyhand.functions import numbers, timecols, tourney
from tallyhand.operators import classify, months, records, segments

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


# --- hand texts, written a second time in SQL ------------------------------------------

TEXTS = (
    duck.BASE
    + """,
lines AS (SELECT h, slot, street, CASE type WHEN 'FOLD' THEN actor || ': folds' WHEN 'CHECK' THEN actor || ': checks'
    WHEN 'CALL' THEN actor || ': calls ' || printf('%.2f', amount) WHEN 'BET' THEN actor || ': bets ' || printf('%.2f', amount)
    WHEN 'POST_SB' THEN actor || ': posts small blind 2' WHEN 'POST_BB' THEN actor || ': posts big blind 4'
    WHEN 'ALLIN' THEN actor || ': raises 1.00 to ' || printf('%.2f', amount) || ' and is all-in'
    ELSE actor || ': raises 1.00 to ' || printf('%.2f', amount) END AS line FROM acts),
sec AS (SELECT h, street, string_agg(line, chr(10) ORDER BY slot) AS body FROM lines GROUP BY h, street),
seatl AS (SELECT h, count(*) AS n_seats,
    string_agg('Seat ' || seat || ': ' || name || ' (' || CAST(stack AS INT) || ' in chips)', chr(10) ORDER BY seat) AS seats,
    string_agg('Seat ' || seat || ': ' || name || CASE WHEN name = hero THEN ' (button) mucked' ELSE ' folded before Flop' END, chr(10) ORDER BY seat) AS ends
  FROM seated GROUP BY h),
texts AS MATERIALIZED (
  SELECT hd.*, seatl.n_seats,
    'PokerStars Hand #' || hd.h || ': Tournament #' || hd.h % 40 || ', $1+$1 USD Hold''em No Limit - Level I (2/4) - '
    || strftime(hand_ts, '%Y/%m/%d %H:%M:%S') || ' ET' || chr(10) || 'Table ''' || hd.h || ' 1'' 9-max Seat #' || button_seat || ' is the button' || chr(10)
    || seatl.seats || chr(10) || 'dealer: posts big blind 4' || chr(10) || '*** HOLE CARDS ***' || chr(10) || 'Dealt to ' || hd.hero || ' [Ah Kd]' || chr(10) || p.body
    || coalesce(chr(10) || '*** FLOP ***' || chr(10) || f.body, '') || coalesce(chr(10) || '*** TURN ***' || chr(10) || t.body, '')
    || coalesce(chr(10) || '*** RIVER ***' || chr(10) || r.body, '')
    || CASE WHEN shown THEN chr(10) || '*** SHOW DOWN ***' || chr(10) || hd.hero || ': shows [Ah Kd] (high card)' ELSE '' END
    || CASE WHEN hero_won THEN chr(10) || hd.hero || ' collected 12 from pot' ELSE '' END
    || chr(10) || '*** SUMMARY ***' || chr(10) || 'Total pot 12' || chr(10) || seatl.ends AS text
  FROM hd JOIN seatl USING (h) JOIN sec p ON p.h = hd.h AND p.street = 'preflop'
  LEFT JOIN sec f ON f.h = hd.h AND f.street = 'flop' LEFT JOIN sec t ON t.h = hd.h AND t.street = 'turn' LEFT JOIN sec r ON r.h = hd.h AND r.street = 'river')
"""
)


@query("hand_texts", TEXTS + " SELECT h, sha1(lower(text)) AS digest, length(text) AS chars FROM texts")
def hand_texts(spark, sf_dir):
    return handtext.texts(spark, sf_dir).select(
        "h", records.fingerprint(F.col("text")).alias("digest"), F.length("text").cast("bigint").alias("chars")
    )


_MARKS = {
    "hole_cards": "*** HOLE CARDS ***", "flop": "*** FLOP ***", "turn": "*** TURN ***", "river": "*** RIVER ***",
    "showdown": "*** SHOW DOWN ***", "summary": "*** SUMMARY ***",
}


@query(
    "section_offsets",
    TEXTS
    + " UNION ALL ".join(f" SELECT h, '{k}' AS section, CAST(strpos(text, '{m}') - 1 AS INT) AS at FROM texts WHERE contains(text, '{m}')" for k, m in _MARKS.items())
    + " UNION ALL SELECT h, 'hand_start', 0 FROM texts UNION ALL SELECT h, 'hand_end', CAST(length(text) AS INT) FROM texts",
)
def section_offsets(spark, sf_dir):
    return handtext.texts(spark, sf_dir).select("h", F.explode(ht.section_offsets(F.col("text"))).alias("section", "at"))


@query(
    "hand_excerpt",
    TEXTS
    + """ SELECT h, replace(substr(text, greatest(0, strpos(text, '*** HOLE CARDS ***') - 1 - 20) + 1,
        least(length(text), strpos(text, '*** HOLE CARDS ***') - 1 + 60 + 20) - greatest(0, strpos(text, '*** HOLE CARDS ***') - 1 - 20)), hero, '**' || hero || '**') AS cut FROM texts""",
)
def hand_excerpt(spark, sf_dir):
    start = F.try_element_at(ht.section_offsets(F.col("text")), F.lit("hole_cards"))
    return handtext.texts(spark, sf_dir).select("h", ht.excerpt(F.col("text"), start, start + 60, 20, F.col("hero")).alias("cut"))


@query(
    "header_metadata",
    TEXTS
    + """ SELECT h, 'pokerstars' AS site, (h % 40)::VARCHAR AS tournament_id, h::VARCHAR AS hand_id, strftime(hand_ts, '%Y-%m') AS printed_month,
      'USD Hold''em No Limit' AS tail FROM texts""",
)
def header_metadata(spark, sf_dir):
    t = F.col("text")
    site = ht.source_site(t, F.lit("x.txt"), 5000, 10000, 2000)
    return handtext.texts(spark, sf_dir).select(
        "h", site.alias("site"), ht.tournament_id(t).alias("tournament_id"), ht.hand_id(t).alias("hand_id"),
        timecols.month_in_header(t, site, 1500).alias("printed_month"),
        F.concat(F.lit("USD "), ht.tournament_name(t, 500)).alias("tail"),
    )


@query(
    "seat_stack_rows",
    TEXTS + " SELECT h, CAST(seat AS INT) AS seat, name, stack AS chips FROM seated",
)
def seat_stack_rows(spark, sf_dir):
    rows = handtext.texts(spark, sf_dir)
    seat = rows.select("h", F.inline(ht.seat_list(F.col("text"))))
    chips = rows.select("h", F.inline(ht.stack_list(F.col("text"))))
    return seat.join(chips, ["h", "name"])


_VERBS = "CASE WHEN type = 'FOLD' THEN 'folds' WHEN type = 'CHECK' THEN 'checks' WHEN type = 'CALL' THEN 'calls' WHEN type = 'BET' THEN 'bets' ELSE 'raises' END"


@query(
    "action_rows",
    TEXTS
    + f""" SELECT h, street, CAST(row_number() OVER (PARTITION BY h, street ORDER BY slot) - 1 AS INT) AS pos, actor AS player, {_VERBS} AS verb,
      CASE WHEN street = 'preflop' OR type IN ('FOLD', 'CHECK') THEN 0.0 ELSE amount END AS amount, type = 'ALLIN' AS allin
    FROM acts WHERE type NOT IN ('POST_SB', 'POST_BB')""",
)
def action_rows(spark, sf_dir):
    return handtext.texts(spark, sf_dir).select("h", F.inline(ht.hand_actions(F.col("text"))))


@query(
    "action_types",
    TEXTS
    + f""" SELECT type AS given, CASE WHEN type = 'FOLD' THEN 'FOLD' WHEN type = 'CHECK' THEN 'CHECK' WHEN type = 'CALL' THEN 'CALL' WHEN type = 'BET' THEN 'BET'
      WHEN type IN ('RAISE', 'RERAISE', 'ALLIN') THEN 'RAISE' END AS kind, count(*) AS actions FROM acts GROUP BY type""",
)
def action_types(spark, sf_dir):
    tables.views(spark, sf_dir, "events")
    acts = spark.sql(tables.ACTS_SQL)
    word = F.when(F.col("type") == "ALLIN", "is all-in").otherwise(F.lower("type"))
    return acts.groupBy(F.col("type").alias("given"), ht.action_kind(word, F.col("type") == "ALLIN").alias("kind")).agg(
        F.count(F.lit(1)).alias("actions")
    )


@query(
    "text_outcomes",
    TEXTS
    + """ SELECT h, shown AS showdown, shown OR hero_won AS hero_showed, hero_won, EXISTS (SELECT 1 FROM acts a WHERE a.h = texts.h AND a.street = 'flop') AS flop,
      EXISTS (SELECT 1 FROM acts a WHERE a.h = texts.h AND a.street = 'turn') AS turn, EXISTS (SELECT 1 FROM acts a WHERE a.h = texts.h AND a.street = 'river') AS river FROM texts""",
)
def text_outcomes(spark, sf_dir):
    t, hero = F.col("text"), F.col("hero")
    return handtext.texts(spark, sf_dir).select(
        "h", ht.showdown_seen(t).alias("showdown"), ht.hero_at_showdown(t, hero).alias("hero_showed"), ht.hero_won(t, hero).alias("hero_won"),
        *[ht.reached(t, s).alias(s) for s in ("flop", "turn", "river")],
    )


@query(
    "table_formats",
    TEXTS + " SELECT h, CAST(n_seats AS INT) AS players, CASE WHEN n_seats < 4 THEN 'discard' WHEN n_seats <= 6 THEN '6-max' ELSE '9-max' END AS format FROM texts",
)
def table_formats(spark, sf_dir):
    t = F.col("text")
    return handtext.texts(spark, sf_dir).select("h", ht.active_players(t).alias("players"), ht.table_format(t).alias("format"))


VERDICT = """
verdict AS (SELECT h, file_id, text, month, hand_ts, n_seats, hero,
  CASE WHEN h % 10 = 1 THEN 'mystery' WHEN n_seats < 4 THEN 'less_than_4_players' END AS discard_reason,
  CASE WHEN h % 10 IN (0, 2, 3) THEN 'PKO' WHEN h % 10 = 1 THEN 'NON-KO' ELSE 'NON-KO' END AS tournament_type,
  CASE WHEN n_seats < 4 THEN 'discard' WHEN n_seats <= 6 THEN '6-max' ELSE '9-max' END AS table_format FROM texts),
classed AS (SELECT *, CASE WHEN discard_reason IS NULL THEN CASE WHEN tournament_type = 'PKO' THEN 'pko' WHEN table_format = '6-max' THEN 'nonko_6max' ELSE 'nonko_9max' END END AS grp FROM verdict)
"""


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_hands(handtext.texts(spark, sf_dir).select("h", "file_id", "text"))


@query(
    "discard_reason",
    f"{TEXTS}, {VERDICT} SELECT h, grp, discard_reason, tournament_type, table_format, month, sha1(lower(text)) AS hand_id FROM classed",
)
def discard_reason(spark, sf_dir):
    return classed(spark, sf_dir).select("h", "grp", "discard_reason", "tournament_type", "table_format", "month", "hand_id")


@query(
    "file_totals",
    f"""{TEXTS}, {VERDICT} SELECT file_id, count(*) AS total_hands, count(grp) AS classified_hands, count(*) FILTER (WHERE grp = 'nonko_9max') AS nonko_9max,
      count(*) FILTER (WHERE grp = 'nonko_6max') AS nonko_6max, count(*) FILTER (WHERE grp = 'pko') AS pko FROM classed GROUP BY file_id""",
)
def file_totals(spark, sf_dir):
    return classify.file_totals(classed(spark, sf_dir))


@query(
    "dominant_format",
    f"""{TEXTS}, {VERDICT} SELECT file_id, count(*) FILTER (WHERE table_format = '6-max') AS six_max, count(*) FILTER (WHERE table_format = '9-max') AS nine_max,
      CASE WHEN count(*) FILTER (WHERE table_format = '6-max') > count(*) FILTER (WHERE table_format = '9-max') THEN '6-max' ELSE '9-max' END AS format FROM classed GROUP BY file_id""",
)
def dominant_format(spark, sf_dir):
    return segments.dominant_format(classed(spark, sf_dir))


# --- files of several hands -----------------------------------------------------------------

# a file: twenty hands, a summary after every fifth, a continuation block after every third
FILES = """
parts AS (SELECT CAST(floor(h / 20) AS BIGINT) AS f, h, text || CASE WHEN h % 3 = 0 THEN chr(10) || ' ' || chr(10) || 'late note ' || h ELSE '' END
    || CASE WHEN h % 5 = 4 THEN chr(10) || chr(10) || chr(10) || 'Tournament Results ' || h ELSE '' END AS part FROM texts),
files AS (SELECT 'F' || f AS file_id, 'preamble' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY h) AS text FROM parts GROUP BY f)
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = handtext.texts(spark, sf_dir)
    part = F.concat(
        "text",
        F.when(F.col("h") % 3 == 0, F.concat(F.lit("\n \nlate note "), F.col("h"))).otherwise(F.lit("")),
        F.when(F.col("h") % 5 == 4, F.concat(F.lit("\n\n\nTournament Results "), F.col("h"))).otherwise(F.lit("")),
    )
    # all partitions are kept: cutting or storing a file takes far longer than its bytes tell, and a few merged ones leave cores idle
    parts = t.select(F.floor(F.col("h") / 20).alias("f"), "h", part.alias("part")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "f")
    # at most twenty hands per file by construction
    rows = parts.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("h", "part"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["part"]), "\n\n")
    return rows.select(F.concat(F.lit("F"), F.col("f")).alias("file_id"), F.concat(F.lit("preamble\n\n"), body).alias("text"))


@query(
    "segment_hands",
    f"""{TEXTS}, {FILES} SELECT 'F' || CAST(floor(h / 20) AS BIGINT) AS file_id, h::VARCHAR AS hand_id,
      CAST(CASE WHEN h % 3 = 0 THEN 2 ELSE 1 END AS INT) AS blocks, true AS valid FROM texts""",
)
def segment_hands(spark, sf_dir):
    hands = segments.split_hands(files(spark, sf_dir))
    return hands.select("file_id", ht.hand_id(F.col("text")).alias("hand_id"), F.size(segments.blocks(F.col("text"))).alias("blocks"), "valid")


@query(
    "segment_counts",
    f"""{TEXTS}, {FILES} SELECT 'F' || CAST(floor(h / 20) AS BIGINT) AS file_id, CAST(1 + count(*) + count(*) FILTER (WHERE h % 3 = 0) + count(*) FILTER (WHERE h % 5 = 4) AS INT) AS total_segments,
      CAST(count(*) FILTER (WHERE h % 5 = 4) AS INT) AS tournament_summary, count(*) AS hands, 0::BIGINT AS invalid_segments FROM texts GROUP BY 1""",
)
def segment_counts(spark, sf_dir):
    return segments.split_counts(files(spark, sf_dir))


@query(
    "block_split",
    r"""WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
    b AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(t, '\n\s*\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS block FROM d)
    SELECT doc_id, block FROM b""",
)
def block_split(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(segments.blocks(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("block"))


@query(
    "hand_spans",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS off, regexp_matches(line, '^(?i)e\w+ ') AS head FROM l),
    g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o),
    s AS (SELECT doc_id, span, min(off) AS a, max(off + length(line) + 1) AS b, string_agg(line, chr(10) ORDER BY i) AS body, bool_or(i = n) AS tail FROM g JOIN (SELECT doc_id, max(i) AS n FROM g GROUP BY doc_id) USING (doc_id) WHERE span > 0 GROUP BY doc_id, span)
    SELECT doc_id, CAST(a AS BIGINT) AS start_offset, CAST(CASE WHEN tail THEN b - 1 ELSE b END AS BIGINT) AS end_offset, regexp_replace(body, '^\s+|\s+$', '', 'g') AS text
    FROM s WHERE length(regexp_replace(body, '^\s+|\s+$', '', 'g')) > 50""",
)
def hand_spans(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    return segments.hand_spans(docs, "doc_id", "text", headers=[r"E\w+ "], min_chars=50)


@query(
    "text_tests",
    """WITH d AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Tournament #5 Seat 1: a' WHEN 1 THEN 'Seat 1: a' || chr(10) || 'Dealt to a' WHEN 2 THEN 'PokerStars' WHEN 3 THEN 'PokerStars Zoom  Hand #1'
        WHEN 4 THEN 'Prize: ' WHEN 5 THEN 'winamax poker - x' || chr(10) || 'Seat 2: b' ELSE '' END || chr(10) || text AS text FROM documents)
    SELECT doc_id, doc_id % 8 IN (0, 3, 5) AS starts, doc_id % 8 IN (2, 3, 4) AS summary, doc_id % 8 = 1 AS cash, doc_id % 8 IN (0, 1) AS essential FROM d""",
)
def text_tests(spark, sf_dir):
    k = F.col("doc_id") % 8
    head = (
        F.when(k == 0, "Tournament #5 Seat 1: a").when(k == 1, "Seat 1: a\nDealt to a").when(k == 2, "PokerStars").when(k == 3, "PokerStars Zoom  Hand #1")
        .when(k == 4, "Prize: ").when(k == 5, "winamax poker - x\nSeat 2: b").otherwise("")
    )
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.lit("\n"), F.col("text")).alias("text"))
    t = F.col("text")
    return docs.select(
        "doc_id", ht.starts_hand(t).alias("starts"), ht.is_summary(t, 3000).alias("summary"), ht.is_cash_game(t, 1500).alias("cash"),
        ht.has_essentials(t, 1500).alias("essential"),
    )


# --- classes of documents -----------------------------------------------------------------------

# words put in front of (or into the name of) documents; the same in both engines
TAGGED_SQL = """
SELECT doc_id, source, lang,
       CASE doc_id % 10 WHEN 0 THEN 'Mystery Bounty final. ' WHEN 1 THEN 'Weekly Progressive KO. ' WHEN 2 THEN 'the bounty of a mystery '
            WHEN 3 THEN 'Bounty Hunters $5. ' WHEN 4 THEN '$5.00 + $5.00 + $1 buy. ' ELSE '' END || text AS text,
       CASE doc_id % 9 WHEN 0 THEN 'mysteries-' WHEN 1 THEN 'pko ' ELSE 'day ' END || CAST(doc_id AS VARCHAR(12)) || '.txt' AS name
FROM documents
"""


def tagged(spark, sf_dir):
    tables.views(spark, sf_dir, "documents")
    return spark.sql(TAGGED_SQL)


@query(
    "classify_text",
    f"""WITH t AS ({TAGGED_SQL}) SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\bmystery\\b.*\\bbounty\\b|\\bbounty\\b.*\\bmystery\\b|\\bmysteries\\b') THEN 'MYSTERIES'
      WHEN regexp_matches(lower(text), '\\bbounty\\b|\\bprogressive\\b|\\bknockout\\b|\\bko\\b|\\bpko\\b') THEN 'PKO' ELSE 'NON-KO' END AS class FROM t""",
)
def classify_text(spark, sf_dir):
    return tagged(spark, sf_dir).select("doc_id", tourney.class_from_text(F.col("text"), 500, 5, 2000).alias("class"))


_M, _B = "(?i)\\b(mystery|mysteries)\\b", "(?i)\\b(bounty|bounties|progressive|pko|ko|knockout)\\b"


def _reason_sql(extra_mystery: str = "", extra_bounty: str = "") -> str:
    return f"""CASE WHEN text = '' THEN 'empty content' {extra_mystery}
      WHEN regexp_matches(name, '{_M}') THEN '''' || regexp_extract(name, '{_M}', 1) || ''' in filename' WHEN regexp_matches(text, '{_M}') THEN '''' || regexp_extract(text, '{_M}', 1) || ''' in content'
      {extra_bounty} WHEN regexp_matches(name, '{_B}') THEN '''' || regexp_extract(name, '{_B}', 1) || ''' in filename' WHEN regexp_matches(text, '{_B}') THEN '''' || regexp_extract(text, '{_B}', 1) || ''' in content'
      ELSE 'no special keywords found' END"""


@query(
    "classify_reason",
    f"""WITH t AS ({TAGGED_SQL}), r AS (SELECT doc_id, {_reason_sql()} AS reason FROM t)
    SELECT doc_id, reason, CASE WHEN reason = 'empty content' THEN 'unknown' WHEN contains(lower(reason), '''myster') THEN 'mystery' WHEN reason = 'no special keywords found' THEN 'non-KO' ELSE 'PKO' END AS class_name,
      CAST(CASE WHEN reason = 'empty content' THEN 0.0 ELSE 1.0 END AS DOUBLE) AS score FROM r""",
)
def classify_reason(spark, sf_dir):
    return tagged(spark, sf_dir).select("doc_id", F.inline(F.array(tourney.class_with_reason(F.col("text"), F.col("name"), chars=1000))))


@query(
    "file_manifest",
    f"""WITH t AS ({TAGGED_SQL}), r AS (SELECT name, strlen(text) AS bytes, {_reason_sql(
        "WHEN regexp_matches(left(text, 1000), '(?i)Mystery Bounty') THEN '''Mystery Bounty'' detected'",
        "WHEN regexp_matches(left(text, 1000), '[€$£][0-9]+(?:[.][0-9]+)?\\s*[+]\\s*[€$£][0-9]+(?:[.][0-9]+)?\\s*[+]') THEN 'buy-in with bounty part detected' WHEN regexp_matches(left(text, 1000), '(?i)Bounty Hunter') THEN '''Bounty Hunters'' detected'",
    )} AS reason FROM t)
    SELECT name AS input, reason, bytes::BIGINT AS bytes, 1.0::DOUBLE AS score, CASE WHEN contains(lower(reason), '''myster') THEN 'mystery' WHEN reason = 'no special keywords found' THEN 'non-KO' ELSE 'PKO' END AS output_class FROM r""",
)
def file_manifest(spark, sf_dir):
    return classify.manifest(tagged(spark, sf_dir), chars=1000).withColumn("bytes", F.col("bytes").cast("bigint"))


@query(
    "class_totals",
    f"""WITH t AS ({TAGGED_SQL}) SELECT CASE WHEN regexp_matches(lower(left(text, 1000)), 'mystery') AND contains(lower(left(text, 1000)), 'bounty') THEN 'MYSTERY'
      WHEN regexp_matches(lower(left(text, 1000)), 'bounty hunter|progressive knockout|progressive ko|pko| ko |knockout|bounty')
        OR regexp_matches(left(text, 1000), '[€$£][0-9]+(?:[.][0-9]+)?\\s*[+]\\s*[€$£][0-9]+(?:[.][0-9]+)?\\s*[+]') THEN 'PKO' ELSE 'NON_KO' END AS class, count(*) AS files FROM t GROUP BY 1""",
)
def class_totals(spark, sf_dir):
    rows = tagged(spark, sf_dir).select(tourney.class_from_header(F.col("text"), 1000).alias("class"))
    return classify.class_totals(rows, "class")


@query(
    "site_detection",
    """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'ggpoker' WHEN 1 THEN '888.pt' WHEN 2 THEN '888poker' WHEN 3 THEN 'pokerstars' WHEN 4 THEN 'wpn' WHEN 5 THEN 'winamax' WHEN 6 THEN 'ipoker' WHEN 7 THEN NULL END AS site,
      CASE doc_id % 9 WHEN 0 THEN 'unknown' WHEN 1 THEN '888.pt' WHEN 2 THEN '888poker' WHEN 3 THEN 'pokerstars' WHEN 4 THEN 'wpn' WHEN 5 THEN 'winamax' ELSE 'unknown' END AS network FROM documents""",
)
def site_detection(spark, sf_dir):
    k = F.col("doc_id") % 9
    head = (
        F.when(k == 0, "Poker Hand #TM12: ").when(k == 1, "***** 888.pt ").when(k == 2, "***** 888poker ").when(k == 3, "PokerStars Hand #1: Seat 1: Dealt to ")
        .when(k == 4, "Game Hand #1 *** HOLE CARDS *** ").when(k == 5, "Winamax Poker - ").when(k == 6, "GAME #1 TEXAS_HOLDEM ").when(k == 7, "You finished in ").otherwise("")
    )
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", F.concat(head, "text").alias("text"))
    return docs.select("doc_id", ht.source_site(F.col("text"), F.lit("a.txt"), 5000, 10000, 2000).alias("site"), ht.network(F.col("text"), 500).alias("network"))


# --- identity and duplicates ---------------------------------------------------------------------

PRINTED = r"""WITH p AS (SELECT doc_id, source, lang, sha1(lower(replace(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(13) || chr(10), chr(10)), chr(10) || chr(10), chr(10)))) AS hand_id FROM documents)"""


def printed(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", records.fingerprint(F.col("text")).alias("hand_id"))


@query("fingerprint_dedup", f"{PRINTED} SELECT hand_id, count(*) AS copies FROM p GROUP BY hand_id")
def fingerprint_dedup(spark, sf_dir):
    return printed(spark, sf_dir).groupBy("hand_id").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "first_record_dedup",
    f"{PRINTED} SELECT doc_id, source, lang, hand_id FROM (SELECT *, row_number() OVER (PARTITION BY hand_id ORDER BY source, doc_id) AS rn FROM p) WHERE rn = 1",
)
def first_record_dedup(spark, sf_dir):
    return records.first_records(printed(spark, sf_dir), "hand_id", ["source", "doc_id"])


@query(
    "content_hash_dups",
    "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def content_hash_dups(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").withColumn("digest", records.content_hash(F.col("text").cast("binary")))
    return records.repeated_content(docs, "digest", "doc_id")


@query(
    "duplicate_uploads",
    """WITH d AS (SELECT doc_id, source, sha256(text) AS digest FROM documents), seen AS (SELECT DISTINCT source, digest FROM d WHERE doc_id % 2 = 0)
    SELECT doc_id, EXISTS (SELECT 1 FROM seen s WHERE s.source = d.source AND s.digest = d.digest) AS repeated FROM d WHERE doc_id % 2 = 1""",
)
def duplicate_uploads(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "source", records.content_hash(F.col("text").cast("binary")).alias("digest"))
    old, new = docs.where(F.col("doc_id") % 2 == 0), docs.where(F.col("doc_id") % 2 == 1)
    again = records.already_seen(new, old, "source", "digest").select("doc_id", F.lit(True).alias("repeated"))
    fresh = records.not_seen(new, old, "source", "digest").select("doc_id", F.lit(False).alias("repeated"))
    return again.unionByName(fresh)


@query(
    "id_overlap",
    f"{PRINTED} SELECT hand_id, count(DISTINCT source) AS buckets FROM p GROUP BY hand_id HAVING count(DISTINCT source) > 1",
)
def id_overlap(spark, sf_dir):
    return records.ids_in_many(printed(spark, sf_dir), "hand_id", "source")


@query(
    "restrict_ids",
    f"{PRINTED} SELECT doc_id, source, lang, hand_id FROM p WHERE hand_id IN (SELECT hand_id FROM p WHERE doc_id IN (SELECT doc_id FROM labels))",
)
def restrict_ids(spark, sf_dir):
    docs = printed(spark, sf_dir)
    wanted = docs.join(tables.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return records.restrict(docs, wanted, "hand_id").select("doc_id", "source", "lang", "hand_id")


@query(
    "missing_ids",
    f"{PRINTED} SELECT doc_id, hand_id FROM p WHERE hand_id NOT IN (SELECT hand_id FROM p WHERE doc_id IN (SELECT doc_id FROM labels))",
)
def missing_ids(spark, sf_dir):
    docs = printed(spark, sf_dir)
    known = docs.join(tables.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return records.missing_from(docs, known, "hand_id").select("doc_id", "hand_id")


@query(
    "hand_keys",
    r"""SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE source END AS site, CASE WHEN doc_id % 4 = 0 THEN 'no_tournament' ELSE lang END AS tournament,
      CASE WHEN doc_id % 5 < 2 THEN sha1(regexp_replace(text, '^\s+|\s+$', '', 'g')) WHEN doc_id % 5 = 2 THEN 'stamp' ELSE doc_id::VARCHAR END AS hand FROM documents""",
)
def hand_keys(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    key = records.hand_key(
        F.when(d % 3 != 0, F.col("source")), F.when(d % 4 != 0, F.col("lang")), F.when(d % 5 > 2, d.cast("string")),
        F.when(d % 5 == 2, F.lit("stamp")), F.col("text"),
    )
    return docs.select(key.alias("k")).dropDuplicates(["k"]).select("k.*")


# --- numbers, names, cards, times ------------------------------------------------------------------

_SHAPES = """CASE CAST(l_linenumber AS INT) % 5 WHEN 0 THEN {us} WHEN 1 THEN translate({us}, ',.', '.,') WHEN 2 THEN {plain} WHEN 3 THEN '€ ' || {us} ELSE replace({whole}, ',', '.') END"""


@query(
    "normalise_number",
    """SELECT l_returnflag, CAST(l_linenumber AS INT) % 5 AS shape, round(sum(CASE WHEN CAST(l_linenumber AS INT) % 5 = 4 THEN round(l_extendedprice) ELSE l_extendedprice END), 2) AS total, count(*) AS cells
    FROM lineitem GROUP BY 1, 2""",
)
def normalise_number(spark, sf_dir):
    price = F.col("l_extendedprice")
    us = F.format_number(price, 2)
    k = F.col("l_linenumber") % 5
    whole = F.format_number(F.round(price), 0)
    cell = (
        F.when(k == 0, us).when(k == 1, F.translate(us, ",.", ".,")).when(k == 2, F.format_string("%.2f", price))
        .when(k == 3, F.concat(F.lit("€ "), us)).otherwise(F.replace(whole, F.lit(","), F.lit(".")))
    )
    rows = tables.table(spark, sf_dir, "lineitem").select("l_returnflag", k.alias("shape"), numbers.amount(cell).alias("v"))
    return rows.groupBy("l_returnflag", "shape").agg(F.round(F.sum("v"), 2).alias("total"), F.count(F.lit(1)).alias("cells"))


@query(
    "normalise_number_simple",
    """SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, count(*) AS cells FROM lineitem GROUP BY 1""",
)
def normalise_number_simple(spark, sf_dir):
    price = F.col("l_extendedprice")
    k = F.col("l_linenumber") % 3
    plain = F.format_string("%.2f", price)
    cell = (
        F.when(k == 0, F.concat(F.lit("("), F.format_number(price, 2), F.lit(")"))).when(k == 1, F.replace(plain, F.lit("."), F.lit(",")))
        .otherwise(F.concat(F.lit("$"), plain))
    )
    rows = tables.table(spark, sf_dir, "lineitem").select("l_returnflag", numbers.amount_simple(cell).alias("v"))
    return rows.groupBy("l_returnflag").agg(F.round(F.sum("v"), 2).alias("total"), F.count(F.lit(1)).alias("cells"))


@query("clean_names", "SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' x' ELSE '' END AS name FROM customer")
def clean_names(spark, sf_dir):
    k = F.col("c_custkey") % 3
    tail = F.when(k == 0, "   x ").when(k == 1, " [ME]  (button)").otherwise("(1) ")
    return tables.table(spark, sf_dir, "customer").select("c_custkey", ht.clean_name(F.concat(F.lit("  "), "c_name", tail)).alias("name"))


@query(
    "card_lists",
    """SELECT p_partkey, [substr('AKQJT98765432', CAST(p_partkey % 13 AS INT) + 1, 1) || substr('schd', CAST(p_partkey % 4 AS INT) + 1, 1), substr('AKQJT98765432', CAST(p_size % 13 AS INT) + 1, 1) || 'h'] AS cards FROM part""",
)
def card_lists(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    text = F.expr(
        "concat('[', lower(substr('AKQJT98765432', CAST(p_partkey % 13 AS INT) + 1, 1)), substr('♠♣♥♦', CAST(p_partkey % 4 AS INT) + 1, 1), ' ',"
        " substr('AKQJT98765432', CAST(p_size % 13 AS INT) + 1, 1), 'H]')"
    )
    return part.select("p_partkey", ht.cards(text).alias("cards"))


@query(
    "month_lisbon",
    "SELECT event_id, strftime(timezone('Europe/Lisbon', timezone('UTC', date_trunc('second', ts) + to_months(CAST(event_id % 12 AS INT)))), '%Y-%m') AS month FROM events",
)
def month_lisbon(spark, sf_dir):
    stamp = F.date_format(F.expr("ts + make_ym_interval(0, CAST(event_id % 12 AS INT))"), "yyyy/MM/dd HH:mm:ss")
    return tables.table(spark, sf_dir, "events").select("event_id", timecols.month_bucket(stamp).alias("month"))


@query(
    "lenient_stamps",
    """SELECT o_orderkey, CASE CAST(o_orderkey % 7 AS INT) WHEN 6 THEN NULL WHEN 5 THEN strftime(o_orderdate, '%Y-%m-01 00:00') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS parsed,
      CASE CAST(o_orderkey % 7 AS INT) WHEN 6 THEN '2001-02' WHEN 5 THEN strftime(timezone('Europe/Lisbon', timezone('UTC', date_trunc('month', o_orderdate))), '%Y-%m')
        ELSE strftime(timezone('Europe/Lisbon', timezone('UTC', o_orderdate)), '%Y-%m') END AS month FROM orders""",
)
def lenient_stamps(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    text = (
        F.when(k == 0, F.date_format(d, "yyyy/MM/dd HH:mm:ss")).when(k == 1, F.concat(F.lit("played "), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(k == 2, F.date_format(d, "yyyy-MM-dd")).when(k == 3, F.date_format(d, "d MMMM yyyy")).when(k == 4, F.date_format(d, "MMMM d, yyyy"))
        .when(k == 5, F.date_format(d, "yyyy-MM")).otherwise("no date")
    )
    return tables.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(timecols.parse_stamp(text), "yyyy-MM-dd HH:mm").alias("parsed"),
        timecols.month_bucket(text, F.lit("2001-02")).alias("month"),
    )


@query(
    "valid_months",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderkey % 5 > 1 GROUP BY 1",
)
def valid_months(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    month = F.when(k == 0, "1970-01").when(k == 1, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    rows = tables.table(spark, sf_dir, "orders").withColumn("month", month)
    return rows.where(timecols.valid_month(F.col("month"))).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query(
    "header_stamps",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
      CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS printed FROM orders""",
)
def header_stamps(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    line = (
        F.when(k == 0, F.concat(F.lit("Hand #1: x - "), F.date_format(d, "yyyy/MM/dd HH:mm:ss")))
        .when(k == 1, F.concat(F.lit("Hand #1: x - "), F.date_format(d, "yyyy/MM/dd HH:mm:ss"), F.lit(" WET [2001/01/01 00:00:00 ET]")))
        .when(k == 2, F.concat(F.lit("x *** "), F.date_format(d, "dd MM yyyy HH:mm:ss"))).otherwise("no stamp")
    )
    site = F.when(k < 2, "pokerstars").otherwise("888pt")
    return tables.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(timecols.header_stamp(line), "yyyy-MM-dd").alias("day"),
        timecols.month_in_header(line, site, 1500).alias("printed"),
    )


@query(
    "localized_months",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders",
)
def localized_months(spark, sf_dir):
    names = F.create_map(*[x for n, i in timecols.MONTH_NAMES.items() if n != "marco" for x in (F.lit(i), F.lit(n))])
    line = F.concat(
        F.lit("***** 888.pt - "), F.dayofmonth("o_orderdate"), F.lit(" "), F.initcap(F.try_element_at(names, F.month("o_orderdate"))),
        F.lit(" "), F.year("o_orderdate"), F.lit(" 21:15 WET\n\nrest"),
    )
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", timecols.month_in_header(line, F.lit("888.pt"), 1500).alias("month"))


@query(
    "month_resolve",
    """SELECT doc_id, CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN '2023-05' WHEN 1 THEN '2022-07' WHEN 2 THEN '2021-04' WHEN 3 THEN '2020-11' WHEN 4 THEN '2019-02' ELSE '1970-01' END AS month FROM documents""",
)
def month_resolve(spark, sf_dir):
    k = F.col("doc_id") % 6
    body = F.regexp_replace("text", r"\d", "")
    content = F.when(k == 2, F.concat(F.lit("at 2021/03/31 23:30 ok. "), body)).when(k == 3, F.concat(F.lit("month 2020_11. "), body)).otherwise(body)
    path = F.when(k == 4, F.concat(F.lit("/in/2018-01/x/2019_02/f"), F.col("doc_id"), F.lit(".txt"))).otherwise("/in/none/f.txt")
    # the running number of the file must not look like a month
    path = F.when(k == 4, F.lit("/in/2018-01/x/2019_02/file.txt")).otherwise(path)
    meta = F.when(k == 0, "2023-05")
    stamp = F.when(k == 1, "2022-06-30 23:30:00")
    docs = tables.table(spark, sf_dir, "documents")
    return docs.select("doc_id", timecols.month_for_file(content, path, meta, stamp, 5000).alias("month"))


@query(
    "best_stamps",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') END AS stamp FROM orders""",
)
def best_stamps(spark, sf_dir):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    fields = [F.when(k == 0, F.date_format(d, "yyyy-MM-dd")), F.when(k == 0, "junk").when(k == 1, F.date_format(d, "yyyy/MM/dd HH:mm:ss"))]
    text = F.when(k == 2, F.concat(F.lit("dealt "), F.date_format(d, "yyyy-MM-dd HH:mm"), F.lit(" end"))).otherwise("none")
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", timecols.best_stamp(fields, text).alias("stamp"))


@query(
    "month_carry_forward",
    """WITH e AS (SELECT CASE WHEN event_id % 10 <> 0 THEN event_id END AS pos, event_id, CASE WHEN user_id % 8 < 7 THEN user_id % 7 END AS file_id,
        CASE WHEN event_type = 'click' THEN '2024-' || lpad((event_id % 12 + 1)::VARCHAR, 2, '0') END AS month FROM events)
      SELECT event_id, file_id, CASE WHEN file_id IS NULL OR pos IS NULL THEN month
        ELSE last_value(month IGNORE NULLS) OVER (PARTITION BY file_id, pos IS NULL ORDER BY pos) END AS month FROM e""",
)
def month_carry_forward(spark, sf_dir):
    seen = F.concat(F.lit("2024-"), F.lpad((F.col("event_id") % 12 + 1).cast("string"), 2, "0"))
    rows = tables.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 10 != 0, F.col("event_id")).alias("pos"),
        F.when(F.col("user_id") % 8 < 7, F.col("user_id") % 7).alias("file_id"),
        F.when(F.col("event_type") == "click", seen).alias("month"),
    )
    return months.carry_month_forward(rows, "file_id", "pos", chunk=500).drop("pos")
