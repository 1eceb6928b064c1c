"""Cutting files into hands.

A file arrives as one row. The cuts are regex splits inside that row followed by an
explode, so there is no shuffle and no order to restore: a piece that opens with a
header already carries its continuation blocks.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhand.functions import handtext as ht
from tallyhand.functions.columns import count_true, let

_BLANK = r"\n\s*\n\s*"
_HEADER = "(?i:" + "|".join(ht.HEADERS) + ")"


def _clean(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blocks(text: Column) -> Column:
    """Non-empty blocks between blank lines, trimmed."""
    parts = F.transform(F.split(text, r"\n\s*\n+"), _clean)
    return F.filter(parts, lambda b: b != "")


def _between_summaries(parts: Column) -> Column:
    """Runs of blocks between summary blocks, as an array of arrays."""

    def cut(marks: Column) -> Column:
        starts = F.concat(F.array(F.lit(1)), F.transform(marks, lambda at: at + 1))
        ends = F.concat(F.transform(marks, lambda at: at - 1), F.array(F.size(parts)))
        return F.zip_with(starts, ends, lambda a, b: F.slice(parts, a, b - a + 1))

    numbered = F.transform(parts, lambda b, i: F.when(ht.is_summary(b), i + 1))
    return let(F.array_compact(numbered), cut)


def hands_of(text: Column) -> Column:
    """``array<struct<hand_index, text, valid>>``: the hands of a file's text in order."""

    def hand(body: Column, piece: Column, run: Column) -> Column:
        opens = F.array_position(F.transform(body, lambda b: ht.starts_hand(b) | ht.has_essentials(b)), F.lit(True))
        joined = let(opens.cast("int"), lambda at: F.when(at > 0, F.array_join(F.slice(body, at, F.size(body)), "\n\n")))
        return let(
            joined,
            lambda t: F.struct(
                (piece.cast("bigint") * 1_000_000 + run).alias("hand_index"),
                t.alias("text"),
                (~ht.is_summary(t) & ht.has_essentials(t)).alias("valid"),
            ),
        )

    def runs(piece: Column, i: Column) -> Column:
        bodies = let(blocks(piece), _between_summaries)
        return F.transform(bodies, lambda body, j: hand(body, i, j))

    pieces = F.split(_clean(text), f"{_BLANK}(?={_HEADER})")
    return F.filter(F.flatten(F.transform(pieces, runs)), lambda h: h["text"].isNotNull())


def split_hands(files: DataFrame, file_id: str = "file_id", text: str = "text") -> DataFrame:
    """(file_id, hand_index, text, valid): hands of a file in order.

    Blocks that do not open a hand continue the current one; a summary block ends it;
    text before any header starts a hand only if it has seats and cards.
    """
    return files.select(file_id, F.inline(hands_of(F.col(text))))


def split_pieces(pieces: DataFrame) -> DataFrame:
    """(path, block, piece, run, encoding, text, valid): the hands of files that were read by range (``splits.hand_pieces``).

    The rows are those of ``split_hands`` over whole files, whatever the size of a range.
    (block, piece, run) is the order of a file's hands.
    """
    hands = pieces.select("path", "block", "piece", "encoding", F.inline(hands_of(F.col("text"))))
    return hands.select("path", "block", "piece", F.col("hand_index").alias("run"), "encoding", "text", "valid")


def split_counts(files: DataFrame, file_id: str = "file_id", text: str = "text") -> DataFrame:
    """Per file: blocks seen, summary blocks, hands kept and hands dropped as invalid."""
    seen = files.select(
        file_id,
        F.transform(blocks(F.col(text)), lambda b: ht.is_summary(b)).alias("_summary"),
        F.transform(hands_of(F.col(text)), lambda h: h["valid"]).alias("_valid"),
    )
    return seen.select(
        file_id,
        F.size("_summary").alias("total_segments"),
        F.size(F.filter("_summary", lambda s: s)).alias("tournament_summary"),
        F.size(F.filter("_valid", lambda v: v)).cast("bigint").alias("hands"),
        F.size(F.filter("_valid", lambda v: ~v)).cast("bigint").alias("invalid_segments"),
    )


# Line starts that open a hand when offsets are wanted.
LINE_HEADERS = [
    r"PokerStars\s+(?:Hand|Game|Zoom\s+Hand)\s*#\d+", r"Poker\s+Hand\s*#\w+", r"Game\s+Hand\s*#\d+",
    r"Winamax\s+Poker\s*-", r"888(?:poker|\.pt)\s+Hand\s*#\d+", r"#Game\s+No\s*:\s*\d+", r"Hand\s*#\d+",
    r"Tournament\s*#\d+.*Hand\s*#\d+", r"\*\*\*\s*HOLE\s+CARDS\s*\*\*\*",
]
ANY_MARKER = r"\*\*\*.*\*\*\*"


def hand_spans(
    files: DataFrame, file_id: str = "file_id", text: str = "text", headers: list[str] | None = None, min_chars: int = 0
) -> DataFrame:
    """(file_id, start_offset, end_offset, text): from one header line to the next.

    Files without a header line fall back to any ``***`` line. Spans of ``min_chars``
    or fewer characters are dropped. Offsets are running lengths over one file's
    pieces, and one file is one input row, so the window is bounded by a row.
    """
    head = "(?:" + "|".join(headers or LINE_HEADERS) + ")"
    cut = F.when(
        F.col(text).rlike(f"(?im)^{head}"), F.split(text, f"(?im)(?=^{head})")
    ).otherwise(F.split(text, f"(?m)(?=^{ANY_MARKER})"))
    w = Window.partitionBy(file_id).orderBy("_pos")
    pieces = files.select(file_id, F.posexplode(cut).alias("_pos", "_piece"))
    ends = pieces.withColumn("end_offset", F.sum(F.length("_piece")).over(w))
    body = _clean(F.col("_piece"))
    return (
        ends.where(F.col("_piece").rlike(f"(?is)^(?:{head}|{ANY_MARKER})") & (F.length(body) > min_chars))
        .select(
            file_id,
            (F.col("end_offset") - F.length("_piece")).alias("start_offset"),
            "end_offset",
            body.alias("text"),
        )
    )


def dominant_format(formats: DataFrame, file_id: str = "file_id") -> DataFrame:
    """Majority table format per file; ties and files without either are 9-max."""
    return formats.groupBy(file_id).agg(
        count_true(F.col("table_format") == "6-max").alias("six_max"),
        count_true(F.col("table_format") == "9-max").alias("nine_max"),
    ).withColumn("format", F.when(F.col("six_max") > F.col("nine_max"), "6-max").otherwise("9-max"))


def parse_errors(hands: DataFrame) -> DataFrame:
    """Add ``errors``: what a hand lacks to be usable."""
    return hands.withColumn(
        "errors",
        F.array_compact(
            F.array(
                F.when(F.coalesce("button_seat", F.lit(0)) == 0, "missing_button"),
                F.when(F.coalesce(F.size("streets.preflop.actions"), F.lit(0)) <= 0, "missing_preflop_actions"),
            )
        ),
    )


def parse_summary(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: hands, all-in and heads-up shares, multiway share, players dealt in."""
    n = F.count(F.lit(1))
    share = lambda cond: F.round(count_true(cond) / n * 100, 2)
    return facts.groupBy(*keys).agg(
        n.alias("hands"),
        share(F.col("any_allin_preflop")).alias("allin_pct"),
        share(F.col("players_to_flop") == 2).alias("heads_up_pct"),
        share(F.col("players_to_flop") > 2).alias("multiway_pct"),
        F.round(F.avg(F.size("players_dealt_in")), 2).alias("avg_dealt_in"),
    )
