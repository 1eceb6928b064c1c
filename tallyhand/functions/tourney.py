"""Group labels and tournament classes as Columns."""

from pyspark.sql import Column, functions as F

from tallyhand.functions import handtext
from tallyhand.functions.columns import any_of, let, yes

# Group labels.
NONKO_9MAX, NONKO_6MAX = "nonko_9max_pref", "nonko_6max_pref"
PKO, MYSTERY, POSTFLOP_ALL = "pko_pref", "mystery_pref", "postflop_all"


def class_from_file(explicit: Column, path: Column) -> Column:
    """pko / mystery / non-ko: the field if valid, else the folder, else a keyword."""
    given = F.lower(F.coalesce(explicit, F.lit("")))
    p = F.lower(F.coalesce(path, F.lit("")))
    return (
        F.when(given.isin("pko", "mystery", "non-ko"), given)
        .when(p.contains("/pko/") | p.contains("\\pko\\"), "pko")
        .when(p.contains("/myst") | p.contains("\\myst"), "mystery")
        .when(p.contains("/non-ko/") | p.contains("\\non-ko\\"), "non-ko")
        .when(p.contains("bounty") | p.contains("knockout") | p.contains(" ko "), "pko")
        .otherwise("non-ko")
    )


def group_labels(tourney_class: Column, table_size: Column, any_postflop: Column) -> Column:
    """0-2 labels per hand: the class at its table size, and one for any post-flop action."""
    return F.array_compact(
        F.array(
            F.when((tourney_class == "non-ko") & table_size.between(7, 10), NONKO_9MAX),
            F.when((tourney_class == "non-ko") & table_size.between(3, 6), NONKO_6MAX),
            F.when(tourney_class == "pko", PKO),
            F.when(tourney_class == "mystery", MYSTERY),
            F.when(any_postflop, POSTFLOP_ALL),
        )
    )


def group_key(field: str, columns: list[str]) -> Column:
    """One key per hand for splitting by a field; bands for stakes, sizes, positions."""
    c = F.col
    if field == "hero":
        return F.coalesce(F.nullif(c("hero"), F.lit("")), F.lit("no_hero"))
    if field == "site":
        return F.coalesce(F.nullif(c("site"), F.lit("")), F.lit("unknown_site"))
    if field == "tournament_id":
        return F.coalesce(F.nullif(c("tournament_id").cast("string"), F.lit("")), F.lit("cash_game"))
    if field == "pot_type":
        return F.coalesce(c("pot_type"), F.lit("none"))
    if field == "stake_level":
        bb = F.coalesce(F.try_element_at(c("blinds"), F.lit("bb")), F.lit(0.0))
        return (
            F.when(bb <= 0, "unknown").when(bb <= 0.10, "micro").when(bb <= 1.00, "low").when(bb <= 5.00, "mid")
            .otherwise("high")
        )
    if field == "table_size":
        size = c("table_max")
        return (
            F.when(F.coalesce(size, F.lit(0)) == 0, "unknown")
            .when(size == 2, "headsup")
            .otherwise(F.concat(size.cast("string"), F.lit("max")))
        )
    if field == "position":
        pos = F.nullif(c("hero_position"), F.lit(""))
        return (
            F.when(pos.isNull(), "no_position")
            .when(pos.isin("EP", "EP2", "EP3", "UTG"), "early")
            .when(pos.isin("MP", "MP1", "MP2"), "middle")
            .when(pos.isin("CO", "BTN"), "late")
            .when(pos.isin("SB", "BB"), "blinds")
            .otherwise(F.lower(pos))
        )
    if field not in columns:
        return F.lit("null")
    return F.coalesce(c(field).cast("string"), F.lit("null"))


# Word lists and shapes that mark bounty tournaments.
MYSTERY_SHAPES = [r"\bmystery\b.*\bbounty\b", r"\bbounty\b.*\bmystery\b", r"\bmysteries\b"]
BOUNTY_SHAPES = [r"\bbounty\b", r"\bprogressive\b", r"\bknockout\b", r"\bko\b", r"\bpko\b"]
THREE_PART_BUYIN = r"\$[\d.]+\+\$[\d.]+\+\$[\d.]+"
SEAT_BOUNTY = r"\(\d+\s+in\s+chips,\s+\$[\d.]+\s+bounty\)"


def class_from_text(text: Column, chars: int | None = None, lines: int | None = None, seat_chars: int | None = None) -> Column:
    """MYSTERIES / PKO / NON-KO from a hand's whole text.

    One site prints the buy-in in three parts for bounty events; there the seat
    lines tell a fixed bounty from a mystery one. That site and its buy-in are looked for
    before the first street, or in ``chars`` characters, ``lines`` lines and ``seat_chars`` characters.
    """
    named = let(
        F.lower(text),
        lambda low: F.when(any_of(*[low.rlike(p) for p in MYSTERY_SHAPES]), "MYSTERIES")
        .when(any_of(*[low.rlike(p) for p in BOUNTY_SHAPES]), "PKO")
        .otherwise("NON-KO"),
    )
    ours = handtext.head(text, chars).contains("PokerStars Hand #")
    head = F.split(handtext.top(text), "\n") if lines is None else F.slice(F.split(text, "\n", lines + 1), 1, lines)
    header = let(head, lambda lines: F.coalesce(F.get(F.filter(lines, lambda line: line.contains("PokerStars")), F.lit(0)), F.get(lines, F.lit(0))))
    three = ours & yes(header.rlike(THREE_PART_BUYIN))
    seat_bounty = handtext.head(text, seat_chars).rlike(SEAT_BOUNTY)
    return let(three, lambda bounties: F.when(bounties & seat_bounty, "PKO").when(bounties, "MYSTERIES").otherwise(named))


# Whole words looked for in file names and contents.
MYSTERY_WORD = r"(?i)\b(mystery|mysteries)\b"
BOUNTY_WORD = r"(?i)\b(bounty|bounties|progressive|pko|ko|knockout)\b"
BUYIN_PLUS_BOUNTY = r"[€$£]\d+(?:\.\d+)?\s*\+\s*[€$£]\d+(?:\.\d+)?\s*\+"


def class_with_reason(text: Column, name: Column, network_rules: bool = False, chars: int | None = None) -> Column:
    """struct(class_name, reason, score) from a file's text and name.

    ``network_rules`` adds the header shapes two networks use (before the first street, or in
    the first ``chars`` characters); without them only the words count.
    """
    text, name = F.coalesce(text, F.lit("")), F.coalesce(name, F.lit(""))
    head = handtext.head(text, chars)

    def word(source: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(source, pattern, 1), F.lit(""))

    def result(cls: str, reason: Column, score: float = 1.0) -> Column:
        return F.struct(
            F.lit(cls).alias("class_name"), reason.alias("reason"), F.lit(score).alias("score")
        )

    def quoted(w: Column, where: str) -> Column:
        return F.concat(F.lit("'"), w, F.lit(f"' in {where}"))

    junk = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    rules = [
        (text == "", result("unknown", F.lit("empty content"), 0.0)),
        (junk > F.length(text) * 0.3, result("unknown", F.lit("invalid or binary content"), 0.5)),
    ]
    if network_rules:
        rules.append((head.rlike("(?i)Mystery Bounty"), result("mystery", F.lit("'Mystery Bounty' detected"))))
    rules += [
        (word(name, MYSTERY_WORD).isNotNull(), result("mystery", quoted(word(name, MYSTERY_WORD), "filename"))),
        (word(text, MYSTERY_WORD).isNotNull(), result("mystery", quoted(word(text, MYSTERY_WORD), "content"))),
    ]
    if network_rules:
        rules += [
            (head.rlike(BUYIN_PLUS_BOUNTY), result("PKO", F.lit("buy-in with bounty part detected"))),
            (head.rlike("(?i)Bounty Hunter"), result("PKO", F.lit("'Bounty Hunters' detected"))),
        ]
    rules += [
        (word(name, BOUNTY_WORD).isNotNull(), result("PKO", quoted(word(name, BOUNTY_WORD), "filename"))),
        (word(text, BOUNTY_WORD).isNotNull(), result("PKO", quoted(word(text, BOUNTY_WORD), "content"))),
    ]
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(result("non-KO", F.lit("no special keywords found")))


# Header words of bounty events.
HEADER_WORDS = [
    "bounty hunter", "progressive knockout", "progressive ko", "pko", " ko ", "knockout", "bounty builders",
]
BUYIN_TWO_PART = r"buy-in:\s*[$€£]\d+(?:\.\d+)?\s*\+\s*[$€£]\d+(?:\.\d+)?"


def class_from_header(text: Column, chars: int | None = None) -> Column:
    """PKO / MYSTERY / NON_KO from the text before the first street, or its first ``chars`` characters."""
    head = handtext.head(text, chars)
    low = F.lower(head)
    return (
        F.when(low.contains("mystery") & low.contains("bounty"), "MYSTERY")
        .when(
            any_of(*[low.contains(w) for w in HEADER_WORDS])
            | head.rlike(BUYIN_PLUS_BOUNTY)
            | head.rlike(BUYIN_TWO_PART)
            | low.contains("bounty"),
            "PKO",
        )
        .otherwise("NON_KO")
    )
