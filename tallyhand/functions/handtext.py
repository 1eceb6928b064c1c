"""Reading one hand's text: tests, header fields, seats and action lines.

All of it is built-in string and array functions over the whole text of a hand.
"""

from pyspark.sql import Column, functions as F

from tallyhand.functions.columns import any_of, first_match, let, yes
from tallyhand.functions.numbers import amount, amount_us

# First lines that open a hand.
HEADERS = [
    r"PokerStars\s+(?:Hand|Game|Zoom\s+Hand|Home\s+Game\s+Hand)\s+#",
    r"Poker\s+Hand\s+#",
    r"Game\s+Hand\s+#",
    r"Winamax\s+Poker\s+-",
    r"888poker\s+Hand\s+#",
    r"\*\*\*\*\*\s+888poker",
    r"#Game\s+No\s*:",
    r"Tournament\s+#\d+",
    r"Hand\s+#\d+",
]
# Phrases of a tournament summary.
SUMMARY_PHRASES = [
    "tournament summary", "finishing players:", "dear player", "you finished in", "total prize pool",
    "tournament results", "1st:", "2nd:", "3rd:", "place:", "prize:",
]
TOURNAMENT = r"Tournament\s+(?:#\d+|\"[^\"]+\")"
SEAT = r"Seat\s+\d+:"


def starts_hand(block: Column) -> Column:
    """Does the block's first line open a hand?"""
    return block.rlike("(?i)^(?:" + "|".join(HEADERS) + ")")


# Markers that end the top section of a hand's text.
STREET_MARKS = [
    "*** HOLE CARDS ***", "** Dealing down cards **", "*** FLOP ***", "** Dealing Flop **", "** Dealing flop **", "*** TURN ***", "*** RIVER ***",
    "*** SHOW DOWN ***", "*** SHOWDOWN ***", "*** SUMMARY ***", "** Summary **",
]


def top(text: Column) -> Column:
    """The text before its first street marker; all of it where there is none."""
    for mark in STREET_MARKS:
        text = F.substring_index(text, mark, 1)
    return text


def head(text: Column, chars: int | None) -> Column:
    """The top section of a text, or its first ``chars`` characters."""
    return top(text) if chars is None else F.substring(text, 1, chars)


def _dealt(text: Column) -> Column:
    return text.contains("*** HOLE CARDS ***") | text.contains("Dealt to")


def is_summary(text: Column, chars: int | None = None) -> Column:
    """A tournament summary: a phrase before the first street (or in the first ``chars`` characters), or a site name without seats and cards."""
    bare = ~_dealt(text) & ~text.rlike(SEAT)
    return let(
        F.lower(head(text, chars)),
        lambda said: any_of(*[said.contains(p) for p in SUMMARY_PHRASES]) | (said.contains("pokerstars") & bare),
    )


def is_summary_file(text: Column, name: Column, chars: int | None = None) -> Column:
    """The stricter variant used per file (one more phrase, ``.ots`` names)."""
    said = F.lower(head(text, chars))
    phrase = any_of(*[said.contains(p) for p in [*SUMMARY_PHRASES, "tournament placement"]])
    bare = said.contains("pokerstars") & ~_dealt(text) & ~head(text, chars).rlike(SEAT)
    return F.lower(name).endswith(".ots") | phrase | bare


def is_cash_game(text: Column, chars: int | None = None) -> Column:
    """No tournament named before the first street (or in the first ``chars`` characters), but seats there and cards dealt."""
    return let(head(text, chars), lambda said: ~said.rlike(TOURNAMENT) & said.rlike(SEAT) & _dealt(text))


def has_essentials(text: Column, chars: int | None = None) -> Column:
    """Seats, and cards dealt or a tournament named before the first street (or in the first ``chars`` characters)."""
    return text.rlike(SEAT) & (_dealt(text) | head(text, chars).rlike(TOURNAMENT))


def source_site(
    text: Column, name: Column, chars: int | None = None, deep_chars: int | None = None, summary_chars: int | None = None
) -> Column:
    """Site by ordered rules over a whole file's text, or its first ``chars`` (one site: ``deep_chars``) characters; NULL when unknown."""
    top, deep = (text if n is None else F.substring(text, 1, n) for n in (chars, deep_chars))
    return (
        F.when(is_summary_file(text, name, summary_chars), F.lit(None).cast("string"))
        .when(top.contains("GGPoker Hand #") | (top.contains("Poker Hand #") & top.contains("PokerTime.eu")), "ggpoker")
        .when(top.rlike(r"Poker Hand #(?:TM|HH)"), "ggpoker")
        .when(top.rlike(r"888\.pt\s+Hand History|\*{5}\s+888\.pt"), "888.pt")
        .when(top.rlike(r"888poker\s+Hand History|\*{5}\s+888poker"), "888poker")
        .when(deep.rlike(r"PokerStars (?:Hand|Home Game Hand|Game|Zoom Hand) #|PokerStars\s+(?:Hand|Game|Zoom\s+Hand)\s+#\d+:"), "pokerstars")
        .when(top.contains("Game Hand #") & top.contains("*** HOLE CARDS ***"), "wpn")
        .when(top.contains("Winamax Poker"), "winamax")
        .when(top.contains("***** Hand History For Game") & top.contains("Tourney Texas Holdem"), "partypoker")
        .when(top.contains("GAME #") & top.contains("TEXAS_HOLDEM"), "ipoker")
        .when(top.rlike(r"Hand\s+#\w+\s+\|\s+Hold'em"), "ggpoker")
    )


def network(text: Column, chars: int | None = None) -> Column:
    """Network named before the first street, or in the first ``chars`` characters."""
    top = F.lower(head(text, chars))
    return (
        F.when(top.contains("pokerstars hand #") | top.contains("pokerstars tournament #"), "pokerstars")
        .when(top.rlike(r"poker hand #tm\d+") & (top.contains("holdem") | top.contains("omaha")), "ggpoker")
        .when(top.contains("888.pt"), "888.pt")
        .when(top.contains("888poker") | top.contains("888 poker"), "888poker")
        .when(top.contains("partypoker") | top.contains("party poker"), "partypoker")
        .when(top.contains("winamax poker"), "winamax")
        .when(top.contains("game hand #") | top.contains("winning poker network"), "wpn")
        .otherwise("unknown")
    )


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _is_888(text: Column, chars: int | None = None) -> Column:
    return let(head(text, chars), lambda said: said.contains("888poker") | said.contains("#Game No"))


def active_players(text: Column, chars: int | None = None) -> Column:
    """Players with chips in the seat list; one site counts the actors around the deal instead.

    Sites are told by the text before the first street, or by its first ``chars`` characters.
    """
    lines = F.transform(_lines(text), lambda line: F.trim(line))
    wpn = head(text, chars).contains("Game Hand #")
    stars = text.startswith("PokerStars")
    chips = r"Seat\s+\d+:.*?\(\d+.*?in\s+chips.*?\)"
    bare = r"Seat\s+\d+:.*?\(\d+(?:,.*?)?\)(?!\s*\()"
    before_summary = F.transform(
        _lines(F.substring_index(text, "*** SUMMARY ***", 1)), lambda line: F.trim(line)
    )
    wpn_count = F.size(F.filter(before_summary, lambda x: x.rlike(r"^Seat\s+\d+:\s*[^(]+\s*\([0-9.,]+\)$")))

    def seated(x: Column) -> Column:
        low = F.lower(x)
        return F.when(x.rlike(chips), ~stars | ~low.contains("out of hand")).otherwise(
            x.rlike(r"^Seat\s+\d+:") & x.rlike(bare) & ~low.contains("won") & ~low.contains("collected")
        )

    # actors: from ten lines before the deal up to the flop or the summary
    raw = _lines(text)
    deal_at = F.array_position(F.transform(raw, lambda x: x.rlike(r"\*\* Dealing down cards \*\*|\*\*\* HOLE CARDS \*\*\*")), F.lit(True))
    end_at = F.array_position(
        F.transform(raw, lambda x: x.rlike(r"\*\* Dealing flop \*\*|\*\*\* FLOP \*\*\*|\*\* Summary \*\*|\*\*\* SUMMARY \*\*\*")), F.lit(True)
    )
    last = F.when(end_at > 0, end_at - 1).otherwise(F.size(raw))
    first = F.greatest(F.lit(1), deal_at - 10)
    window = F.slice(raw, first.cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))
    who = r"(?i)^(.+?)\s+(?:posts\s+(?:small\s+blind|big\s+blind|ante)\s+\[|folds|checks|calls|bets|raises|All-?in)"
    actors = F.filter(F.transform(window, lambda x: F.trim(F.regexp_extract(x, who, 1))), lambda n: n != "")
    by_action = F.when(deal_at > 0, F.size(F.array_distinct(actors))).otherwise(F.lit(0))
    return F.when(_is_888(text, chars), by_action).when(wpn, wpn_count).otherwise(
        F.size(F.filter(lines, lambda x: x.contains("Seat") & seated(x)))
    )


def table_format(text: Column) -> Column:
    """``6-max`` for 4-6 active players, ``9-max`` for 7 and more, else ``discard``."""
    absent = _is_888(text) & ~text.contains("Dealt to")
    return let(active_players(text), lambda n: F.when(absent | (n < 4), "discard").when(n <= 6, "6-max").otherwise("9-max"))


# Identifier shapes, in order of preference.
TOURNAMENT_IDS = [
    r"(?i)Tournament\s+#([A-Za-z0-9\-]+)", r"(?i)Tournament\s+ID:\s*([A-Za-z0-9\-]+)", r"(?i)Tourney\s+#([A-Za-z0-9\-]+)",
    r'Tournament\s+"([^"]+)"',
]
HAND_IDS = [
    r"(?i)Poker Hand\s*#([A-Z0-9]+)", r"(?i)PokerStars\s+Hand\s*#([A-Z0-9]+)", r"(?i)Game\s*Hand\s*#([A-Z0-9]+)",
    r"(?i)Game\s*#([A-Z0-9]+)", r"(?i)Hand\s*#([A-Z0-9]+)",
]
TOURNAMENT_NAMES = [
    r"Tournament #\d+,\s*(?:\$[\d.]+\+\$[\d.]+\s*\w+\s+)?([^-\n]+?)(?:\s*-\s*Level|\n)",
    r'Tournament\s+#\d+\s*"([^"]+)"',
    r"Tournament\s+ID:\s*\d+\s*-\s*([^\n]+)",
]


def tournament_id(text: Column) -> Column:
    found = first_match(text, TOURNAMENT_IDS)
    return F.trim(F.regexp_replace(F.translate(found, " ", " "), r"\s+", " "))


def hand_id(text: Column) -> Column:
    return first_match(text, HAND_IDS)


def tournament_name(text: Column, chars: int | None = None) -> Column:
    """The tournament named before the first street, or in the first ``chars`` characters."""
    return F.trim(first_match(head(text, chars), TOURNAMENT_NAMES))


# Section markers, in order of preference.
SECTIONS = {
    "hole_cards": [r"\*\*\*\s*HOLE\s*CARDS\s*\*\*\*", r"\*\*\*\s*POCKET\s*CARDS\s*\*\*\*", r"\*\*\*\s*PRE-?FLOP\s*\*\*\*", r"\*\*\s*Dealing\s+down\s+cards\s*\*\*"],
    "flop": [r"\*\*\*\s*FLOP\s*\*\*\*", r"\*\*\s*Dealing\s+flop\s*\*\*"],
    "turn": [r"\*\*\*\s*TURN\s*\*\*\*", r"\*\*\s*Dealing\s+turn\s*\*\*"],
    "river": [r"\*\*\*\s*RIVER\s*\*\*\*", r"\*\*\s*Dealing\s+river\s*\*\*"],
    "showdown": [r"\*\*\*\s*SHOW\s*DOWN\s*\*\*\*", r"\*\*\s*Showdown\s*\*\*"],
    "summary": [r"\*\*\*\s*SUMMARY\s*\*\*\*", r"\*\*\s*Summary\s*\*\*"],
}


def section_offsets(text: Column, base: Column | int = 0) -> Column:
    """Map of section name to character offset (plus ``base``); absent sections have no key."""
    base = base if isinstance(base, Column) else F.lit(base)
    entries = [F.struct(F.lit("hand_start").alias("key"), base.cast("int").alias("value"))]
    for name, patterns in SECTIONS.items():
        at = F.coalesce(*[F.nullif(F.regexp_instr(text, F.lit(f"(?i){p}")), F.lit(0)) for p in patterns])
        entries.append(F.when(at.isNotNull(), F.struct(F.lit(name).alias("key"), (base + at - 1).cast("int").alias("value"))))
    entries.append(F.struct(F.lit("hand_end").alias("key"), (base + F.length(text)).cast("int").alias("value")))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def excerpt(text: Column, start: Column, end: Column, context: int, hero: Column, mark: str = "**") -> Column:
    """Slice with some context on both sides, the hero's name marked."""
    first = F.greatest(F.lit(0), start - context)
    cut = F.substring(text, first + 1, F.greatest(F.least(F.length(text), end + context) - first, F.lit(0)))
    return F.when(F.coalesce(hero, F.lit("")) == "", cut).otherwise(
        F.replace(cut, hero, F.concat(F.lit(mark), hero, F.lit(mark)))
    )


def clean_name(name: Column) -> Column:
    """Single spaces, no bracketed parts."""
    text = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*\[.*?\]", ""), r"\s*\(.*?\)", ""))


def cards(text: Column) -> Column:
    """Two-character cards from letters or suit symbols."""
    plain = F.translate(text, "♠♣♥♦♤♧♡♢", "schdschd")
    found = F.regexp_extract_all(plain, F.lit(r"(?i)([AKQJT2-9][schd])"), F.lit(1))
    return F.transform(found, lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1))))


def action_kind(verb: Column, allin: Column) -> Column:
    """Canonical type of a free-form verb; an all-in that is no call and no fold is a raise."""
    v = F.lower(verb)
    return (
        F.when(v.contains("fold"), "FOLD")
        .when(v.contains("check"), "CHECK")
        .when(v.contains("call") | v.contains("limp"), "CALL")
        .when(v.contains("raise"), "RAISE")
        .when(v.contains("bet"), "BET")
        .when(yes(allin) | v.rlike("all-?\\s?in"), "RAISE")
    )


# --- seats and actions -----------------------------------------------------------

_CUR = r"(?:R\$|€|£|\$|¥|₹)?"
STACK_SHAPES = [
    rf"Seat \d+: (.+?) \({_CUR}([0-9,.]+) in chips(?:,\s*[^)]+)?\)",
    rf"Seat \d+: (.+?) \({_CUR}([0-9,.]+)(?:,\s*[^)]+)?\)",
    rf"Seat \d+: (.+?) \(\s*{_CUR}\s*([0-9,.]+)\s*\)(?!\s*is the button)",
]
SEAT_LINE = r"(?m)Seat\s+(\d+):\s+(.+?)\s+\("
SEAT_LINE_DEALT = r"(?m)Seat\s+(\d+):\s+(?!.*out of hand)(.+?)\s+\("


def _all(text: Column, pattern: str, *groups: int) -> Column:
    """All matches in one text as ``array<struct<g0, g1, ...>>``, one regex pass per group."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])


def hero_name(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"Dealt to ([^\[]+?)\s*\[", 1)), F.lit(""))


def button_seat(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"Seat #?(\d+) is the button", 1), F.lit("")).try_cast("int")


def seat_list(text: Column) -> Column:
    """``array<struct<seat, name>>`` from the seat lines above the summary section."""
    top = F.substring_index(F.substring_index(text, "*** SUMMARY ***", 1), "** Summary **", 1)
    found = F.when(text.startswith("PokerStars"), _all(top, SEAT_LINE_DEALT, 1, 2)).otherwise(_all(top, SEAT_LINE, 1, 2))
    return F.transform(found, lambda m: F.struct(m["g1"].try_cast("int").alias("seat"), m["g2"].alias("name")))


def stack_list(text: Column) -> Column:
    """``array<struct<name, chips>>`` of positive stacks, each line read by the first shape it has."""

    def read(line: Column) -> Column:
        name = first_match(line, STACK_SHAPES, 1)
        return F.struct(F.trim(name).alias("name"), amount(first_match(line, STACK_SHAPES, 2)).alias("chips"))

    lines = F.regexp_extract_all(text, F.lit(r"Seat \d+: [^\n]*"), F.lit(0))
    return F.filter(F.transform(lines, read), lambda s: s["name"].isNotNull() & (s["chips"] > 0))


def chip_list(text: Column) -> Column:
    """Stacks of "in chips" seat lines only, plain notation: what the all-in arithmetic uses."""
    return F.transform(
        _all(text, STACK_SHAPES[0], 1, 2),
        lambda m: F.struct(F.trim(m["g1"]).alias("name"), amount_us(m["g2"]).alias("chips")),
    )


def big_blind(text: Column) -> Column:
    """First positive big blind: a post, or an ``X/Y Blinds`` header."""
    post = rf"(?i)posts (?:the )?big blind \[?{_CUR}([0-9,.]+)"
    header = r"[0-9,.]+/([0-9,.]+)\s+Blinds"
    found = F.when(
        text.contains(" Blinds"), F.regexp_extract_all(text, F.lit(f"{post}|{header}"), F.lit(0))
    ).otherwise(F.regexp_extract_all(text, F.lit(post), F.lit(0)))
    values = F.transform(
        found,
        lambda m: amount(F.coalesce(F.nullif(F.regexp_extract(m, post, 1), F.lit("")), F.regexp_extract(m, header, 1))),
    )
    return F.coalesce(F.get(F.filter(values, lambda v: v > 0), F.lit(0)), F.lit(0.0))


def ante(text: Column) -> Column:
    shapes = [r"posts (?:the )?ante (?:€|£|\$|¥|R\$)?([0-9,.]+)", r"Ante: (?:€|£|\$|¥|R\$)?([0-9,.]+)"]
    return F.coalesce(amount_us(first_match(text, shapes)), F.lit(0.0))


# Street markers, in order of preference.
STREET_OPEN = {
    "preflop": ["*** HOLE CARDS ***", "** Dealing down cards **"],
    "flop": ["*** FLOP ***", "** Dealing Flop **", "** Dealing flop **"],
    "turn": ["*** TURN ***", "** Dealing Turn **", "** Dealing turn **"],
    "river": ["*** RIVER ***", "** Dealing River **", "** Dealing river **"],
}
RIVER_CLOSE = ["*** SHOW DOWN ***", "*** SHOWDOWN ***", "*** SUMMARY ***", "** Summary **"]
_NEXT = {"preflop": STREET_OPEN["flop"], "flop": STREET_OPEN["turn"], "turn": STREET_OPEN["river"], "river": RIVER_CLOSE}


def _found(text: Column, markers: list[str]) -> list[Column]:
    """Position of each marker, NULL when absent. Plain search, no regex."""
    return [F.nullif(F.instr(text, m), F.lit(0)) for m in markers]


def reached(text: Column, street: str) -> Column:
    return any_of(*[text.contains(m) for m in STREET_OPEN[street]])


def street_text(text: Column, street: str) -> Column:
    """Text from a street's marker up to the next street's; '' when the street was not reached."""

    def cut(rest: Column) -> Column:
        end = F.least(*_found(rest, _NEXT[street]))
        return F.when(end.isNull(), rest).otherwise(F.substring(rest, F.lit(1), end - 1))

    start = F.coalesce(*_found(text, STREET_OPEN[street]))
    return F.when(start.isNull(), F.lit("")).otherwise(let(F.substring(text, start, F.length(text)), cut))


# who, then what: up to a colon, or without one (a single word before the flop)
_MONEY = r"(?:[ \t]+(?:€|£|\$|¥|R\$)?\[?([0-9,.]+)\]?)?(?:[ \t]+to[ \t]+(?:€|£|\$|¥|R\$)?\[?([0-9,.]+)\]?)?"
_PRE_LINE = (
    r"(?m)^[ \t]*([^:\n]+(?=:)|\S+):?[ \t]+"
    r"(folds|calls|raises|bets|checks|posts|(?<=:[ \t]{1,8})is all-in|all-in)[^\n]*"
)
_POST_LINE = rf"(?m)^[ \t]*(.*(?=:)|.+?):?[ \t]+(folds|calls|raises|bets|checks){_MONEY}[^\n]*"


def street_actions(text: Column, street: str) -> Column:
    """``array<struct<player, verb, amount, allin>>`` in order; blind and ante posts are left out.

    Amounts are the total put in on that street and only read after the flop, where
    the all-in arithmetic needs them.
    """
    pattern = _PRE_LINE if street == "preflop" else _POST_LINE

    def read(line: Column) -> Column:
        group = lambda n: F.regexp_extract(line, pattern, n)
        if street == "preflop":
            put_in = F.lit(0.0)
        else:
            money = F.coalesce(F.nullif(group(4), F.lit("")), group(3))
            put_in = let(money, lambda m: F.when(m == "", F.lit(0.0)).otherwise(amount_us(m)))
        return F.struct(
            F.trim(group(1)).alias("player"), group(2).alias("verb"), put_in.alias("amount"), F.lower(line).rlike("all[- ]in").alias("allin")
        )

    # one pass over the text finds the action lines; fields are read from each short line
    lines = F.regexp_extract_all(street_text(text, street), F.lit(pattern), F.lit(0))
    return F.filter(F.transform(lines, read), lambda a: a["verb"] != "posts")


def hand_actions(text: Column) -> Column:
    """``array<struct<street, pos, player, verb, amount, allin>>``: the action lines of all streets, ``pos`` counted on each.

    Exploded as it is, all streets of a hand are one row of one pass. Exploding a column that
    holds the array instead makes Spark add a filter on its size, which is pushed below the
    columns the array is made of and computes the text anew wherever it is named.
    """

    def placed(street: str) -> Column:
        row = lambda a, pos: F.struct(F.lit(street).alias("street"), pos.alias("pos"), *[a[f].alias(f) for f in ("player", "verb", "amount", "allin")])
        return F.transform(street_actions(text, street), row)

    return F.concat(*[placed(street) for street in STREET_OPEN])


# --- how a hand ended ---------------------------------------------------------------


def _quoted(name: Column) -> Column:
    """A name as a pattern that matches it alone; an end mark inside the name is quoted apart."""
    return F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def showdown_seen(text: Column) -> Column:
    marks = [" shows [", "showed [", "*** SHOW DOWN ***", "*** SHOWDOWN ***", "** Showdown **"]
    return any_of(*[text.contains(m) for m in marks])


def hero_at_showdown(text: Column, hero: Column) -> Column:
    """The hero showed, mucked, refused to show or collected."""
    low, low_hero = F.lower(text), F.lower(hero)
    exact = [": shows [", " shows [", " collected"]
    loose = [": mucks", " mucks [", " does not show", " doesn't show"]
    return any_of(
        *[text.contains(F.concat(hero, F.lit(x))) | text.contains("Hero" + x) for x in exact],
        *[low.contains(F.concat(low_hero, F.lit(x))) | low.contains("hero" + x) for x in loose],
        F.regexp(text, F.concat(_quoted(hero), F.lit(r".*showed \["))),
        text.rlike(r"Hero.*showed \["),
    )


def hero_won(text: Column, hero: Column) -> Column:
    """The hero collected, or a summary or showdown line says the hero won."""

    def after(marker: str) -> Column:
        at = F.instr(text, marker)
        return F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(F.lit(""))

    name = _quoted(hero)
    line_pair = F.concat(
        F.lit(r"(?:^|\n)(?=[^\n]*"), name, F.lit(r")(?=[^\n]*showed)(?:[^\n]*\n){0,2}(?=[^\n]*"), name,
        F.lit(r")(?=[^\n]*(?i:won))"),
    )
    return any_of(
        text.contains(F.concat(hero, F.lit(" collected"))) | text.contains("Hero collected"),
        F.regexp(after("*** SUMMARY ***"), F.concat(F.lit(r"Seat \d+: "), name, F.lit(".*collected"))),
        F.regexp(after("** Summary **"), F.concat(F.lit("(?i)(?:"), name, F.lit("|Hero).*(?:collected|wins)"))),
        F.regexp(after("*** SHOW DOWN ***"), line_pair),
        F.regexp(after("*** SHOWDOWN ***"), line_pair),
        F.lower(text).contains(F.concat(hero, F.lit(" won"))),
    )
