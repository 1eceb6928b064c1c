"""Timestamps and month keys as Columns. Month keys are ``YYYY-MM`` strings."""

from pyspark.sql import Column, functions as F

from tallyhand.functions.columns import first_match, let, lookup

FALLBACK_MONTH = "1970-01"
ZONE = "Europe/Lisbon"

# Shapes a timestamp can have in the logs.
ISO_SECONDS = r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})"
STAMP_SHAPES = [
    r"(\d{4}[\-/]\d{2}[\-/]\d{2}[ T]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)",
    r"(\d{2}[\-/]\d{2}[\-/]\d{4}[ T]\d{2}:\d{2}(?::\d{2})?)",
]
MONTH_SHAPE = r"(?:^|[^\d])(\d{4}[\-_/]\d{2})(?:[^\d]|$)"
# formats tried in turn once no second-resolution ISO stamp is found
LENIENT_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "yyyy-MM", "MM-dd-yyyy HH:mm:ss", "MM-dd-yyyy HH:mm",
    "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMM yyyy HH:mm:ss",
]


def month_key(value: Column) -> Column:
    """The value when it already is a ``YYYY-MM`` key, else NULL."""
    trimmed = F.trim(value)
    return F.when(trimmed.rlike(r"^\d{4}-\d{2}$"), trimmed)


def valid_month(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^\d{4}-\d{2}$") & ~value.startswith("1970-"), F.lit(False))


def parse_stamp(value: Column) -> Column:
    """Lenient text to TIMESTAMP; naive stamps are UTC (the session zone is UTC).

    Bare numbers, of any size and sign, are seconds since 1970; four digits that read as a year
    and eight that read as a date are one.
    """

    def tries(text: Column) -> Column:
        iso = F.nullif(F.regexp_extract(text, ISO_SECONDS, 1), F.lit(""))
        return F.coalesce(
            F.try_to_timestamp(F.replace(iso, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")),
            *[F.try_to_timestamp(text, F.lit(fmt)) for fmt in LENIENT_FORMATS],
            F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd"))),
            F.when(text.rlike(r"^[12]\d{3}$"), F.try_to_timestamp(text, F.lit("yyyy"))),
            F.when(text.rlike(r"^-?\d+(?:\.\d+)?$"), parse_epoch(text.try_cast("double"))),
        )

    return let(F.translate(F.trim(value), "/–", "--"), tries)


def parse_epoch(value: Column) -> Column:
    """Numeric seconds since 1970, NULL outside of the years 1 to 9999."""
    return F.when(value.between(-62135596800, 253402300799), F.timestamp_seconds(value))


def month_of(stamp: Column) -> Column:
    """Month key of a UTC timestamp in the players' zone."""
    return F.date_format(F.from_utc_timestamp(stamp, ZONE), "yyyy-MM")


def month_bucket(value: Column, fallback: Column | None = None) -> Column:
    """Month of the stamp, else the given month, else the fallback key."""
    given = month_key(fallback) if fallback is not None else F.lit(None).cast("string")
    return F.coalesce(month_of(parse_stamp(value)), given, F.lit(FALLBACK_MONTH))


def header_stamp(line: Column) -> Column:
    """Timestamp of a hand header line in one of three site shapes."""
    slashed = F.nullif(F.regexp_extract(line, r"-\s*(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})", 1), F.lit(""))
    day_first = F.nullif(F.regexp_extract(line, r"\*\*\*\s+(\d{2}\s+\d{2}\s+\d{4}\s+\d{2}:\d{2}:\d{2})", 1), F.lit(""))
    squeeze = lambda c: F.regexp_replace(c, r"\s+", " ")
    return F.coalesce(
        F.try_to_timestamp(squeeze(slashed), F.lit("yyyy/MM/dd HH:mm:ss")),
        F.try_to_timestamp(squeeze(day_first), F.lit("dd MM yyyy HH:mm:ss")),
    )


def month_in_text(text: Column, chars: int | None = None) -> Column:
    """Month from free text: the first full stamp that parses, else a bare month; in the whole text or its first ``chars`` characters."""

    def find(snippet: Column) -> Column:
        stamps = [month_of(parse_stamp(first_match(snippet, [p]))) for p in STAMP_SHAPES]
        bare = month_key(F.translate(F.regexp_extract(snippet, MONTH_SHAPE, 1), "_/", "--"))
        return F.coalesce(*stamps, bare)

    return let(text if chars is None else F.substring(text, 1, chars), find)


def month_in_path(path: Column) -> Column:
    """Month from the last path part that holds one."""
    parts = F.reverse(F.split(path, "/"))
    hits = F.filter(F.transform(parts, lambda p: month_in_text(p)), lambda m: m.isNotNull())
    return F.get(hits, F.lit(0))


def month_for_file(content: Column, path: Column, meta_month: Column, meta_stamp: Column, chars: int | None = None) -> Column:
    """Metadata, then content, then path parts from the end, then the parent, then the whole path."""
    parent = F.regexp_replace(path, r"/[^/]*$", "")
    return F.coalesce(
        month_key(meta_month), month_of(parse_stamp(meta_stamp)), month_in_text(content, chars), month_in_path(path),
        month_in_text(parent), month_in_text(path), F.lit(FALLBACK_MONTH),
    )


def best_stamp(fields: list[Column], text: Column) -> Column:
    """First field that parses, else the first stamp in the text; '' when there is none."""
    found = F.coalesce(
        *[parse_stamp(f) for f in fields], *[parse_stamp(first_match(text, [p])) for p in STAMP_SHAPES]
    )
    return F.coalesce(F.date_format(found, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(""))


# Portuguese month names.
MONTH_NAMES = {
    "janeiro": 1, "fevereiro": 2, "março": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7,
    "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12, "marco": 3,
}
# The stamp each site prints in its header, with the zone that may follow.
SITE_STAMPS = {
    "pokerstars": r"-\s+(?<ts>\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})(?:\s*\((?<tzAlt>[^)]+)\))?\s*(?<tz>[A-Z]{2,4})?",
    "ggpoker": r"-\s+(?<ts>\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})(?:\s*(?<tz>UTC|GMT|CET|CEST|[+-]\d{2}:?\d{2}))?",
    "888poker": r"(?<ts>\d{4}[-/]\d{2}[-/]\d{2}\s+\d{2}:\d{2}:\d{2})\s*(?<tz>[A-Z]{2,4})?",
    "888pt_iso": r"(?<ts>\d{4}[-/]\d{2}[-/]\d{2}\s+\d{2}:\d{2}:\d{2})\s*(?<tz>[A-Z]{2,4})?",
    "888pt_localized": r"(?<day>\d{1,2})\s+(?<month>[A-Za-zçã]+)\s+(?<year>\d{4})\s+(?<time>\d{2}:\d{2})\s*(?<tz>[A-Z]{2,4})?",
    "888_numeric": r"(?<day>\d{1,2})\s+(?<month>\d{2})\s+(?<year>\d{4})\s+(?<time>\d{2}:\d{2}:\d{2})",
    "winamax": r"-\s+(?<ts>\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s*(?<tz>[A-Z]{2,4})?",
    "wpn": r"-\s+(?<ts>\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})(?:\s*\((?<tzAlt>[^)]+)\))?\s*(?<tz>[A-Z]{2,4})?",
}


def month_in_header(text: Column, site: Column, chars: int | None = None) -> Column:
    """Month printed in a hand header, without a zone shift; month names may be Portuguese.

    The header ends at the first blank line or the cards; without either it is the whole text,
    or its first ``chars`` characters.
    """
    blank = F.instr(text, "\n\n")
    cards = F.instr(text, "*** HOLE CARDS ***")
    whole = F.length(text) if chars is None else F.least(F.length(text), F.lit(chars))
    end = F.when(blank > 0, blank - 1).when(cards > 0, cards - 1).otherwise(whole)

    def read(head: Column) -> Column:
        grab = lambda p, g: F.nullif(F.regexp_extract(head, p, g), F.lit(""))
        month = lambda y, m: F.concat(y, F.lit("-"), F.lpad(m, 2, "0"))
        by_number, by_name = SITE_STAMPS["888_numeric"], SITE_STAMPS["888pt_localized"]
        numeric = month(grab(by_number, 3), grab(by_number, 2))
        named = month(grab(by_name, 3), lookup(MONTH_NAMES, F.lower(grab(by_name, 2))).cast("string"))
        stamped = lambda name: F.translate(F.substring(grab(SITE_STAMPS[name], 1), 1, 7), "/", "-")
        out = F.when(site.isin("888pt", "888.pt"), F.coalesce(numeric, named, stamped("888pt_iso")))
        out = out.when(site == "888poker", F.coalesce(numeric, stamped("888poker")))
        for name in ("pokerstars", "ggpoker", "winamax", "wpn"):
            out = out.when(site == name, stamped(name))
        return out

    return let(F.substring(text, F.lit(1), end), read)
