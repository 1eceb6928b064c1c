"""Identity, deduplication and merging of hand records.

First-wins deduplication is an aggregation (minimum of the order key), not a window:
copies of one hand combine map-side, so a single id that makes up a third of the
input reaches the reducer as one row per task.
"""

from pyspark.sql import Column, DataFrame, functions as F


def fingerprint(text: Column) -> Column:
    """SHA-1 of the text after trimming, CRLF to LF, one pass of blank-line removal, lower case."""
    flat = F.regexp_replace(text, r"^\s+|\s+$", "")
    flat = F.replace(F.replace(flat, F.lit("\r\n"), F.lit("\n")), F.lit("\n\n"), F.lit("\n"))
    return F.sha1(F.lower(flat))


def stable_id(*parts: Column, names: Column | None = None) -> Column:
    """16 hex digits from the given fields and, when given, the sorted player names."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    if names is not None:
        text.append(F.sha1(F.array_join(F.array_sort(names), "|")))
    return F.substring(F.sha1(F.concat_ws("|", *text)), 1, 16)


def hand_key(site: Column, tournament: Column, hand: Column, stamp: Column, text: Column) -> Column:
    """(site, tournament, hand id or stamp or text hash) as one struct."""
    return F.struct(
        F.coalesce(site, F.lit("unknown")).alias("site"),
        F.coalesce(tournament, F.lit("no_tournament")).alias("tournament"),
        F.coalesce(hand, stamp, F.sha1(F.regexp_replace(text, r"^\s+|\s+$", ""))).alias("hand"),
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def first_records(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per non-empty key: the one that comes first by ``order``."""
    pick = F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order))
    kept = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(pick.alias("_row"))
    return kept.select(key, "_row.*").select(*rows.columns)


def already_seen(uploads: DataFrame, seen: DataFrame, user: str, digest: str) -> DataFrame:
    """Uploads whose content this user has sent before."""
    return uploads.join(seen.select(user, digest).distinct(), [user, digest], "left_semi")


def not_seen(uploads: DataFrame, seen: DataFrame, user: str, digest: str) -> DataFrame:
    return uploads.join(seen.select(user, digest).distinct(), [user, digest], "left_anti")


def repeated_content(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """Contents that occur more than once: copies and the first key."""
    return (
        rows.groupBy(digest)
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"))
        .where(F.col("copies") > 1)
    )


def ids_in_many(rows: DataFrame, key: str, bucket: str) -> DataFrame:
    """Ids that occur in more than one bucket, with the number of buckets."""
    pairs = rows.select(key, bucket).distinct()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("buckets")).where(F.col("buckets") > 1)


def restrict(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def missing_from(rows: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Ids of ``rows`` that the reference set lacks."""
    return rows.join(reference.select(key).distinct(), key, "left_anti")


def merge_runs(runs: list[DataFrame], months: list[str] | None = None) -> DataFrame:
    """Union of record sets of several runs, first run first, each id once.

    Needs ``hand_id``, ``hand_index`` and ``month``. With ``months`` only those are
    kept, but records without a month stay.
    """
    out = None
    for i, run in enumerate(runs):
        tagged = run.withColumn("run", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if months is not None:
        out = out.where(F.col("month").isNull() | F.col("month").isin(months))
    return first_records(out, "hand_id", ["run", "file_id", "hand_index"])
