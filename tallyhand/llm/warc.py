"""WARC records: captures of pages, and not-modified revisits resolved to full responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhand.llm.common import written
from tallyhand.llm.ranges import range_of, sortable, split_ranges

#: Records of one range, the work of one window, at most about; fewer where all records make less than ``RANGES`` of them.
RANGE_ROWS = 500_000
RANGES = 64
# Header fields that a 304 answer may renew in a stored response (RFC 9110, RFC 9111).
RENEWED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that name the way to a page, not the page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """A URL without scheme, www, default port, fragment, tracking parameters and last slash; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), r"^www\.|:80$|:443$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def _etag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit: what it refers to, and the headers it then has.

    ``records`` has record_id, url, date (timestamp), kind ('response' or 'revisit'), status
    and headers (map, names in lower case). Each revisit is joined to the latest earlier full
    response (kind response, status 200) of the same canonical URL. If both have an ETag these
    must agree (weak comparison), or else both must have the same Last-Modified. Then the
    response's headers hold, renewed by those of the revisit that a 304 may change.

    Returns record_id, url (canonical), date, outcome ('resolved', 'validators differ',
    'no validators', 'no earlier response', 'no url or date'), refers_to, refers_to_date,
    headers (those of the revisit itself if unresolved; null headers count as none).

    Records are ordered by (URL hash, date, kind, id) and cut into ranges of about
    ``RANGE_ROWS`` by sampled splitters, so a URL with any share of the records is many tasks.
    The last full response of each range is carried into the next ones over one row per range.
    At the same instant a response is no earlier one; among responses of one instant the one
    with the largest id counts. Repeated rows are resolved each.
    """
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical_url(F.col("url")).alias("url"),
        F.col("date").cast("timestamp").alias("date"),
        (F.col("kind") == "revisit").alias("_revisit"),
        F.coalesce((F.col("kind") == "response") & (F.col("status") == 200), F.lit(False)).alias("_full"),
        headers.alias("headers"),
        F.monotonically_increasing_id().alias("_row"),
    )
    kept = written(rows.where(F.col("_full") | F.col("_revisit")).withColumn("_one", F.lit(1)), "records")
    placed = kept.where(F.col("url").isNotNull() & F.col("date").isNotNull()).withColumn(
        "_key",
        sortable(F.xxhash64("url"), F.hash("url"), F.unix_micros("date"), F.col("_full").cast("int"), F.col("record_id"), F.col("_row")),
    )
    bounds, _ = split_ranges(placed, "_key", "_one", max(1, min(placed.count() / RANGES, RANGE_ROWS)))
    ranged = placed.withColumn("_range", range_of(F.col("_key"), bounds)).withColumn(
        "_own", F.when(F.col("_full"), F.struct("url", "record_id", "date", "headers"))
    )
    last = ranged.where(F.col("_full")).groupBy("_range").agg(F.max_by("_own", "_key").alias("_last"))  # one row a range
    every = records.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("_range"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.join(last, "_range", "left").select("_range", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    seen = ranged.withColumn("_seen", F.last("_own", ignorenulls=True).over(within)).where("_revisit").join(carried, "_range", "left")
    latest = F.coalesce("_seen", "_carried")
    found = seen.select("record_id", "url", "date", "headers", F.when(latest["url"] == F.col("url"), latest).alias("_full"))
    lost = kept.where(F.col("_revisit") & (F.col("url").isNull() | F.col("date").isNull()))

    full = F.col("_full")
    tags = _etag(F.col("headers")).isNotNull() & _etag(full["headers"]).isNotNull()
    days = F.col("headers")["last-modified"].isNotNull() & full["headers"]["last-modified"].isNotNull()
    outcome = (
        F.when(full.isNull(), "no earlier response")
        .when(tags, F.when(_etag(F.col("headers")) == _etag(full["headers"]), "resolved").otherwise("validators differ"))
        .when(days, F.when(F.col("headers")["last-modified"] == full["headers"]["last-modified"], "resolved").otherwise("validators differ"))
        .otherwise("no validators")
    )
    told = found.withColumn("outcome", outcome).withColumn("_resolved", F.col("outcome") == "resolved")
    renewed = F.map_filter("headers", lambda k, _: k.isin(RENEWED))
    stale = F.map_filter(full["headers"], lambda k, _: ~F.array_contains(F.map_keys(renewed), k))
    return told.select(
        "record_id",
        "url",
        "date",
        "outcome",
        F.when(F.col("_resolved"), full["record_id"]).alias("refers_to"),
        F.when(F.col("_resolved"), full["date"]).alias("refers_to_date"),
        F.when(F.col("_resolved"), F.map_concat(stale, renewed)).otherwise(F.col("headers")).alias("headers"),
    ).unionByName(
        lost.select(
            "record_id",
            "url",
            "date",
            F.lit("no url or date").alias("outcome"),
            F.lit(None).cast("long").alias("refers_to"),
            F.lit(None).cast("timestamp").alias("refers_to_date"),
            "headers",
        )
    )


def captures(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl that fetched each page in the order of page_id, and asked for it again later.

    Every page gives a full response. A second visit a day later (for every 13th page a day
    earlier) under a variant of the URL gives a revisit: its ETag is the page's, weak for every
    5th page, another for every 7th, and missing for every 11th; every 3rd page goes by
    Last-Modified only.
    """
    n = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    seconds = n * 60 + 1_600_000_000
    day = F.concat(F.lit("day "), F.floor(n / 1440).cast("string"))
    dated = n % 3 == 0

    def some(*pairs):
        return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs]), lambda e: e["v"].isNotNull()))

    response = F.struct(
        (n * 2).alias("record_id"),
        F.col("url"),
        F.timestamp_seconds(seconds).alias("date"),
        F.lit("response").alias("kind"),
        F.lit(200).alias("status"),
        some(
            ("content-type", F.lit("text/html")),
            ("content-length", F.octet_length(F.coalesce("html", F.lit(""))).cast("string")),
            ("date", seconds.cast("string")),
            ("cache-control", F.lit("max-age=60")),
            ("etag", F.when(~dated, tag)),
            ("last-modified", day),
        ).alias("headers"),
    )
    again = seconds + F.when(n % 13 == 0, -86400).otherwise(86400)
    revisit = F.struct(
        (n * 2 + 1).alias("record_id"),
        F.concat(F.regexp_replace(F.col("url"), "#.*$", ""), F.lit("#again")).alias("url"),
        F.timestamp_seconds(again).alias("date"),
        F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"),
        some(
            ("content-length", F.lit("0")),
            ("date", again.cast("string")),
            ("cache-control", F.lit("max-age=600")),
            ("etag", F.when(n % 11 == 0, None).when(n % 7 == 0, F.lit('"other"')).when(n % 5 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)),
            ("last-modified", F.when(dated & (n % 11 != 0), F.when(n % 7 == 0, F.lit("another day")).otherwise(day))),
        ).alias("headers"),
    )
    return pages.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


def header_text(headers: Column) -> Column:
    """Headers as lines in the order of their names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
