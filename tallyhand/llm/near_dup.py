"""Near duplicates: pairs that share a MinHash band are decided on whole n-gram sets."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhand.llm.common import written

#: Words of an n-gram, and the least Jaccard similarity of a link.
WORDS = 5
SIMILARITY = 0.8
#: The share of pairs at exactly the least similarity that meet in a band; more of the others.
RECALL = 0.9999
#: Hash functions to spend; more allow longer bands, which let fewer unlike pairs meet.
HASHES = 300
#: Texts, and n-grams, of one block; two blocks are compared in one task.
BLOCK_TEXTS = 256
BLOCK_GRAMS = 500_000
#: Tasks that the edges of one node of a component are dealt to.
SALTS = 8
_WORD = re.compile(r"\w+")
_REMEMBERED = 150_000
_GRAMS = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_and_rows(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """The most rows for a band such that so many bands as the recall takes stay within the hash functions."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1)
    for rows in range(2, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


class _Hashes(dict):
    """64-bit hashes of words, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_HASHES = _Hashes()


def grams(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted set of hashed word n-grams of a text; one of all its words if these are fewer."""
    found = _WORD.findall(text.lower())
    if not found:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    span = min(words, len(ids))
    mixed = np.full(len(ids) - span + 1, span, np.uint64)
    for i in range(span):
        mixed = (mixed ^ ids[i : i + len(mixed)]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    return random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, n, dtype=np.uint64)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(set, band) hashes of ``rows`` MinHash values each; the sets must not be empty."""
    a, b = _seeds(bands * rows)
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        mixed = np.full(len(sets), band, np.uint64)
        for i in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat(joined * a[i] + b[i], starts)
            mixed = (mixed ^ least) * _MIX
            mixed ^= mixed >> np.uint64(31)
        out[:, band] = mixed
    return out.view(np.int64)


def _sketched(parts: Iterator[pd.DataFrame], bands: int, rows: int, words: int) -> Iterator[pd.DataFrame]:
    """doc_id, text_key, set_key, n, bands for each text, in runs of bounded n-grams."""

    def done(run):
        full = [r[2] for r in run if len(r[2])]
        hashes = iter(band_hashes(full, bands, rows)) if full else iter(())
        return pd.DataFrame(
            {
                "doc_id": [r[0] for r in run],
                "text_key": [r[1] for r in run],
                "set_key": [xxhash.xxh3_128_digest(r[2].tobytes() if len(r[2]) else b"no words" + r[1].encode()) for r in run],
                "n": [len(r[2]) for r in run],
                "bands": [next(hashes) if len(r[2]) else [] for r in run],
            }
        )

    run, size = [], 0
    for part in parts:
        for doc_id, text_key, text in zip(part["doc_id"], part["text_key"], part["text"]):
            run.append((doc_id, text_key, grams(text, words)))
            size += len(run[-1][2])
            if size > _GRAMS or len(run) > 2000:
                yield done(run)
                run, size = [], 0
    if run:
        yield done(run)


def _meet(rows: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """Rows with the one row that each key has; a key's rows are dealt by another column, so a hub is no single task."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    spread = one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b: longs), the root being its component's smallest node.

    Large-star and small-star steps in turn until no edge changes. Minima are aggregates with
    map-side sums and joins are salted, so a node may have any number of neighbours; each turn
    is a written table.
    """
    pairs = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = _meet(both.where("b > a"), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _meet(large, least, "a", "b").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        pairs = written(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())


_LINKS = "uid bigint, root bigint, links bigint"


def _compare(group: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between two blocks, or inside one: for each set the copies it links to, and its local component.

    Only pairs that share a band are looked at, and of these the pairs whose shared bands'
    smallest first set is the one this group is named by; other groups have the others.
    """
    group = group.sort_values("uid", ignore_index=True)
    bands, firsts = (np.array(group[c].tolist(), np.int64) for c in ("bands", "firsts"))
    none = np.iinfo(np.int64).max
    named = np.full((len(group), len(group)), none)
    for band, first in zip(bands.T, firsts.T):
        np.minimum(named, np.where(band[:, None] == band[None, :], first[:, None], none), out=named)
    pairs = named == group["first"].iloc[0]
    block = group["block"].to_numpy()
    if group["low"].iloc[0] != group["high"].iloc[0]:
        pairs &= block[:, None] != block[None, :]
    np.fill_diagonal(pairs, False)
    used = np.flatnonzero(pairs.any(axis=1))
    if not len(used):
        return pd.DataFrame({"uid": [], "root": [], "links": []}, dtype="int64")
    group, pairs = group.iloc[used], pairs[np.ix_(used, used)]
    sets = [np.frombuffer(g, np.uint64) for g in group["grams"]]
    sizes = np.array([len(s) for s in sets])
    owners = np.repeat(np.arange(len(sets)), sizes)
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts > 1  # an n-gram of one text alone is in no intersection
    column = np.cumsum(often) - 1
    mine = often[codes]
    owners, columns = owners[mine], column[codes[mine]]
    order = np.argsort(columns, kind="stable")
    owners, columns = owners[order], columns[order]
    shared = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for at in range(0, int(often.sum()), width):
        low, high = np.searchsorted(columns, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owners[low:high], columns[low:high] - at] = 1
        shared += part @ part.T
    link = pairs & (shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-9)
    label = np.arange(len(sets))
    while True:
        least = np.minimum(label, np.where(link, label[None, :], len(sets)).min(axis=1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    uid = group["uid"].to_numpy()
    return pd.DataFrame({"uid": uid, "root": uid[label], "links": link @ group["copies"].to_numpy()})


def _gram_sets(parts: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for part in parts:
        for at in range(0, len(part), 256):
            some = part.iloc[at : at + 256]
            yield pd.DataFrame({"uid": some["uid"], "grams": [grams(t, words).tobytes() for t in some["text"]]})


def _sets_and_links(docs: DataFrame, similarity: float, recall: float, words: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, text_key, set_key), (sets: set_key, doc_id, text_key, copies, n, links, root), one of each distinct set."""
    bands, rows = bands_and_rows(similarity, recall)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.sha2("text", 256))
    # ids as text: pandas would turn long ones beside a null into floats
    found = keyed.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        lambda parts: _sketched(parts, bands, rows, words), "doc_id string, text_key string, set_key binary, n int, bands array<bigint>"
    )
    sketched = written(found.withColumn("doc_id", F.col("doc_id").cast("long")), "sketches")
    sets = written(
        sketched.groupBy("set_key")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "text_key")).alias("_first"),
            F.count("*").alias("copies"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
        )
        .select("set_key", "_first.doc_id", "_first.text_key", "copies", "n", "bands", F.monotonically_increasing_id().alias("uid")),
        "sets",
    )
    # sets that share a band meet under the smallest of them; a set goes to as many groups as its bands have smallest sets
    banded = sets.select("uid", F.posexplode("bands").alias("at", "band"))
    shared = banded.groupBy("band").agg(F.min("uid").alias("first"), F.max("uid").alias("last")).where("first <> last").select("band", "first")
    met = banded.join(shared, "band").groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("at", "first"))).alias("_firsts"))
    firsts = F.transform("bands", lambda _, i: F.coalesce(F.try_element_at("_firsts", i), F.lit(-1).cast("long")))
    members = written(met.join(sets.select("uid", "text_key", "copies", "n", "bands"), "uid").withColumn("firsts", firsts).drop("_firsts"), "members")
    texts = keyed.select("text_key", "text").dropDuplicates(["text_key"])
    held = members.select("uid", "text_key").join(texts, "text_key").select("uid", "text").mapInPandas(lambda parts: _gram_sets(parts, words), "uid bigint, grams binary")
    held = written(members.drop("text_key", "n").join(held, "uid"), "grams")
    groups = members.select("uid", "n", F.explode(F.array_distinct(F.filter("firsts", lambda f: f >= 0))).alias("first"))
    blocks = F.ceil(F.greatest(F.col("_texts") / BLOCK_TEXTS, F.col("_grams") / BLOCK_GRAMS)).cast("int")
    sized = groups.groupBy("first").agg(F.count("*").alias("_texts"), F.sum("n").alias("_grams")).select("first", blocks.alias("blocks"))
    placed = _meet(groups, sized, "first", "uid").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks").cast("long")).cast("int"))
    dealt = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("uid", "first", "block", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"))
    compared = written(dealt.join(held, "uid").groupBy("first", "low", "high").applyInPandas(lambda group: _compare(group, similarity), _LINKS), "links")
    links = compared.groupBy("uid").agg(F.sum("links").alias("links"))
    classes = components(compared.select(F.col("uid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("uid"), "root")
    known = (
        sets.drop("bands")
        .join(links, "uid", "left")
        .join(classes, "uid", "left")
        .withColumn("root", F.coalesce("root", "uid"))
        .withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    )
    return sketched.select("doc_id", "text_key", "set_key", "n"), written(known, "classes")


def _first_of_class(sets: DataFrame) -> DataFrame:
    return sets.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "text_key")).alias("_first"))


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links, n_grams.

    Two documents are linked when the Jaccard similarity of their sets of word n-grams (lower
    case, runs of letters, digits and _) is at least ``similarity``. ``n_links`` counts the
    documents a document is linked to, copies too; a class is what links connect, named by its
    smallest doc_id. Texts with equal sets are compared once. Sets that share a band meet in
    the group of the smallest set of that band, and there the pairs that share one are compared
    on whole sets, block by block: a group of any size is many tasks, no pair becomes a row, and
    a set goes to no more groups than it has bands, however many unlike ones a chain connects.

    A null text counts as empty; texts without words are linked to equal texts only; fewer
    words than an n-gram make one n-gram. A null doc_id names no class unless all are null;
    repeated rows count as copies. An empty table gives no rows; other columns are ignored.
    """
    rows, sets = _sets_and_links(docs, similarity, recall, words)
    named = sets.join(_first_of_class(sets), "root").select("set_key", F.col("_first.doc_id").alias("class_id"), F.col("links").alias("n_links"))
    return rows.join(named, "set_key").select("doc_id", "class_id", "n_links", F.col("n").alias("n_grams"))


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with all its columns."""
    _, sets = _sets_and_links(docs, similarity, recall, words)
    kept = _first_of_class(sets).select(F.col("_first.doc_id").alias("_keep_id"), F.col("_first.text_key").alias("_keep_text"))
    staying = docs.withColumns({"_kept_id": F.col("doc_id").cast("long"), "_kept_text": F.sha2(F.coalesce("text", F.lit("")), 256)})
    found = staying.join(kept, (staying["_kept_text"] == kept["_keep_text"]) & staying["_kept_id"].eqNullSafe(kept["_keep_id"]), "left_semi")
    return found.dropDuplicates(["_kept_id", "_kept_text"]).drop("_kept_id", "_kept_text")
