"""Exact duplicates: compressed radix tries hold whole texts, and their terminals the owners."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhand.llm.common import written

#: A map task's trie gives its largest subtree to the shuffle beyond so many bytes of text.
TRIE_BYTES = 16 << 20
_PARTIAL = "n_bytes bigint, digest string, body binary, keep_id bigint, n bigint"
_OWNER = "n_bytes bigint, digest string, told bigint, keep_id bigint, n bigint"
#: Hex digits of a text's hash that, with its length, choose the trie it goes to.
HASH_DIGITS = 3
_ROWS = 2048


class Node:
    """A branch of a trie: the bytes that lead to it, and its terminal if a text ends here."""

    __slots__ = ("label", "children", "digest", "keep_id", "n")

    def __init__(self, label: bytes):
        self.label, self.children, self.digest, self.keep_id, self.n = label, {}, "", None, 0


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, halving the span that is compared."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A Patricia trie over byte strings; equal strings share a terminal with their smallest id."""

    def __init__(self):
        self.root, self.held = Node(b""), {}

    def add(self, body: bytes, digest: str, keep_id: int | None, n: int) -> None:
        node, at, size = self.root, 0, len(body)
        while at < size:
            child = node.children.get(body[at])
            if child is None:
                child = node.children[body[at]] = Node(body[at:])
                self.held[body[0]] = self.held.get(body[0], 0) + size - at + 200
            elif not body.startswith(child.label, at):
                cut = _shared(child.label, body[at : at + len(child.label)])
                upper = Node(child.label[:cut])
                child.label = child.label[cut:]
                upper.children[child.label[0]] = child
                node.children[body[at]] = child = upper
            node, at = child, at + len(child.label)
        node.digest, node.n = digest, node.n + n
        if node.keep_id is None or (keep_id is not None and keep_id < node.keep_id):
            node.keep_id = keep_id

    def bytes_held(self) -> int:
        return sum(self.held.values())

    def spill(self) -> Iterator[tuple]:
        """The terminals of the largest subtree, which leaves the trie."""
        first = max(self.held, key=self.held.get)
        del self.held[first]
        yield from terminals(self.root.children.pop(first))


def terminals(node: Node) -> Iterator[tuple]:
    """(whole string, digest, smallest id, count) of every terminal at or below a node."""
    open_nodes = [(b"", node)]
    while open_nodes:
        before, node = open_nodes.pop()
        body = before + node.label
        if node.n:
            yield body, node.digest, node.keep_id, node.n
        open_nodes += [(body, child) for child in node.children.values()]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded bytes."""
    part: list[tuple] = []
    size = 0
    for row in rows:
        part.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(part) >= _ROWS or size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), schema)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), schema)], schema=schema)


_PARTIAL_ARROW = pa.schema([("n_bytes", pa.int64()), ("digest", pa.string()), ("body", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])
_OWNER_ARROW = pa.schema([("n_bytes", pa.int64()), ("digest", pa.string()), ("told", pa.int64()), ("keep_id", pa.int64()), ("n", pa.int64())])


def _own_copies(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of a task, or several where its subtree left the trie between."""

    def rows():
        trie = Trie()
        for batch in batches:
            for doc_id, digest, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                trie.add(body, digest, doc_id, 1)
                if len(body) and trie.held[body[0]] > most // 256 and trie.bytes_held() > most:
                    yield from trie.spill()
        yield from terminals(trie.root)

    yield from _batches(((len(body), digest, body, keep_id, n) for body, digest, keep_id, n in rows()), _PARTIAL_ARROW)


def _owners(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Owners from rows partitioned by length and a hash's first digits: one trie for each such key, of whole strings.

    Its terminals hold the smallest id of each text. A trie that grows beyond ``most`` bytes
    gives its largest subtree away; a text of which more rows come later is then owned twice,
    which the last aggregation settles.
    """

    def rows():
        key, trie = None, Trie()
        for batch in batches:
            for n_bytes, digest, body, keep_id, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if key != (n_bytes, digest[:HASH_DIGITS]):
                    yield from terminals(trie.root)
                    key, trie = (n_bytes, digest[:HASH_DIGITS]), Trie()
                trie.add(body, digest, keep_id, n)
                if n_bytes and trie.held[body[0]] > most // 256 and trie.bytes_held() > most:
                    yield from trie.spill()
        yield from terminals(trie.root)

    told = ((len(body), digest, xxhash.xxh3_64_intdigest(body) - (1 << 63), keep_id, n) for body, digest, keep_id, n in rows())
    yield from _batches(told, _OWNER_ARROW)


def normalised(text: Column) -> Column:
    """A text with each run of blanks and line breaks as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def owners(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """n_bytes, digest, keep_id, group_size for each distinct normalised text.

    Each task first puts its own texts into a trie, so a text with any number of copies leaves
    a task about once. Rows are then partitioned by length and the first digits of their
    SHA-256, and each such partition's whole strings go into one trie, whose terminals own
    them. Texts are told apart by their bytes there, by length and SHA-256 beyond; different
    texts that ever share both would end the job rather than be merged.
    """
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("_norm")).select(
        "doc_id", F.sha2("_norm", 256).alias("digest"), F.encode("_norm", "UTF-8").alias("body")
    )
    partial = hashed.mapInArrow(lambda batches: _own_copies(batches, trie_bytes), _PARTIAL)
    place = F.substring("digest", 1, HASH_DIGITS)
    dealt = partial.repartition("n_bytes", place).sortWithinPartitions("n_bytes", place)
    return _settled(dealt.mapInArrow(lambda batches: _owners(batches, trie_bytes), _OWNER))


def _settled(owned: DataFrame) -> DataFrame:
    """One owner for each length and digest; different texts that share both end the job."""
    settled = owned.groupBy("n_bytes", "digest").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.min("told").alias("_one"), F.max("told").alias("_two")
    )
    different = F.raise_error(F.concat(F.lit("different texts share the digest "), F.col("digest")))
    return settled.select("n_bytes", "digest", "keep_id", F.when(F.col("_one") == F.col("_two"), F.col("group_size")).otherwise(different.cast("long")).alias("group_size"))


def exact_groups(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical with each run of ``[\\x20\\x09-\\x0D]`` as one
    space. The row with the smallest doc_id of a group stays. A null text counts as empty; a
    null doc_id is the largest; of repeated rows with the same doc_id and text one is kept.
    An empty table gives no rows, and other columns are ignored.
    """
    norm = normalised(F.col("text"))
    ids = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(norm).cast("long").alias("n_bytes"), F.sha2(norm, 256).alias("digest"))
        .groupBy("doc_id", "n_bytes", "digest")
        .agg(F.count("*").alias("_copies"))
    )
    # written, so that the join's sides are plain shuffles, of which adaptive execution can split a large group's
    owned = written(owners(docs, trie_bytes), "owners")
    return (
        ids.join(owned, ["n_bytes", "digest"])
        .select("doc_id", "keep_id", "group_size", F.col("digest").alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256")
    )


def without_copies(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The documents that stay, with all their columns; one row of each group of equal texts."""
    key = {"_kept_id": F.col("doc_id").cast("long"), "_kept_digest": F.sha2(normalised(F.col("text")), 256)}
    kept = written(owners(docs, trie_bytes), "owners").select(F.col("keep_id").alias("_keep_id"), F.col("digest").alias("_digest"))
    staying = docs.withColumns(key)
    found = staying.join(kept, (staying["_kept_digest"] == kept["_digest"]) & staying["_kept_id"].eqNullSafe(kept["_keep_id"]), "left_semi")
    return found.dropDuplicates(["_kept_id", "_kept_digest"]).drop(*key)
