"""The trie of conversation prefixes: a count-min sketch proves single ones, and only the others are grouped.

A prefix is known by 128 bits: the exclusive or of hashes of its turns, each hashed with its
place. So digests of prefixes are running values like sums, which are found block by block, and
a conversation of any length is many tasks. The root's digest is 0.

A node is named by its smallest member. A member is the smallest of its nodes from some depth on
(its entry) down to its end or to where a smaller one is beside it, so the trie is also a tree of
conversations, each with one entry: sums over a subtree are sums over its members, of what each
holds where it is the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhand.llm.common import written

#: Turns, depths and ids are taken in blocks of 2 to this power, whose running values are found together.
BLOCK_BITS = 12
#: Rows of the sketch, and the most cells of each as a power of two: 8 MB of bits in all are sent to the executors.
SKETCH_ROWS, MOST_BITS = 4, 24
#: Cells that are merged together, as a power of two.
_PIECE_BITS = 14
#: Conversations whose number is alike in all but the last of so many share their beginnings with the first of them.
FAMILY = 20
_EMPTY = sha256(b"").hexdigest()
_HEAD, _NULL = -(1 << 61), -(1 << 60)
_KEY = ["depth", "k1", "k2"]


def block(number: Column) -> Column:
    return F.shiftright(number, BLOCK_BITS)


def _before(totals: DataFrame, by: str, at: str, name: str, of: Column) -> Column:
    """What ``of`` gathers over the earlier blocks of each ``by``; it runs over one row a block."""
    return of.over(Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)).alias(name)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, block, turn, said (a hash of role and text), words of the text; rows without a conversation belong to none."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turn = F.col("turn").cast("long")
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(block(turn), F.lit(_NULL)).alias("block"),
        turn.alias("turn"),
        said.alias("said"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def rebuilt(held: DataFrame, forked: bool = True) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, block, depth, length, said, words) from ``turns``.

    ``forked`` puts the first turns of the first of its ``FAMILY`` in the place of a
    conversation's own: as many as its id's CRC-32 modulo 4, or all there are.
    """
    totals = held.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    blocks = totals.select("conv_id", "block", "n", F.coalesce(_before(totals, "conv_id", "block", "earlier", F.sum("n")), F.lit(0)).alias("earlier"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    cut = F.crc32(F.col("conv_id").cast("string")) % 4 if forked else F.lit(0).cast("long")
    convs = totals.groupBy("conv_id").agg(F.sum("n").alias("n_own")).withColumns({"base": base, "cut": cut})
    inside = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "said")
    across = Window.partitionBy("conv_id").orderBy("block", "nth")
    first = held.where(F.col("conv_id") % FAMILY == 0).withColumn("nth", F.row_number().over(inside)).where("nth <= 3")
    first = first.withColumn("depth", F.row_number().over(across).cast("long")).where("depth <= 3")
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("depth", "said", "words"))).alias("head"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.least(F.col("cut"), F.lit(3)).cast("int")))
    convs = convs.withColumn("put", F.size("head").cast("long"))
    convs = convs.withColumn("length", F.col("put") + F.greatest(F.lit(0), F.col("n_own") - F.col("cut")))
    convs = written(convs.select("conv_id", "cut", "put", "length", "head"), "conversations")
    placed = held.withColumn("nth", F.row_number().over(inside)).join(blocks.join(convs.drop("head"), "conv_id").drop("n"), ["conv_id", "block"])
    own = placed.withColumn("own", F.col("earlier") + F.col("nth")).where("own > cut")
    own = own.select("conv_id", "block", (F.col("put") + F.col("own") - F.col("cut")).alias("depth"), "length", "said", "words")
    begun = convs.select("conv_id", F.lit(_HEAD).alias("block"), "length", F.explode("head").alias("h")).select("conv_id", "block", "h.depth", "length", "h.said", "h.words")
    return convs.select("conv_id", "length"), begun.unionByName(own)


def prefixes(path: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2 (the prefix), p1, p2 (the prefix before), words, last for each turn of each conversation."""
    tagged = path.select(
        "conv_id", "block", "depth", "words", (F.col("depth") == F.col("length")).alias("last"),
        F.xxhash64("depth", "said").alias("t1"), F.xxhash64("said", F.lit(1), "depth").alias("t2"),
    )
    held = written(tagged, "turns")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = held.groupBy("conv_id", "block").agg(*[F.bit_xor(t).alias(t) for t in ("t1", "t2")])
    carried = totals.select("conv_id", "block", *[_before(totals, "conv_id", "block", f"c{t[1]}", F.bit_xor(t)) for t in ("t1", "t2")])
    local = held.withColumns({f"k{i}": F.bit_xor(f"t{i}").over(inside) for i in (1, 2)})
    keys = {f"k{i}": F.col(f"k{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long"))) for i in (1, 2)}
    whole = local.join(carried, ["conv_id", "block"]).withColumns(keys)
    return whole.select("conv_id", "depth", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"t{i}")).alias(f"p{i}") for i in (1, 2)], "words", "last")


def cells(one: np.ndarray, two: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each digest in a row of the sketch."""
    mixed = one.astype(np.uint64) + np.uint64(row) * (two.astype(np.uint64) | np.uint64(1))
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def sketch(digests: DataFrame, bits: int) -> np.ndarray:
    """Count-min over k1 and k2 as bits: which cells of each row were hit more than once.

    A task counts up to 2 in each cell and gives the pieces of the sketch that it touched;
    pieces are added up in a stream, so a task holds one sketch, and the driver its bits:
    ``SKETCH_ROWS`` times 2 to the ``bits``, whatever the input.
    """
    piece = 1 << min(bits, _PIECE_BITS)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((SKETCH_ROWS, 1 << bits), np.uint8)
        for part in parts:
            for row in range(SKETCH_ROWS):
                hit, n = np.unique(cells(part["k1"].to_numpy(), part["k2"].to_numpy(), row, bits), return_counts=True)
                counts[row, hit] = np.minimum(counts[row, hit] + n, 2)
        for i, made in enumerate(counts.reshape(-1, piece)):
            if made.any():
                yield pd.DataFrame({"piece": [i], "counts": [made.tobytes()]})

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = -1, None
        for part in parts:
            for i, made in zip(part["piece"], part["counts"]):
                counts = np.frombuffer(made, np.uint8)
                if i == at:
                    total = np.minimum(total + counts, 2)
                    continue
                if at >= 0:
                    yield pd.DataFrame({"piece": [at], "twice": [np.packbits(total == 2).tobytes()]})
                at, total = i, counts
        if at >= 0:
            yield pd.DataFrame({"piece": [at], "twice": [np.packbits(total == 2).tobytes()]})

    pieces = digests.select("k1", "k2").mapInPandas(count, "piece int, counts binary").repartition("piece").sortWithinPartitions("piece")
    twice = np.zeros((SKETCH_ROWS << bits) // 8, np.uint8).reshape(-1, max(1, piece // 8))
    for r in pieces.mapInPandas(add, "piece int, twice binary").toLocalIterator():
        twice[r["piece"]] = np.frombuffer(r["twice"], np.uint8)
    return twice.reshape(SKETCH_ROWS, -1)


def maybe_shared(held: Broadcast, bits: int, one: str, two: str) -> Column:
    """Whether the sketch's estimate of a digest is above one: its least cell was hit more than once."""

    @F.pandas_udf("boolean")
    def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
        twice = held.value
        found = np.ones(len(a), bool)
        for row in range(SKETCH_ROWS):
            at = cells(a.to_numpy(), b.to_numpy(), row, bits)
            found &= (twice[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return pd.Series(found)

    return estimate(one, two)


def _digest_of_ids(ends: DataFrame) -> DataFrame:
    """ends_sha256 for each key of (depth, k1, k2, conv_id): ids in order are joined block by block, and the blocks hashed in a stream."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = ends.groupBy(*_KEY, block(F.col("conv_id")).alias("ids")).agg(ids.alias("joined"))

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, hashed = None, None
        for part in parts:
            made = []
            for depth, k1, k2, joined in zip(part["depth"].tolist(), part["k1"].tolist(), part["k2"].tolist(), part["joined"]):
                if at == (depth, k1, k2):
                    hashed.update(b"," + joined.encode())
                    continue
                if at is not None:
                    made.append((*at, hashed.hexdigest()))
                at, hashed = (depth, k1, k2), sha256(joined.encode())
            yield pd.DataFrame(made, columns=[*_KEY, "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, hashed.hexdigest())], columns=[*_KEY, "ends_sha256"])

    ordered = blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "ids")
    return ordered.mapInPandas(stream, "depth long, k1 long, k2 long, ends_sha256 string")


def _by_block(facts: DataFrame) -> DataFrame:
    """One row for each block of depths of each conversation, to be joined on both: a long conversation is no single key."""
    return facts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block(F.col("length")))))


def trie(convs: DataFrame, path: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One row for each distinct prefix, from the root on: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` has conv_id and length, ``path`` the turns as ``rebuilt`` gives them. Prefixes
    that the sketch proves single are nodes as they are: their turns aren't shuffled again but
    for their one entry. The others are grouped by their digests, counted with map-side sums,
    so a prefix of all conversations sends one row from each task. A sketch of too few cells
    proves less; the rows are the same.
    """
    spark = path.sparkSession
    held = written(prefixes(path), "prefixes")
    bits = max(8, min(most_bits, (4 * held.count()).bit_length()))
    seen = spark.sparkContext.broadcast(sketch(held, bits))
    told = held.withColumn("shared", maybe_shared(seen, bits, "k1", "k2"))
    shared = written(told.where("shared").drop("shared"), "shared")
    tails = told.where("not shared").drop("shared")

    long0 = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count(F.when(F.col("length") == 0, 1)).alias("n_ends"), F.min(F.when(F.col("length") == 0, F.col("conv_id"))).alias("first_end"))
    root = root.where("n_convs > 0").select(long0.alias("depth"), long0.alias("k1"), long0.alias("k2"), *[F.lit(None).cast("long").alias(p) for p in ("p1", "p2")], "conv_id", "n_convs", "n_ends", "first_end", long0.alias("words"))
    groups = shared.groupBy(*_KEY).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.count(F.when(F.col("last"), 1)).alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("first_end"), F.min("words").alias("words"),
    )
    groups = written(root.unionByName(groups).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "groups")

    # Of each conversation that is a node's smallest member: its entry, what its nodes save, and whether it ends in a leaf.
    entry = F.struct("depth", "p1", "p2")
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    enters = maybe_shared(seen, bits, "p1", "p2") | (F.col("depth") == 1)
    facts = (
        groups.select("conv_id", entry.alias("entry"), "saved", leaf.alias("leaf"))
        .unionByName(tails.where(enters).select("conv_id", entry.alias("entry"), long0.alias("saved"), long0.alias("leaf")))
        .unionByName(tails.where("last").select("conv_id", F.lit(None).cast("struct<depth:bigint,p1:bigint,p2:bigint>").alias("entry"), long0.alias("saved"), F.lit(1).cast("long").alias("leaf")))
        .groupBy("conv_id")
        .agg(F.min("entry").alias("entry"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
        .select("conv_id", "entry.*", "saved", "leaf")
    )
    # The root has the most children: its row is dealt out, and they go to one copy each.
    salt = F.when(F.col("depth") == 1, F.pmod("conv_id", F.lit(64))).otherwise(0)
    parents = groups.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    parents = parents.withColumn("salt", F.explode(F.when(F.col("depth") == 1, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))))
    entered = facts.withColumn("salt", salt.cast("int")).join(parents, ["depth", "p1", "p2", "salt"], "left")
    facts = written(entered.join(convs, "conv_id").select("conv_id", "length", F.col("depth").alias("entry"), "p1", "p2", "parent", "saved", "leaf"), "facts")

    # Sums over the members of each shared prefix, and its children: its smallest member's next one, and all that enter there.
    zero = {c: long0 for c in ("n_children", "n_leaves", "saved_tokens")}
    own = _by_block(facts.where("saved > 0 or leaf > 0").select("conv_id", "length", "saved", "leaf"))
    members = shared.select("conv_id", *_KEY, block(F.col("depth")).alias("block")).join(own, ["conv_id", "block"])
    under = members.select(*_KEY, long0.alias("n_children"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    under_root = facts.select(long0.alias("depth"), long0.alias("k1"), long0.alias("k2"), long0.alias("n_children"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    entering = facts.where("entry > 0").select((F.col("entry") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).cast("long").alias("n_children"), zero["n_leaves"].alias("n_leaves"), zero["saved_tokens"].alias("saved_tokens"))
    ended = F.col("conv_id").eqNullSafe(F.col("first_end"))
    going_on = groups.select(*_KEY, F.when(ended, 0).otherwise(1).cast("long").alias("n_children"), long0.alias("n_leaves"), long0.alias("saved_tokens"))
    sums = under.unionByName(under_root).unionByName(entering).unionByName(going_on).groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in zero])
    ends = shared.where("last").select(*_KEY, "conv_id").unionByName(convs.where("length = 0").select(long0.alias("depth"), long0.alias("k1"), long0.alias("k2"), "conv_id"))

    # A subtree saves what its members do, but for what the smallest one saves above it.
    above = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    spread = groups.select(*_KEY, "conv_id", "n_convs", "saved", block(F.col("depth")).alias("block"))
    totals = spread.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"))
    carried = totals.select("conv_id", "block", _before(totals, "conv_id", "block", "higher", F.sum("saved")))
    zeroed = F.coalesce(F.sum("saved").over(above), long0) + F.coalesce("higher", long0)
    inner = spread.join(carried, ["conv_id", "block"]).withColumn("above", zeroed)
    inner = inner.join(sums, _KEY).join(_digest_of_ids(ends), _KEY, "left")
    inner = inner.select("conv_id", "depth", "n_convs", "n_children", "n_leaves", (F.col("saved_tokens") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    alone = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(_EMPTY)
    one = F.lit(1).cast("long")
    single = tails.select("conv_id", "depth", one.alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), long0.alias("saved_tokens"), alone.alias("ends_sha256"))
    nodes = inner.unionByName(single).withColumn("block", block(F.col("depth")))
    named = nodes.join(_by_block(facts.select("conv_id", "length", "entry", "parent")), ["conv_id", "block"])
    parent = F.when(F.col("depth") == F.col("entry"), F.col("parent")).otherwise(F.col("conv_id"))
    return named.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, forked: bool = True) -> DataFrame:
    """``trie`` of the conversations in a table of conv_id, turn, role, text, rebuilt as ``rebuilt`` says if ``forked``.

    Turns go by number, null first, and those of one number by a hash of what is said, so
    repeated rows are turns of their own. Null roles and texts count as empty; rows without a
    conv_id belong to no conversation; a conversation that is rebuilt without a turn ends at
    the root; an empty table has no root; other columns are ignored. No task holds a
    conversation or a group: windows and sums run in blocks and spill.
    """
    held = written(turns(conversations), "said")
    return trie(*rebuilt(held, forked))
