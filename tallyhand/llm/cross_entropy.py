"""Cross-entropy difference between a target and a background n-gram model.

``exact_cross_entropy_difference`` counts n-grams themselves; ``cross_entropy_difference`` hashes
them into a fixed number of slots, which is for small inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhand.llm.common import written

#: Slots of the shared vocabulary: n-grams of all orders are hashed to them, so both models have this size at any scale.
SLOTS = 1 << 21
#: Longest n-gram; a token is one character of the lower-case text.
ORDER = 4
#: Weight of the shorter context when the longer one has few counts.
BACKOFF = 8.0
#: The share of a character before any count, the same in both models.
UNSEEN = 1 / 4096
#: Characters of the documents that are counted together, and that ask for their n-grams' counts together.
BLOCK_CHARS = 1 << 22
_TOKENS = 1 << 19
_BEGIN = 0x110000
#: Stands where a shorter n-gram has no character.
_ABSENT = 0x1FFFFF
#: Codes up to this are numbered by a table, others by sorting.
_TABLE = 1 << 25


def _blocks(texts: Iterator[str], tokens: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(points, number of each text's tokens) for runs of texts; a text begins with ``ORDER - 1`` marks.

    A text longer than a block comes in pieces; a later piece begins with the last characters
    of the one before instead of the marks.
    """
    over, tokens = ORDER - 1, tokens or _TOKENS
    points: list[np.ndarray] = []
    sizes: list[int] = []
    size = 0
    for text in texts:
        own = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        own = np.concatenate([np.full(over, _BEGIN, np.uint32), own])
        for start in range(over, max(len(own), over + 1), tokens):
            piece = own[start - over : start + tokens]
            points.append(piece)
            sizes.append(len(piece) - over)
            size += len(piece)
            if size >= tokens:
                yield np.concatenate(points), np.array(sizes)
                points, sizes, size = [], [], 0
    if points:
        yield np.concatenate(points), np.array(sizes)


def _slots(points: np.ndarray) -> list[np.ndarray]:
    """For each order, the slot of the n-gram that ends at each point."""
    found, mixed = [], np.zeros(len(points), np.uint32)
    for order in range(ORDER):
        mixed = mixed.copy()
        mixed[order:] = (mixed[order:] ^ points[: len(points) - order]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        mixed += np.uint32(order)
        found.append((mixed & np.uint32(SLOTS - 1)).astype(np.int64))
    return found


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of a block are, and where each text's tokens begin among them."""
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    held = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return np.repeat(starts - held, sizes) + np.arange(sizes.sum()), held


def _lower(texts: pd.Series) -> list[str]:
    return [t.lower() for t in texts.fillna("")]


def _count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's own counts by slot: of target texts, and of all texts."""
    sums = {True: np.zeros(SLOTS, np.int64), False: np.zeros(SLOTS, np.int64)}
    for part in parts:
        for target in (True, False):
            for points, sizes in _blocks(iter(_lower(part["text"][part["target"] == target]))):
                places, _ = _places(sizes)
                begins = np.cumsum(sizes + ORDER - 1) - sizes - 1  # the last mark: contexts of first tokens
                for order, slots in enumerate(_slots(points), 1):
                    sums[target] += np.bincount(slots[places], minlength=SLOTS)
                    if order < ORDER:
                        sums[target] += np.bincount(slots[begins], minlength=SLOTS)
    both = sums[True] + sums[False]
    used = np.flatnonzero(both)
    yield pd.DataFrame({"slot": used.astype(np.int32), "target": sums[True][used], "background": both[used]})


def train(docs: DataFrame) -> np.ndarray:
    """Counts (2, SLOTS) of the target and the background model.

    ``docs`` has text and target (boolean). The background model counts every text, the target
    model those marked; slots, orders and smoothing are the same in both. Tasks sum up their
    own texts, sums meet by slot, and the driver gets at most SLOTS rows whatever the input.
    """
    rows = docs.select("text", F.coalesce("target", F.lit(False)).alias("target"))
    sums = rows.mapInPandas(_count, "slot int, target bigint, background bigint").groupBy("slot").agg(F.sum("target").alias("t"), F.sum("background").alias("b")).toPandas()
    counts = np.zeros((2, SLOTS), np.float32)
    slots = sums["slot"].to_numpy(int)
    counts[0, slots], counts[1, slots] = sums["t"], sums["b"]
    return counts


def losses(texts: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and its summed loss under each model."""
    pieces, n, sums = [], np.zeros(len(texts), np.int64), np.zeros((len(texts), 2))
    for i, text in enumerate(texts):
        pieces += [i] * max(1, -(-len(text) // _TOKENS))
    owners, at = np.array(pieces, int), 0
    totals = [max(1.0, float(c.sum())) / ORDER for c in counts]
    for points, sizes in _blocks(iter(texts)):
        own = owners[at : at + len(sizes)]
        at += len(sizes)
        np.add.at(n, own, sizes)
        places, held = _places(sizes)
        if not len(places):
            continue
        slots = _slots(points)
        some = sizes > 0
        for m, total in enumerate(totals):
            share, context = np.full(len(places), UNSEEN, np.float32), np.float32(total)
            for order in range(ORDER):
                if order:
                    context = counts[m][slots[order - 1][places - 1]]
                share = (counts[m][slots[order][places]] + np.float32(BACKOFF) * share) / (context + np.float32(BACKOFF))
            np.add.at(sums[:, m], own[some], np.add.reduceat(-np.log(share), held[some], dtype=float))
    return n, sums


def _scores(scored: DataFrame) -> DataFrame:
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_tokens",
        F.when(F.col("n_tokens") > 0, F.col("target_loss")).alias("target_loss"),
        F.when(F.col("n_tokens") > 0, F.col("background_loss")).alias("background_loss"),
        F.when(F.col("n_tokens") > 0, F.col("target_loss") - F.col("background_loss")).alias("score"),
    )


def score(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means per token), score: target less background.

    The lower the score, the more a text is like the target. A null or empty text has no
    tokens and null losses; repeated rows are scored each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def told(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n, sums = losses(_lower(part["text"]), shared.value)
            mean = np.divide(sums, n[:, None], out=np.full(sums.shape, np.nan), where=n[:, None] > 0)
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": n, "target_loss": mean[:, 0], "background_loss": mean[:, 1]})

    # ids as text: pandas would turn long ones beside a null into floats
    scored = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(told, "doc_id string, n_tokens bigint, target_loss double, background_loss double")
    return _scores(scored)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` with all documents as background and those labelled good and not toxic as target.

    A doc_id with several labels is a target if one of them says so. Without any target the
    target model is the uniform one. An empty table gives no rows. Labels grow with the
    documents, so the join sorts both sides by doc_id at every size.
    """
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id").distinct().withColumn("target", F.lit(True))
    return score(docs, train(docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left")))


def _numbered(codes: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes below ``bound`` as numbers without gaps, and the code of each number."""
    if bound > _TABLE:
        known, numbers = np.unique(codes, return_inverse=True)
        return numbers, known
    used = np.zeros(bound, bool)
    used[codes] = True
    return (np.cumsum(used, dtype=np.int32) - 1)[codes], np.flatnonzero(used)


def _grams(points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the number of the n-gram that ends at each point; by number, its two key columns, and the number of it without its last character."""
    numbers, alphabet = _numbered(points, _BEGIN + 1)
    first, width = numbers, len(alphabet)
    chars = [alphabet.astype(np.int64)]
    found = []
    before = np.zeros(width, np.int64)
    for order in range(1, ORDER + 1):
        if order > 1:
            codes = first.astype(np.int64)
            codes[1:] += numbers[:-1].astype(np.int64) * width
            numbers, known = _numbered(codes, len(chars[0]) * width)
            before = known // width
            chars = [*(c[before] for c in chars), alphabet[known % width].astype(np.int64)]
        c = [np.full(len(chars[0]), _ABSENT, np.int64)] * (ORDER - order) + chars
        found.append((numbers, c[0] << 21 | c[1], c[2] << 21 | c[3], before))
    return found


def _block_counts(block: int, texts: list[str], target: list[bool]) -> Iterator[pd.DataFrame]:
    """Counts of a block's distinct n-grams of all orders; a longer text gives its own in pieces."""
    marked = np.repeat(target, [max(1, -(-len(t) // BLOCK_CHARS)) for t in texts])
    at = 0
    for points, sizes in _blocks(iter(texts), BLOCK_CHARS):
        own = marked[at : at + len(sizes)]
        at += len(sizes)
        places, _ = _places(sizes)
        of_target = np.repeat(own, sizes)
        begins = np.cumsum(sizes + ORDER - 1) - sizes - 1  # the last mark: contexts of first tokens
        is_begin = points[begins] == _BEGIN  # else the piece goes on with a text whose context is counted
        for order, (numbers, high, low, _) in enumerate(_grams(points), 1):
            ends = numbers[places]
            sums = [np.bincount(ends[of_target], minlength=len(high)), np.bincount(ends, minlength=len(high))]
            if order < ORDER:
                sums[0] += np.bincount(numbers[begins[is_begin & own]], minlength=len(high))
                sums[1] += np.bincount(numbers[begins[is_begin]], minlength=len(high))
            used = sums[1] > 0
            yield pd.DataFrame({"block": block, "high": high[used], "low": low[used], "target": sums[0][used], "background": sums[1][used]})


def _with_blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's documents with the number of their block."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for part in parts:
        own = []
        for text in part["text"]:
            if size and size + len(text) > BLOCK_CHARS:
                block, size = block + 1, 0
            size += len(text)
            own.append(block)
        yield part.assign(block=np.array(own, np.int64))


def _count_exact(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_block_counts`` of a task's blocks, which lie one after the other."""
    block, texts, target = None, [], []
    for part in parts:
        for own, text, good in zip(part["block"], _lower(part["text"]), part["target"]):
            if own != block and texts:
                yield from _block_counts(block, texts, target)
                texts, target = [], []
            block = own
            texts.append(text)
            target.append(bool(good))
    if texts:
        yield from _block_counts(block, texts, target)


def exact_losses(texts: list[str], model: pd.DataFrame, totals: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and its summed loss under each model, from the counts of all n-grams that the texts have."""
    highs, high = np.unique(model["high"].to_numpy(), return_inverse=True)
    lows, low = np.unique(model["low"].to_numpy(), return_inverse=True)
    keys = high * len(lows) + low
    order = np.argsort(keys)
    keys, held = keys[order], [model[c].to_numpy(float)[order] for c in ("target", "background")]

    def looked_up(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        i, j = (np.minimum(np.searchsorted(known, x), len(known) - 1) for known, x in ((highs, high), (lows, low)))
        at = np.minimum(np.searchsorted(keys, i * len(lows) + j), len(keys) - 1)
        there = (highs[i] == high) & (lows[j] == low) & (keys[at] == i * len(lows) + j)
        return [np.where(there, h[at], 0.0) for h in held]

    owners = np.repeat(np.arange(len(texts)), [max(1, -(-len(t) // BLOCK_CHARS)) for t in texts])
    n, sums, at = np.zeros(len(texts), np.int64), np.zeros((len(texts), 2)), 0
    for points, sizes in _blocks(iter(texts), BLOCK_CHARS):
        own = owners[at : at + len(sizes)]
        at += len(sizes)
        np.add.at(n, own, sizes)
        places, starts = _places(sizes)
        if not len(places):
            continue
        some = sizes > 0
        shares, contexts = [UNSEEN, UNSEEN], [np.full(1, t) for t in totals]
        shorter = None
        for numbers, high, low, before in _grams(points):
            counts = looked_up(high, low)
            if shorter is not None:
                suffix = np.zeros(len(high), np.int64)
                suffix[numbers] = shorter
                shares = [s[suffix] for s in shares]
            shorter = numbers
            for m in range(2):
                context = contexts[m][before if len(contexts[m]) > 1 else 0]
                shares[m] = (counts[m] + BACKOFF * shares[m]) / (context + BACKOFF)
            contexts = counts
        for m in range(2):
            np.add.at(sums[:, m], own[some], np.add.reduceat(-np.log(shares[m])[numbers[places]], starts[some]))
    return n, sums


def exact_cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """As ``cross_entropy_difference``, from exact counts of n-grams: no two share a counter, and their number grows with the texts.

    Documents are written in blocks of ``BLOCK_CHARS``. Each block counts its distinct n-grams,
    the counts meet by n-gram, and a join on the n-gram gives each block those it has;
    then the blocks' documents are scored beside them. The driver gets two sums.
    """
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id").distinct().withColumn("target", F.lit(True))
    marked = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left")
    # ids as text: pandas would turn long ones beside a null into floats
    given = marked.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("target", F.lit(False)).alias("target"))
    blocks = written(given.mapInPandas(_with_blocks, "doc_id string, text string, target boolean, block long"), "lm-blocks")
    grams = written(blocks.mapInPandas(_count_exact, "block long, high long, low long, target long, background long"), "lm-grams")
    model = grams.groupBy("high", "low").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    sums = grams.agg(F.sum("target"), F.sum("background")).first()
    totals = tuple(max(1.0, float(s or 0)) / ORDER for s in sums)
    asked = grams.select("block", "high", "low").join(model.hint("merge"), ["high", "low"])

    def told(held: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        n, sums = exact_losses(_lower(held["text"]), counts, totals)
        mean = np.divide(sums, n[:, None], out=np.full(sums.shape, np.nan), where=n[:, None] > 0)
        return pd.DataFrame({"doc_id": held["doc_id"], "n_tokens": n, "target_loss": mean[:, 0], "background_loss": mean[:, 1]})

    paired = blocks.select("block", "doc_id", "text").groupBy("block").cogroup(asked.groupBy("block"))
    return _scores(paired.applyInPandas(told, "doc_id string, n_tokens bigint, target_loss double, background_loss double"))
