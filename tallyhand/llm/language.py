"""Language by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhand.llm.common import written

#: Hash slots that n-grams of all orders share.
SLOTS = 1 << 15
ORDERS = (1, 2, 3)
#: Added to each slot's count.
SMOOTHING = 0.5
#: A matrix of log probabilities up to so many bytes is broadcast; a larger one stays a table that texts are joined with.
MATRIX_BYTES = 256 << 20
#: A text's best language is no longer believed if its n-grams are that many spreads of the training texts, and as many nats, below their median; how many n-grams tell.
SPREADS, MARGIN, ENOUGH = 10.0, 2.0, 200
UNKNOWN = "und"
#: Characters whose n-grams are in memory at once.
_CHARS = 1 << 19
_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: is it a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _slots(points: np.ndarray, order: int) -> np.ndarray:
    """The slot of the n-gram that starts at each point but the last ``order - 1``."""
    n = max(0, len(points) - order + 1)
    mixed = np.full(n, order, np.uint32)
    for i in range(order):
        mixed = (mixed ^ points[i : i + n]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
    return mixed & np.uint32(SLOTS - 1)


def _blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, owner of the n-grams that start there or -1) for texts in blocks of bounded size.

    Texts are in lower case, a space for all that is no letter, and parted by a 0. A text longer
    than a block comes in pieces, each with the next few characters so that no n-gram is lost.
    """
    letters, over = _letters(), max(ORDERS) - 1
    pieces: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(letters[points], points, np.uint32(_SPACE))
        for start in range(0, len(points), _CHARS):
            piece = points[start : start + _CHARS + over]
            owner = np.full(len(piece) + 1, -1, np.int32)
            owner[: min(_CHARS, len(points) - start)] = i
            pieces += [piece, np.zeros(1, np.uint32)]
            owners.append(owner)
            size += len(piece)
            if size >= _CHARS:
                yield np.concatenate(pieces), np.concatenate(owners)
                pieces, owners, size = [], [], 0
    if pieces:
        yield np.concatenate(pieces), np.concatenate(owners)


def _ngrams(points: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, slot) of the n-grams of a block, for each order."""
    for order in ORDERS:
        slots = _slots(points, order)
        whole = owner[: len(slots)] >= 0
        for i in range(1, order):
            whole = whole & (points[i : i + len(slots)] != 0)
        yield owner[: len(slots)][whole], slots[whole]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is a multiple of ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def _count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's own n-gram counts per language and slot."""
    sums: dict[str, np.ndarray] = {}
    for part in parts:
        at: dict[str, int] = {}
        codes = np.array([at.setdefault(name, len(at)) for name in part["lang"]], np.int64)
        names = list(at)
        for points, owner in _blocks(part["text"].tolist()):
            for owners, slots in _ngrams(points, owner):
                both = np.bincount(codes[owners] * SLOTS + slots, minlength=len(names) * SLOTS)
                for name, row in zip(names, both.reshape(len(names), SLOTS)):
                    sums[name] = sums[name] + row if name in sums else row
    for name, row in sums.items():
        used = np.flatnonzero(row)
        yield pd.DataFrame({"lang": name, "slot": used.astype(np.int32), "n": row[used]})


def counts(docs: DataFrame) -> DataFrame:
    """lang, slot, n: n-grams of the whole texts of every row with a language; slot -1 has the rows. Tasks add up their own first."""
    rows = docs.where(F.col("lang").isNotNull()).select("lang", F.coalesce("text", F.lit("")).alias("text"))
    sums = rows.mapInPandas(_count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    return sums.unionByName(rows.groupBy("lang").agg(F.lit(-1).alias("slot"), F.count("*").alias("n")))


def matrix(sums: DataFrame, langs: list[str]) -> np.ndarray:
    """Log probabilities by (slot, language); the last row has log priors. The driver gets the sums in use."""
    at = {name: i for i, name in enumerate(langs)}
    counted = np.zeros((SLOTS + 1, len(langs)))
    held = sums.toPandas()
    counted[held["slot"].to_numpy(int), np.array([at[name] for name in held["lang"]], int)] = held["n"]
    rows, counted = counted[-1], counted[:-1]
    table = np.log((counted + SMOOTHING) / (counted.sum(axis=0) + SMOOTHING * SLOTS))
    return np.vstack([table, np.log(rows / max(1, rows.sum()))[None, :]]).astype(np.float32)


def train(docs: DataFrame, matrix_bytes: int = MATRIX_BYTES) -> tuple[list[str] | None, np.ndarray | DataFrame]:
    """(languages in order, ``matrix``), or (None, ``counts``) where that matrix would be larger than ``matrix_bytes``."""
    sums = written(counts(docs), "ngrams")
    priors = sums.where("slot = -1")
    if priors.count() * (SLOTS + 1) * 4 > matrix_bytes:
        return None, sums
    langs = sorted(r["lang"] for r in priors.select("lang").collect())
    return langs, matrix(sums, langs)


def posterior(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log joint probability by (text, language), whether a text has a letter, and how many n-grams.

    The n-grams of a batch are a sparse matrix in order of texts; its product with the log
    probabilities is a gather and a sum over each text's run.
    """
    table, prior = weights[:-1], weights[-1].astype(float)
    sums, seen, n = np.tile(prior, (len(texts), 1)), np.zeros(len(texts), bool), np.zeros(len(texts), np.int64)
    for points, owner in _blocks(texts):
        seen[owner[(owner >= 0) & (points != _SPACE)]] = True
        for owners, slots in _ngrams(points, owner):
            if len(owners):
                starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
                sums[owners[starts]] += np.add.reduceat(table[slots], starts, axis=0, dtype=float)
                n[owners[starts]] += np.diff(np.r_[starts, len(owners)])
    return sums, seen, n


def predict(docs: DataFrame, model: tuple[list[str] | None, np.ndarray | DataFrame]) -> DataFrame:
    """``docs`` with three more columns: _lang (a learned language or 'und'), _score (its posterior) and _mean.

    _mean is the mean log probability of the text's n-grams in that language, null for 'und'.
    Only the text is looked at. A null text or one without letters is 'und' with score 0, and
    so is every text when nothing was learned. Repeated rows and all other columns stay.
    """
    langs, table = model
    if langs is None:
        return _predict_by_join(docs, table)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = np.array([*langs, UNKNOWN], dtype=object)

    @F.pandas_udf("lang string, score double, mean double")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part.fillna("").tolist()
            mean = np.full(len(texts), np.nan)
            if langs:
                sums, known, n = posterior(texts, shared.value)
                top = np.where(known, sums.argmax(axis=1), len(langs))
                best = sums.max(axis=1)
                score = np.where(known, 1 / np.exp(sums - best[:, None]).sum(axis=1), 0.0)
                prior = shared.value[-1].astype(float)
                mean[known] = (best - prior[sums.argmax(axis=1)])[known] / n[known]
            else:
                top, score = np.zeros(len(texts), int), np.zeros(len(texts))
            yield pd.DataFrame({"lang": names[top], "score": score, "mean": mean})

    found = docs.withColumn("_told", told(F.col("text")))
    mean = F.col("_told.mean")
    return found.select(*docs.columns, F.col("_told.lang").alias("_lang"), F.col("_told.score").alias("_score"), F.when(~F.isnan(mean), mean).alias("_mean"))


def _slot_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(row, slot, n) of each text with a letter."""
    for part in parts:
        ids, seen = part["row"].to_numpy(), np.zeros(len(part), bool)
        made: list[pd.DataFrame] = []
        for points, owner in _blocks(part["text"].tolist()):
            seen[owner[(owner >= 0) & (points != _SPACE)]] = True
            for owners, slots in _ngrams(points, owner):
                keys, n = np.unique(owners.astype(np.int64) * SLOTS + slots, return_counts=True)
                made.append(pd.DataFrame({"row": keys // SLOTS, "slot": (keys % SLOTS).astype(np.int32), "n": n}))
        if made:
            found = pd.concat(made)
            found = found[seen[found["row"].to_numpy()]]
            found["row"] = ids[found["row"].to_numpy()]
            yield found


def _predict_by_join(docs: DataFrame, sums: DataFrame) -> DataFrame:
    """``predict`` where the matrix is a table: a text's slots are joined with what was counted there.

    A language that never counted a slot has the same log probability in it as in any other such
    slot, so a text's sum is that times its n-grams, and a difference for each slot that was counted.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "texts")
    slots = rows.select(F.col("_row").alias("row"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_slot_counts, "row bigint, slot int, n bigint")
    slots = written(slots.groupBy("row", "slot").agg(F.sum("n").alias("n")), "slots")
    totals = sums.groupBy("lang").agg(F.sum(F.when(F.col("slot") >= 0, F.col("n")).otherwise(0)).alias("_all"), F.sum(F.when(F.col("slot") < 0, F.col("n")).otherwise(0)).alias("_rows"))
    bottom = F.log(F.col("_all") + SMOOTHING * SLOTS)
    langs = totals.select("lang", "_rows", (F.lit(float(np.log(SMOOTHING))) - bottom).alias("_none"))
    learned = sums.where("slot >= 0").select("lang", "slot", (F.log(F.col("n") + SMOOTHING) - float(np.log(SMOOTHING))).alias("_more"))
    more = slots.join(learned, "slot").groupBy("row", "lang").agg(F.sum(F.col("n") * F.col("_more")).alias("_more"))
    held = slots.groupBy("row").agg(F.sum("n").alias("_n"))
    whole = langs.agg(F.sum("_rows")).first()[0]
    prior = F.log(F.col("_rows") / F.lit(float(whole or 1)))
    # a language without any of a text's slots is further off than each that has one
    joint = more.join(held, "row").join(langs, "lang").select("row", "lang", "_n", prior.alias("_prior"), (prior + F.col("_n") * F.col("_none") + F.col("_more")).alias("_sum"))
    best = joint.groupBy("row").agg(F.max(F.struct("_sum", "lang", "_prior", "_n")).alias("_best"))
    odds = joint.join(best, "row").groupBy("row").agg(F.first("_best").alias("_best"), F.sum(F.exp(F.col("_sum") - F.col("_best._sum"))).alias("_odds"))
    told = odds.select(F.col("row").alias("_row"), F.col("_best.lang").alias("_lang"), (1 / F.col("_odds")).alias("_score"), ((F.col("_best._sum") - F.col("_best._prior")) / F.col("_best._n")).alias("_mean"))
    joined = rows.join(told, "_row", "left")
    return joined.select(*docs.columns, F.coalesce("_lang", F.lit(UNKNOWN)).alias("_lang"), F.coalesce("_score", F.lit(0.0)).alias("_score"), "_mean")


def languages(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score.

    The model learns from the rows that are not held out and have a language; see ``predict``
    for texts without letters. An empty table gives no rows; other columns are ignored.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).select(
        "doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )


def with_known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is told with at least ``least`` posterior and that read like its texts, as they came.

    Posteriors saturate, so the best of the learned languages is also held against its own
    training texts: a document goes if its n-grams are on average less likely than the median of
    those by ``MARGIN`` and ``SPREADS`` times the distance from median to lower quartile, which a
    few odd training texts do not move. Texts of fewer than ``ENOUGH`` n-grams are too short.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    told = written(predict(docs, model), "told")
    long = F.length("text") * len(ORDERS) >= ENOUGH
    floors = (
        told.where(~held_out(F.col("doc_id")) & (F.col("lang") == F.col("_lang")) & long)
        .groupBy(F.col("_lang").alias("_of"))
        .agg(F.percentile_approx("_mean", [0.25, 0.5], 10_000).alias("_q"))
        .select("_of", (F.get("_q", F.lit(1)) - MARGIN - SPREADS * (F.get("_q", F.lit(1)) - F.get("_q", F.lit(0)))).alias("_floor"))
    )
    known = told.where((F.col("_lang") != UNKNOWN) & (F.col("_score") >= least))
    if model[0] is None:
        judged = known.join(floors, known["_lang"] == floors["_of"], "left")
    else:  # one number for each language of the matrix; texts need not move to meet it
        cells = [F.lit(x) for r in floors.collect() for x in (r["_of"], r["_floor"])]
        judged = known.withColumn("_floor", F.create_map(*cells)[F.col("_lang")] if cells else F.lit(None).cast("double"))
    return judged.where(F.col("_floor").isNull() | ~long | (F.col("_mean") >= F.col("_floor"))).select(*docs.columns)
