"""Fill-in-middle: each batch of texts is cut, dealt out and joined again by Arrow kernels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the hash of a document begins with, before its id.
SEED = "42:"
#: Of a hundred documents so many are rearranged, and of a hundred of those so many begin with the suffix.
REARRANGED, SUFFIX_FIRST = 50, 80
#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Bytes of text whose units are in memory at a time; one text is never parted.
SLICE_BYTES = 8 << 20

_BLANKS, _WORDS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _starts(counts: np.ndarray) -> np.ndarray:
    """Where each list begins when lists of so many values follow one another, and where the last one ends."""
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int32)


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The units of all texts in order, the row that each is from, and its ordinal there.

    A text is blank runs and words in turn, so that the text split at its words is its blank
    runs (the first and the last maybe empty), one more than there are words, and the text
    split at its blank runs is its words. A unit is a blank run with the word that follows.
    """
    blanks = pc.split_pattern_regex(texts, _WORDS)
    words = pc.split_pattern_regex(texts, _BLANKS)
    word_row, word = pc.list_parent_indices(words), pc.list_flatten(words)
    real = pc.greater(pc.binary_length(word), 0)
    word_row, word = pc.filter(word_row, real).to_numpy(), pc.filter(word, real)
    n_words = np.bincount(word_row, minlength=len(texts))
    row, blank = pc.list_parent_indices(blanks).to_numpy(), pc.list_flatten(blanks)
    ordinal = np.arange(len(row)) - _starts(pc.list_value_length(blanks).to_numpy())[row]
    followed = ordinal < n_words[row]
    at = pa.array(_starts(n_words)[row] + ordinal, mask=~followed)
    unit = pc.binary_join_element_wise(blank, pc.fill_null(pc.take(word, at), ""), "")
    there = pc.or_(pa.array(followed), pc.greater(pc.binary_length(blank), 0))
    kept = there.to_numpy(zero_copy_only=False)
    return pc.filter(unit, there), row[kept], ordinal[kept]


def pieces(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each text: its units before ``first``, before ``second``, and the rest."""
    unit, row, ordinal = units(texts)
    role = (ordinal >= first[row]).astype(np.int8) + (ordinal >= second[row])
    made = []
    for which in range(3):
        mine = role == which
        lists = pa.ListArray.from_arrays(_starts(np.bincount(row[mine], minlength=len(texts))), pc.filter(unit, pa.array(mine)))
        made.append(pc.binary_join(lists, ""))
    return made


def _rearranged(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A few texts with their draws ``h1`` to ``h4`` in their form."""
    text = batch["text"]
    n = pc.cast(pc.count_substring_regex(text, _UNIT), pa.int64())
    marked = pc.or_(pc.or_(pc.match_substring(text, MARKERS[0]), pc.match_substring(text, MARKERS[1])), pc.match_substring(text, MARKERS[2]))
    h1, h2, h3, h4 = (batch[c].to_numpy() for c in ("h1", "h2", "h3", "h4"))
    plain = pc.or_(marked, pc.or_(pc.equal(n, 0), pa.array(h3 % 100 >= REARRANGED)))
    chosen = pc.invert(plain)
    mask = chosen.to_numpy(zero_copy_only=False)
    spm = pa.array(h4 % 100 < SUFFIX_FIRST)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    ends = n.to_numpy()[mask] + 1
    one, two = h1[mask] % ends, h2[mask] % ends
    prefix, middle, suffix = pieces(pc.filter(text, chosen), np.minimum(one, two), np.maximum(one, two))
    p, s, m = MARKERS
    output = pc.if_else(
        pc.filter(spm, chosen),
        pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, ""),
        pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, ""),
    )
    nulls = pa.nulls(len(text), pa.int64())
    chars = [pc.replace_with_mask(nulls, chosen, pc.cast(pc.utf8_length(x), pa.int64())) for x in (prefix, middle)]
    return pa.RecordBatch.from_arrays([batch["doc_id"], n, form, *chars, pc.replace_with_mask(text, chosen, output)], schema=_ARROW)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about ``SLICE_BYTES`` of text each."""
    size = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            yield _rearranged(part)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for each document, in one pass without a shuffle.

    A text is cut into ``n`` units: a word with the blanks before it, or blanks at the end. The
    SHA-256 of ``SEED`` and the id draws the two cuts and the form. ``output`` is the whole text
    in its form: ``plain`` as it is, ``psm`` and ``spm`` with a marker before each piece.

    A null text counts as empty, and an empty text is plain; a text that holds a marker is
    plain, so that outputs can be read back; a null id is hashed as no digits; rows repeat as
    they come; an empty table gives no rows; other columns are ignored. A task holds one Arrow
    batch, and the units of ``SLICE_BYTES`` of text or of one longer text.
    """
    seed = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(seed, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *draws)
    return named.mapInArrow(_rearrange, _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output in a form was made of."""
    part = F.split(output, "|".join(map(re.escape, MARKERS)))
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with the SHA-256 of each output, and of the text read back from it, in their place."""
    made = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
