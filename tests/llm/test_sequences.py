"""Packing by powers of two and fill-in-middle against brute force, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyhand.llm import decomposition, fill_in_middle, words
from tests.llm.test_operators import awkward, documents, empty, frame, rows_of  # noqa: F401

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def marked(spark):
    """Texts that begin, end or are all blank, texts with markers and pieces of markers, many ids of each."""
    texts = ["a <P> b", "x<S>", "<M>", "<P", "a <", "> b <P c S> d", " lead", "trail  ", "\n\t \x0b", "one", "\x1c not blanks here\x85", "Größe 中文 🙂 ΑΣ\r\nend\x0c"]
    return frame(spark, [(-i * 100 - j if j % 2 else i * 100 + j, t, None, None) for i, t in enumerate(texts) for j in range(12)])


def arranged(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if h4 % 100 < 80 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, "spm" if h4 % 100 < 80 else "psm", len(prefix), len(middle), output


@pytest.mark.parametrize("name", ["documents", "awkward", "marked"])
@pytest.mark.parametrize("most", [None, 1])
def test_fill_in_middle(request, monkeypatch, name, most):
    if most:
        monkeypatch.setattr(fill_in_middle, "SLICE_BYTES", most)
    docs = request.getfixturevalue(name)
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    made = fill_in_middle.fill_in_middle(docs)
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect()) == Counter((i, *arranged(i, t)) for i, t in texts)
    back = made.select("doc_id", fill_in_middle.restored(made["output"], made["form"]).alias("text"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t or "") for i, t in texts)
    if name != "awkward":
        assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"}


def test_fill_in_middle_has_no_shuffle(documents):  # noqa: F811
    plan = fill_in_middle.digests(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["documents", "awkward", "marked"])
@pytest.mark.parametrize("most", [None, 1])
def test_decomposition(request, monkeypatch, name, most):
    if most:
        monkeypatch.setattr(decomposition, "SLICE_BYTES", most)
    docs = request.getfixturevalue(name)
    library = words.library(words.VOCABULARY)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        at, total = 0, len(ids) // 4
        for digit in [4096] * (total // 4096) + [d for d in (2048 >> i for i in range(12)) if total % 4096 & d]:
            want[r["doc_id"], at, digit, zlib.crc32(ids[4 * at : 4 * (at + digit)]), total, digit.bit_length() - 1] += 1
            at += digit
        assert at == total
    got = rows_of(decomposition.digests(docs.repartition(3)))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["bucket"]) for r in got) == want
    assert all(r["offset"] == 0 for r in got)
    places = defaultdict(list)
    for r in got:
        assert r["sequence_id"] >> decomposition.PLACE_BITS == r["bucket"]
        places[r["bucket"]].append(r["sequence_id"] & (1 << decomposition.PLACE_BITS) - 1)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_pieces_join_to_the_document(awkward):  # noqa: F811
    library = words.library(words.VOCABULARY)
    found = defaultdict(bytes)
    for r in sorted(rows_of(decomposition.decompose(awkward.where("doc_id is not null").dropDuplicates(["doc_id"]))), key=lambda r: r["start"]):
        found[r["doc_id"]] += bytes(r["ids"])
    for r in awkward.where("doc_id is not null").collect():
        assert np.frombuffer(found[r["doc_id"]], "<u4").tolist() == [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]


def test_other_lengths(spark):
    assert decomposition.lengths(0, 8) == [] and decomposition.lengths(8, 8) == [8] and decomposition.lengths(29, 8) == [8, 8, 8, 4, 1]
    with pytest.raises(ValueError):
        decomposition.decompose(frame(spark, []), longest=1000)


def test_buckets_are_folders(spark, documents, tmp_path):  # noqa: F811
    sequences = decomposition.numbered(decomposition.decompose(documents))
    decomposition.write_buckets(sequences, str(tmp_path / "sequences"))
    back = spark.read.parquet(str(tmp_path / "sequences"))
    assert back.where("length != shiftleft(1, bucket) or octet_length(ids) != 4 * length").count() == 0
    assert back.count() == sequences.count()


@pytest.mark.parametrize("operator", [fill_in_middle.digests, decomposition.digests])
def test_no_rows(operator, empty):  # noqa: F811
    assert operator(empty).collect() == []


def test_chunks_are_forgotten(monkeypatch):
    monkeypatch.setattr(words, "REMEMBERED", 4)
    made = decomposition.Encoder(words.VOCABULARY)
    library = words.library(words.VOCABULARY)
    text = " ".join(f"word{i % 7} Straße, {'x' * 70} <|endoftext|>!" for i in range(60))
    for _ in range(2):
        assert np.frombuffer(made.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(made._chunks) <= 5 and len(made._words) <= 5
