"""The pipeline's stages against brute force, and the registration."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks import verify
from tallyhand.llm import common, language, queries
from tests.llm.test_operators import brute_groups


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    found = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
        found[name] = docs
    texts = {name: {r["doc_id"]: r["text"] for r in found[name].collect()} for name in ("documents", "language_id", "exact_dedup", "near_dup")}
    for name in ("language_id", "exact_dedup", "near_dup"):
        assert found[name].columns == columns
    assert set(texts["language_id"]) == {i for i, t in texts["documents"].items() if any(map(str.isalpha, t))}
    first = {}
    for i, t in sorted(texts["language_id"].items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert set(texts["exact_dedup"]) == set(first.values())
    assert set(texts["near_dup"]) == {named for _, named, _ in brute_groups(list(texts["exact_dedup"].items()))}
    assert {r["doc_id"] for r in found["packing"].collect()} == set(texts["near_dup"])


def test_stage_rejects_what_no_language_has(spark):
    rows = [(1, "12345 !!!", None), (2, None, None), (3, "the cat and the dog", "en"), (4, "der Hund und die Katze", "de"), (5, "the dog and the cat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in language.with_known_language(docs).collect()) == [3, 4, 5]


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_oracle(spark, sf_dir, name):
    assert isinstance(verify.connect(sf_dir), duckdb.DuckDBPyConnection)
    assert verify.compare(queries.QUERIES[name](spark, sf_dir), verify.connect(sf_dir), queries.ORACLES[name]) is None
