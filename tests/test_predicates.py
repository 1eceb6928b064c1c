import pytest
from pyspark.sql import functions as F

from tallyhand.functions.predicates import Fields, compile_clause
from tallyhand.plans import catalogue


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, True, 5.0, "x", "x"), (2, False, 1.0, "y", "x"), (3, None, None, None, None)],
        "id int, flag boolean, num double, a string, b string",
    )


@pytest.mark.parametrize(
    "clause, ids",
    [
        ({"is_true": "flag"}, {1}),
        ({"is_false": "flag"}, {2, 3}),
        ({"not": "flag"}, {2, 3}),
        ({"gte": ["num", 5]}, {1}),
        ({"lte": ["num", 1]}, {2}),
        ({"gt": ["num", 1]}, {1}),
        ({"lt": ["num", 5]}, {2}),
        ({"eq": ["a", "x"]}, {1}),
        ({"eq": ["a", None]}, {3}),
        ({"eq_field": ["a", "b"]}, {1}),
        ({"in": ["a", ["y", "z"]]}, {2}),
        ({"not": {"in": ["a", ["y", "z"]]}}, {1, 3}),
        ({"all": [{"gt": ["num", 0]}, {"is_true": "flag"}]}, {1}),
        ({"any": [{"eq": ["a", "y"]}, {"is_true": "flag"}]}, {1, 2}),
        ([{"gt": ["num", 0]}, "flag"], {1}),
        ("num", {1, 2}),
        (None, set()),
        (True, {1, 2, 3}),
        ({"eq": ["a", "it's"]}, set()),
    ],
)
def test_truth_table(rows, clause, ids):
    got = rows.where(compile_clause(clause, Fields(rows.schema))).collect()
    assert {r.id for r in got} == ids


def test_never_null(rows):
    fields = Fields(rows.schema)
    cols = [compile_clause(c, fields).isNull().cast("int") for c in ({"gte": ["num", 1]}, {"eq_field": ["a", "b"]}, {"in": ["a", ["x"]]})]
    assert rows.select(sum(cols, F.lit(0)).alias("n")).agg(F.sum("n")).first()[0] == 0


def test_unknown_field_and_operator(rows):
    with pytest.raises(ValueError):
        compile_clause({"is_true": "nope"}, Fields(rows.schema))
    with pytest.raises(ValueError):
        compile_clause({"xor": ["a", "b"]}, Fields(rows.schema))


def test_catalogue_shape():
    metrics = catalogue.catalogue()
    assert len(metrics) == 66
    assert len(catalogue.for_family(metrics, "RFI")) == 4
    assert all("postflop_all" not in m["applies_to_groups"] for m in metrics if m["scope"] == "preflop")
    assert len(catalogue.for_group(metrics, "postflop_all")) == 33
    with pytest.raises(ValueError):
        catalogue.validate([metrics[0], metrics[0]])
    with pytest.raises(ValueError):
        catalogue.validate([{"id": "x"}])


def test_yaml_catalogue():
    text = """
version: 1
stats:
- {id: A, label: a, family: F, scope: preflop, applies_to_groups: [g], opportunity: {is_true: x}, attempt: {is_true: y}}
"""
    assert catalogue.load_yaml(text)[0]["id"] == "A"
    with pytest.raises(ValueError):
        catalogue.load_yaml("stats: []")
