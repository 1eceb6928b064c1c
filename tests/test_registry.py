"""Every registered query against its oracle, and the shape of the plans."""

import pytest
from pyspark.sql import Window, functions as F

import __spark_entry__ as entry
from checks import facts, registry, texts, verify
from tallyhand.plans import catalogue, opportunities

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    return verify.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_oracle(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    assert not list(windows_without_key(df)), "a window without a key runs in one task"
    problem = verify.compare(df, con, ORACLES[name])
    assert problem is None, problem


def windows_without_key(df):
    """The windows of a plan that put all rows in one task."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Window" and node.partitionSpec().isEmpty():
            yield node.toString()
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.length()))


def test_windows_without_key_are_seen(spark):
    bare = spark.range(5).withColumn("n", F.count("*").over(Window.partitionBy()))
    assert list(windows_without_key(bare.where("n > 1"))) and not list(windows_without_key(spark.range(5)))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_counting_shuffles_hands_once(spark, sf_dir):
    df = opportunities.count_hands(facts.labelled(spark, sf_dir), catalogue.catalogue())
    plan = df._jdf.queryExecution().executedPlan().toString()
    # one exchange to build the fixture hands from events, one for the counts
    assert plan.count("Exchange hashpartitioning") == 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name, mark, times", [("action_rows", "PokerStars Hand #", 1), ("site_action_rows", "PokerStars Hand #", 1), ("seat_stack_rows", "PokerStars Hand #", 2)])
def test_texts_are_written_once_a_pass(spark, sf_dir, name, mark, times):
    # an exploded column would bring a filter on its size, in which the text is computed again
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(mark) == times


def test_files_keep_all_partitions(spark, sf_dir):
    # merged by bytes they were one more than there are cores, and the last ran alone
    assert texts.files(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
