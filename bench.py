"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs twice: ``queries`` has the first run, driver-side plan building included,
``warm`` the second. ``copies`` has the two counting jobs over 20 copies of the hands.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from checks import handtext, registry, tables  # noqa: E402
from checks.session import local_session  # noqa: E402
from tallyhand.operators.derive import derive_facts  # noqa: E402
from tallyhand.plans import catalogue, counters, opportunities  # noqa: E402

COPIES = 20
HEADLINE = [
    "opp_att_month_group",
    "opp_att_catalogue",
    "opp_att_grouping_sets",
    "multi_source_merge",
    "time_decay_pct",
    "trend_halves",
    "scorecard_rollup",
    "category_scores",
    "enriched_catalogue_counts",
    "distinct_hands",
    "stat_drilldown",
    "preflop_counters",
    "postflop_counters",
    "discard_reason",
    "classify_reason",
    "segment_hands",
    "first_record_dedup",
    "normalise_number",
    "month_lisbon",
    "run_summary",
]


def timed(df) -> float:
    start = time.perf_counter()
    df().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def copied(df):
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).drop("_copy").repartition(64)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    queries = registry.queries()
    first: dict[str, float] = {}
    warm: dict[str, float] = {}
    queries["opp_att_month_group"](spark, sf_dir).collect()  # starts the JVM side
    for name in HEADLINE:
        first[name] = timed(lambda: queries[name](spark, sf_dir))
        warm[name] = timed(lambda: queries[name](spark, sf_dir))
        print(name, first[name], warm[name], file=sys.stderr, flush=True)
    facts = lambda: opportunities.with_month_and_groups(derive_facts(copied(tables.hands(spark, sf_dir))))
    texts = lambda: counters.with_flags(counters.read_hands(copied(handtext.texts(spark, sf_dir))))
    copies = {
        "hands_to_cube": timed(lambda: opportunities.count_hands(facts(), catalogue.catalogue())),
        "texts_to_counters": timed(lambda: (lambda flagged, stats: counters.count_flags(flagged, [(n, None) for n in stats], ["site"]))(*texts())),
    }
    spark.stop()
    scale = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(first.values()), 3), "unit": "sec", "queries": first, "sf": scale, "warm": warm, "copies": copies}))


if __name__ == "__main__":
    main()
