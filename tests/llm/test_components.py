"""Components of long chains: a bounded number of rounds, and plans whose estimated sizes stay those of their tables."""

import random

from copperline.llm.common import connected_components


def estimate(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def test_a_chain_in_any_order_is_one_component(spark):
    ids = list(range(1000))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame([*zip(ids, ids[1:]), (2000, 2001), (None, 5), (7, 7)], "a long, b long")
    labels = connected_components(links)
    assert {r.node: r.component for r in labels.collect()} == {k: 0 for k in ids} | {2000: 2000, 2001: 2000}
    assert estimate(labels) < 1 << 40
