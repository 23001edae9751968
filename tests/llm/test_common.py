import random

from chartwave.llm.common import components
from tests.llm.helpers import partition


def test_components_match_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    pairs += [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 80)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    real = [(a, b) for a, b in pairs if a != b]
    nodes = {x for p in real for x in p}
    assert got == partition(real, nodes)


def test_components_of_no_links(spark):
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "src long, dst long")).count() == 0
