import random

import pytest
from loomgraph.llm import near_dedup as N


@pytest.mark.parametrize("percent", range(8, 101))
def test_miss_rate_at_the_threshold(percent):
    rows, bands = N.layout(percent)
    assert rows * bands <= N.K and (1 - (percent / 100) ** rows) ** bands <= N.MISS
    assert N.layout(80) == (5, 28) and N.layout(85) == (6, 24)


def test_pairs_at_the_pipelines_threshold(spark):
    """Pairs of similarity 40 / 50 that share no band of six rows."""
    rows = []
    for k, seed in enumerate((1287, 3047, 3768, 6236, 6585, 6870, 6942, 8097)):
        rng = random.Random(seed)
        w = [f"w{rng.randrange(10**6)}" for _ in range(49)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:20], "x", *w[21:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.component_id == r.doc_id // 2 * 2 for r in N.near_duplicates(df, 80).collect())
