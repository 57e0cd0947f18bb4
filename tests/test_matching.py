import random

import pytest
from pyspark.sql import functions as F
from test_reasoning import facts

from factweave.operators import matching


def rows(many, seed):
    rnd = random.Random(seed)
    return [{"entity_canonical": rnd.choice(["hot"] * 4 + ["beta", "gamma", None]), "predicate_family": rnd.choice(["fam", "", "financial.revenue"]), "metric_canonical": rnd.choice(["m.one", "fam", "financial.revenue"])} for _ in range(many)]


@pytest.mark.parametrize("block", [1, 3, 16, 10_000])
def test_triangles_of_blocks_hold_each_pair_once(spark, block):
    df = facts(spark, *rows(150, block))
    got = matching.bucket_pairs(df, block).select("a_id", "b_id", "a_fact_seq", "b_fact_seq").collect()
    found = matching.eligible(df).collect()
    family = lambda f: f.predicate_family or f.metric_canonical
    want = {
        (a.id, b.id) for a in found for b in found
        if a.fact_seq < b.fact_seq and a.entity_canonical and a.entity_canonical == b.entity_canonical and family(a) == family(b)
        and (a.metric_canonical == b.metric_canonical or a.predicate_family == b.predicate_family != "")
    }
    assert len(got) == len(want) and {(r.a_id, r.b_id) for r in got} == want and all(r.a_fact_seq < r.b_fact_seq for r in got)


def test_a_hot_bucket_is_dealt_evenly(spark):
    """A third of all facts in one bucket: no group of the join has more than twice the rows of a block and its partner."""
    many = 3000
    df = facts(spark, *[{"entity_canonical": "hot" if i % 3 == 0 else f"e{i % 97}"} for i in range(many)])
    dealt = matching._dealt(df, matching.heavy_buckets(df, 64), 64).groupBy("k_entity", "here", "there").agg(F.count(F.lit(1)).alias("n"))
    hot = sorted(r.n for r in dealt.where("k_entity = 'hot' and here < there").collect())
    assert len(hot) == 16 * 15 // 2 and hot[-1] <= 2 * hot[len(hot) // 2] and hot[-1] < 4 * 64
    assert matching.bucket_pairs(df, 64).where("k_entity = 'hot'").count() == 1000 * 999 // 2
