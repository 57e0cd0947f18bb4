import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import sweep


@pytest.fixture(autouse=True)
def slices(spark):
    """Small tables in several slices: without coalescing, as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def frame(spark, rows, types, parts=5):
    return spark.createDataFrame(rows, types).repartition(parts)


def test_scans_cross_slices(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(3), rnd.randrange(50), i, rnd.choice([None, i % 7])) for i in range(300)]
    order = ["k", "t", "i"]
    steps = {"sums": sweep.total(F.col("v")), "top": sweep.highest(F.col("v"), True), "was": sweep.last(F.col("v")), "then": sweep.following(F.col("v"), True), "n": sweep.total(F.lit(1), True)}
    got = sorted(sweep.scan(sweep.lined_up(frame(spark, rows, "k int, t int, i int, v int"), order), order, **steps).collect())
    values = [r[3] for r in sorted(rows, key=lambda r: r[:3])]
    assert len({r.slice_ for r in got}) > 1
    for i, r in enumerate(got):
        known = lambda part: [v for v in part if v is not None]
        assert r.sums == sum(known(values[: i + 1])) and r.top == max(known(values[:i]), default=None) and r.n == i
        assert r.was == next(iter(known(values[i::-1])), None) and r.then == next(iter(known(values[i + 1 :])), None)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof(spark, direction):
    rnd = random.Random(2)
    left = [(rnd.choice([0, 0, 0, 1, 2, None]), rnd.choice([None, *range(40)]), i, 0) for i in range(200)]
    left += left[:5]
    right = [(rnd.choice([0, 0, 1, 3, None]), rnd.choice([None, *range(0, 40, 3)]), rnd.randrange(9), f"x{i}") for i in range(60)]
    names = "k int, t int, i int, match int", "k int, t int, tie int, name string"
    got = sweep.asof_join(frame(spark, left, "k int, t int, i int, other int"), frame(spark, right, names[1]), ["k"], "t", direction, ["tie"])

    def best(k, t):
        able = [r for r in right if None not in (k, t, r[1]) and r[0] == k and (direction == "nearest" or (r[1] <= t if direction == "backward" else r[1] >= t))]
        return min(able, key=lambda r: (abs(r[1] - t), r[1], r[2], r[3]), default=None)

    want = sorted(((*row, best(row[0], row[1])) for row in left), key=str)
    assert sorted(((r.k, r.t, r.i, r.other, r.match and tuple(r.match)) for r in got.collect()), key=str) == want
    assert sweep.asof_join(frame(spark, left, "k int, t int, i int, other int").limit(0), frame(spark, right, names[1]), ["k"], "t", direction).count() == 0
    none = sweep.asof_join(frame(spark, left, "k int, t int, i int, other int"), frame(spark, [], names[1]), ["k"], "t", direction, reach=F.col("match.t") > 3)
    assert none.where("match is not null").count() == 0 and none.count() == len(left)


def claims_by_hand(rows):
    taken = []
    for k, s, e, p in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if None not in (s, e) and not any(k == a and not (e <= b or s >= c) for a, b, c, _ in taken):
            taken.append((k, s, e, p))
    return taken


def test_claims_are_first_come(spark):
    rnd = random.Random(3)
    for spread, many in ((400, 150), (60, 150), (3000, 400)):
        rows = [(rnd.choice([0, 0, 0, 1, None]), s := rnd.choice([None, *range(spread)]), s and s + rnd.randint(0, 12), i) for i in range(many)]
        got = sweep.claim_intervals(frame(spark, rows, "k int, s int, e int, p int"), ["k"], "s", "e", ["p"])
        assert sorted(map(tuple, got.collect()), key=str) == sorted(claims_by_hand(rows), key=str)
    assert sweep.claim_intervals(frame(spark, rows, "k int, s int, e int, p int").limit(0), ["k"], "s", "e", ["p"]).count() == 0
    twice = frame(spark, [(1, 2, 5, 1)] * 3, "k int, s int, e int, p int")
    assert sweep.claim_intervals(twice, ["k"], "s", "e", ["p"]).count() == 1


@pytest.mark.parametrize("few", [0, 3, 20])
def test_claims_of_small_and_large_clusters(spark, few):
    rnd = random.Random(few)
    rows = [(rnd.choice([0, 1, None]), s := rnd.randrange(250), s + rnd.randint(0, 9), rnd.randrange(40)) for _ in range(130)]
    rows = list(dict.fromkeys(rows))
    got = sweep.claim_intervals(frame(spark, rows, "k int, s int, e int, p int"), ["k"], "s", "e", ["p"], few)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(claims_by_hand(rows), key=str)


def test_a_chain_of_claims_takes_one_round(spark, monkeypatch):
    """Rows that wait for each other, one behind the other: settled within their cluster, and no round for each."""
    rounds, clusters = [], sweep._clusters
    monkeypatch.setattr(sweep, "_clusters", lambda *a: rounds.append(1) or clusters(*a))
    rows = [(k, i, i + 2, i) for k in range(3) for i in range(12)]
    got = sweep.claim_intervals(frame(spark, rows, "k int, s int, e int, p int"), ["k"], "s", "e", ["p"])
    assert sorted(map(tuple, got.collect())) == sorted(claims_by_hand(rows)) and len(rounds) == 1
    mapped = frame(spark, rows[:8], "k int, s int, e int, p int").withColumn("more", F.create_map("k", "p"))
    assert sweep.claim_intervals(mapped, ["k"], "s", "e", ["p"]).count() == len(claims_by_hand(rows[:8]))


def greedy(left, right, reach, behind):
    pairs = []
    for k, t, a in left:
        for q, u, b in right:
            if None not in (k, t, u) and k == q:
                gap = u - t if u >= t else t - u + behind
                if gap <= reach:
                    pairs.append((gap, t, u, a, b, k))
    used, out = set(), []
    for gap, _, _, a, b, k in sorted(pairs):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out.append((k, a, b, gap))
    return out


@pytest.mark.parametrize(("spread", "keys", "behind"), [(300, [0, 1, 2, None], 0), (20, [0, 0, 0, 1], 4), (1, [0], 0), (2000, [0], 12)])
def test_greedy_one_to_one(spark, spread, keys, behind):
    """Also a table with one hot place (spread 1), where all rows of a key meet."""
    rnd = random.Random(spread)
    side = lambda n, base: [(rnd.choice(keys), rnd.choice([None, *range(spread)] if spread > 1 else [7]), base + i) for i in range(n)]
    left, right = side(120, 0), side(90, 500)
    for reach in (3, 40):
        got = sweep.match_one_to_one(frame(spark, left, "k int, t int, id int"), frame(spark, right, "k int, t int, id int"), ["k"], "t", "id", reach, behind)
        assert sorted(map(tuple, got.collect())) == sorted(greedy(left, right, reach, behind))
    assert sweep.match_one_to_one(frame(spark, left, "k int, t int, id int"), frame(spark, [], "k int, t int, id int"), ["k"], "t", "id", 5).count() == 0
