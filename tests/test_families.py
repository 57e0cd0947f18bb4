"""Families from prompts of bounded size against the families of one prompt with all labels."""

import pytest

from factweave.operators import families

THINGS = ("revenue", "space", "staff", "energy", "water", "margin")


def model(named="{kind} of {n}"):
    """Labels with one last word are one thing; made here, so workers get it by value."""

    def answer(names):
        import json

        groups = {}
        for n in names:
            groups.setdefault(n.split()[-1], []).append({"raw": n, "confidence": 0.9})
        return json.dumps({"families": [{"family_id": named.format(kind=k, n=len(m), i=i), "members": m} for i, (k, m) in enumerate(groups.items())]})

    return answer


def made(kinds, each):
    words = ("net", "gross", "annual", "own", "sold", "held", "zonal")
    return [f"{words[i % 7]} {THINGS[i % 6]} {'ab'[i % 2]}{i} k{k}" for k in range(kinds) for i in range(k % each + 1)]


def partition(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.family, set()).add(r.raw)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize(("kinds", "each", "size"), [(9, 30, 40), (120, 6, 20)])
def test_batches_give_the_families_of_one_prompt(spark, tmp_path, kinds, each, size):
    names = made(kinds, each)
    sizes, answer = str(tmp_path / "sizes"), model()

    def call(some):
        assert len(some) <= size
        with open(sizes, "a") as out:
            out.write(f"{len(some)}\n")
        return answer(some)

    table = spark.createDataFrame([(n,) for n in [*names, names[0], "", "  "]], "metric string")
    got = families.in_batches(table, call, size=size).collect()
    one = families.parse(spark.createDataFrame([(answer(names),)], "payload string")).collect()
    assert partition(got) == partition(one) and len(got) == len(names) and {r.confidence for r in got} == {0.9}
    assert len(open(sizes).read().split()) > 1


def test_a_prompt_that_fails_costs_its_own_labels(spark):
    answer = model()

    def call(some):
        if any("k3" in n for n in some):
            raise ValueError("no answer")
        return answer(some)

    names = [f"x{i} k{k}" for k in (1, 2, 3) for i in range(2)]
    got = families.in_batches(spark.createDataFrame([(n,) for n in names], "metric string"), call, size=2).collect()
    assert {r.raw for r in got} == {n for n in names if "k3" not in n}
    assert families.in_batches(spark.createDataFrame([], "metric string"), call).count() == 0


def test_one_name_for_two_families_stays_two(spark):
    names = [f"{w} k{k}" for k in range(5) for w in ("net", "own", "held")]
    got = families.in_batches(spark.createDataFrame([(n,) for n in names], "metric string"), model("group {i}"), size=4).collect()
    assert partition(got) == sorted(sorted(n for n in names if n.endswith(f"k{k}")) for k in range(5))


def test_chains_of_links_reach_their_smallest(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(0, 40)] + [("x", "x"), ("y", "z")]
    got = {r.raw: r.root for r in families.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(41)} | {"x": "x", "y": "y", "z": "y"}


def test_facts_of_many_labels_are_grouped_in_batches(spark):
    rows = [(n, "m." + n.replace(" ", "_"), None, None) for n in made(20, 4)] + [("growth k1", "growth.change", None, None)]
    facts = spark.createDataFrame(rows, "metric string, metric_canonical string, predicate_family string, predicate_family_confidence double")
    got = {r.metric: r.predicate_family for r in families.group(spark, facts, model(), size=10).collect()}
    assert got["growth k1"].endswith(".change") and len(got) == len(rows)
    assert len({f for n, f in got.items() if n != "growth k1"}) == 20
