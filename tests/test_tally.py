import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_reasoning import ID, TEXT, facts

from factweave.operators import reasoning, tally
from factweave.plans import claims


def counted(rels, *more):
    keys = ["relationship_type", "divergence_factor", "match_basis", "cross_document", *more]
    return Counter({tuple(r[k] for k in keys): r.n for r in rels.groupBy(*keys).agg(F.sum("n").alias("n")).collect()})


def judged(df, *documents):
    rels = reasoning.judge(df).withColumns({"n": F.lit(1), "doc_a": F.least("a_document_id", "b_document_id"), "doc_b": F.greatest("a_document_id", "b_document_id")})
    return counted(rels, *documents)


def random_facts(seed, many):
    rnd = random.Random(seed)
    out = []
    for i in range(many):
        unit = rnd.choice(["INR", "PERCENT", "TEXT", "TEXT"])
        row = {
            "document_id": f"d{rnd.randrange(3)}", "char_start": rnd.choice([0, 0, 9, None]), "page_number": rnd.choice([1, 2]), "period": rnd.choice(["FY2023", "FY2024", "unknown"]),
            "entity_canonical": rnd.choice(["acme", "acme", "beta", None]), "scope": rnd.choice(["unspecified", "standalone", "consolidated", None]), "accounting_standard": rnd.choice(["As reported", "As reported", "Adjusted"]),
            "sub_metric": rnd.choice(["total", "operations", "segment", "unspecified"]), "qualifiers": rnd.choice([[], [], ["estimate"], ["share_of", "estimate"], ["exclusions_apply"], ["partial_period", "other"], None]),
            "metric_canonical": rnd.choice(["m.one", "m.one", "m.two"]), "predicate_family": rnd.choice(["fam", "fam", "", "m.one"]), "confidence": rnd.choice([0.5, 0.7, 0.9]), "normalized_unit": unit,
        }
        if unit == "TEXT":
            row |= TEXT | {"raw_value": rnd.choice(["active", "ceased", " Active", "active since long", "ABC1234", "ABC12345", "xyz9999"]), "metric_canonical": rnd.choice(["gov.status", "gov.state"])}
            if rnd.random() < 0.4:
                row |= ID | {"metric_canonical": rnd.choice(["attr.cin", "attr.name"]), "predicate_family": "attrs"}
        else:
            value = rnd.choice([0.0, -0.0, 8.5, 8.55, 8.45, 8.4, -8.5, -8.45, 100.0, 99.0, 101.0, -100.0, -99.5, 1e7, 1.004e7, 5e-324, round(rnd.uniform(-20, 20), 2)])
            row |= {"raw_value": rnd.choice(["8.5", "8.45%", "1.0 crore", "100", "ab1234x", "12345cr"]), "numeric_value": value, "normalized_numeric_value": value}
        out.append(row)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counts_equal_judged_pairs(spark, seed):
    df = facts(spark, *random_facts(seed, 260))
    assert counted(tally.verdict_counts(df)) == judged(df)
    assert counted(tally.verdict_counts(df, True), "doc_a", "doc_b") == judged(df, "doc_a", "doc_b")


def test_counts_of_lifted_claims(spark):
    df = claims.facts(spark, "/root/testdata/sf0.001")
    assert counted(tally.verdict_counts(df)) == judged(df)


def test_only_pairs_of_texts_are_compared(spark, monkeypatch):
    """A wording that is alone in its group makes no pair, and only pairs of two different identifiers are asked of Python."""
    seen = []

    def likeness(pairs, similarity):
        codes = "_identifier_similarity" in pairs.select(similarity)._jdf.queryExecution().toString()
        seen.append((codes, [tuple(r) for r in pairs.select("n", "a_text", "b_text").collect()]))
        return reasoning.likeness(pairs, similarity)

    monkeypatch.setattr(tally, "likeness", likeness)
    texts = [TEXT | {"raw_value": t, "period": p} for t, p in (("active", "FY2023"), ("ceased", "FY2024"))]
    df = facts(spark, *texts, ID | {"raw_value": "ABC1234"}, ID | {"raw_value": "ABC1235"}, ID | {"raw_value": "ABC1234"})
    assert counted(tally.verdict_counts(df, True), "doc_a", "doc_b") == judged(df, "doc_a", "doc_b")
    assert all(n > 0 for _, rows in seen for n, *_ in rows)
    assert sorted((codes, a != b) for codes, rows in seen for _, a, b in rows) == [(False, False), (False, True), (True, True), (True, True)]


def test_edges(spark):
    df = facts(spark, {})
    assert tally.verdict_counts(df).count() == 0 and tally.verdict_counts(df.limit(0), True).count() == 0
    hot = facts(spark, *[{"normalized_numeric_value": float(i % 50), "raw_value": "x"} for i in range(600)])
    assert counted(tally.verdict_counts(hot)) == judged(hot)


def test_border_is_the_last_that_agrees():
    rng = np.random.default_rng(5)
    x = np.concatenate([np.round(rng.uniform(0.01, 30, 400), 2) * rng.choice([-1, 1], 400), rng.uniform(-1e9, 1e9, 200), [5e-324, -1e300]])
    r = rng.choice([0.0, 0.05, 0.5, 5e4, 1e12], len(x))
    percent = rng.random(len(x)) < 0.5
    got = tally._border.func(pd.Series(x), pd.Series(r), pd.Series(percent)).to_numpy()

    def agree(a, b, half, points):
        delta = abs(a - b)
        return delta <= max(0.05, half) if points else delta * 100.0 / max(abs(a), abs(b)) <= 1.0 or delta <= half

    for a, half, points, y in zip(x.tolist(), r.tolist(), percent.tolist(), got.tolist(), strict=True):
        assert agree(a, y, half, points)
        further = float(np.nextafter(y, -np.inf if a > 0 else np.inf))
        assert y == -a or not agree(a, further, half, points)
