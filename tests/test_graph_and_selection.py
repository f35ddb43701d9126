"""Bulk lookups of a graph with a hub, and selection by narrowing histograms, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.operators import graph, selection


def test_lookups_of_many_names_at_once(spark):
    edges = [("CSRD", f"org {k}", "REQUIRES", 0.5 + k % 5 / 10) for k in range(300)]
    edges += [("CSRD", "org 1", "REQUIRES", 0.95), ("org 1", "CSRD", "SUBJECT_TO", 0.7), ("SFDR", "SFDR", "REFERENCES", 0.8)]
    nodes = [("CSRD", "LAW"), ("SFDR", "LAW"), ("ESRS", "LAW"), *[(f"org {k}", "ORG") for k in range(300)]]
    e = spark.createDataFrame(edges, "source string, target string, relation string, confidence double")
    n = spark.createDataFrame(nodes, "name string, kind string")
    asked = spark.createDataFrame([("Corporate Sustainability Reporting Directive",), ("csrd",), ("SFDR",), ("ESRS",), ("org 1",), ("nobody",)], "name string")
    found = graph.lookups(asked, e, n, hub=50, salts=7)
    rows = {}
    for r in found.collect():
        rows.setdefault(r.name, []).append((r.kind, r.direction, r.other, r.relation, r.confidence))
    assert set(rows) == {"CSRD", "SFDR", "ESRS", "org 1"} and len(rows["CSRD"]) == 301
    assert ("LAW", "outgoing", "org 1", "REQUIRES", 0.95) in rows["CSRD"] and ("LAW", "incoming", "org 1", "SUBJECT_TO", 0.7) in rows["CSRD"]
    assert rows["ESRS"] == [("LAW", None, None, None, None)]
    assert sorted(r[1] for r in rows["SFDR"]) == ["incoming", "outgoing"]
    assert sorted(rows["org 1"]) == [("ORG", "incoming", "CSRD", "REQUIRES", 0.95), ("ORG", "outgoing", "CSRD", "SUBJECT_TO", 0.7)]
    assert graph.related(found).where("name = 'SFDR'").count() == 2
    assert graph.lookups(asked.limit(0), e, n).count() == graph.lookups(asked, e.limit(0), n.limit(0)).count() == 0


@pytest.mark.parametrize("few,buckets", [(10_000, 1024), (5, 4)])
def test_selection_equals_sorting(spark, monkeypatch, few, buckets):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BUCKETS", buckets)
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=500), np.repeat([1.0, 2.0, 3.0], 100), np.full(200, 7.0), rng.exponential(size=300) ** 9, np.array([])):
        rows = [(k, float(v)) for k, v in enumerate(values)] + [(9000, None), (9001, float("nan"))]
        df = spark.createDataFrame(rows, "id long, v double").repartition(3)
        order = sorted((r for r in rows if r[0] < 9000), key=lambda r: (-r[1], r[0]))
        for n in (0, 1, 37, len(values) // 2, len(values), len(values) + 5):
            assert sorted(r.id for r in selection.greatest(df, F.col("v"), "id", n).collect()) == sorted(i for i, _ in order[:n])


def test_perspectives_gain_weight_by_weaknesses(spark):
    rows = spark.createDataFrame([(1, ["financial risk", "risk"]), (2, []), (3, None), (4, ["risk"] * 9), (5, ["forward"])], "id long, weak array<string>")
    got = {r.id: r.w for r in rows.select("id", rules.perspective_weights(F.col("weak")).alias("w")).collect()}
    assert got[1]["risk"] == 1.6 and got[1]["financial"] == 1.3 and got[4]["risk"] == 2.0 and got[5]["forward_looking"] == 1.3
    assert set(got[2].values()) == set(got[3].values()) == {1.0} and len(got[2]) == 8
