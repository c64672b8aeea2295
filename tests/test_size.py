"""What only larger or odd tables showed."""

import random
from collections import Counter

from pyspark.sql import functions as F

from sigmafold.operators.graph import profiles as P
from sigmafold.operators.graph import relational as G
from sigmafold.plans import graph_queries


def test_screen_finds_all_pairs_and_moves_none(spark, monkeypatch):
    rng = random.Random(4)
    bags = {g: Counter(rng.choices(range(9), k=rng.choice([1, 2, 3, 5, 9]))) for g in range(120)}
    bags |= {g: Counter(rng.choices(range(40), k=60)) for g in range(120, 130)}  # over LISTED kinds
    rows = spark.createDataFrame([(g, i) for g, bag in bags.items() for i in bag.elements()], "g bigint, i bigint")
    monkeypatch.setattr(P, "SENT", 40)  # several parts
    found = P.screen(rows, rows.where("g % 10 = 0"), "g", "i")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(q, c) for q in range(0, 130, 10) for c in sorted(bags) if all(bags[c][i] >= k for i, k in bags[q].items())]
    assert plan.count("Join") == plan.count("strategy=broadcast")  # no pair is shuffled


def test_near_pairs_at_the_cutoff_without_broadcast(spark):
    # 93.01 - 91.01 is over 2 in doubles, (930.1 - 910.1) / 10 is not.
    points = [(1, 3.0, 930.1), (2, 3.0, 910.1), (3, 3.0, 930.1), (4, 5.0, 930.1), (5, 6.0, 930.1), (6, None, 930.1)]
    rng = random.Random(2)
    points += [(k, float(rng.randint(1, 9)), rng.randint(9000, 9990) / 10) for k in range(10, 90)]
    df = spark.createDataFrame(points, "k bigint, x double, y double").repartition(3)
    found = G.near_pairs(df, "k", ["x", "y"], 2.0, [1.0, 10.0])
    known = [p for p in points if p[1] is not None]
    want = [(a, b) for a, x, y in known for b, u, v in known if a < b and (x - u) ** 2 + ((y - v) / 10) ** 2 <= 4]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_motifs_have_no_budget_unless_asked(spark, tmp_path):
    arcs = G.arcs_of(spark.range(160).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(200), F.lit(359))).alias("dst")), "src", "dst", directed=False)
    vertices = arcs.select("graph_id", F.col("src").alias("v")).distinct().withColumns({"kind": F.lit(1), "label": F.lit("")})
    assert tuple(P.bounded_motifs(vertices, arcs).first())[1:] == ("complete", 0, 0)  # four million wedges
    assert P.bounded_motifs(vertices, arcs, 1000).first().status == "skipped_budget"
    spark.range(30).select((F.col("id") * 10).alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    assert tuple(graph_queries.motifs_of_a_regular_graph(spark, str(tmp_path)).first()) == ("complete", 30, 0)  # keys with gaps
