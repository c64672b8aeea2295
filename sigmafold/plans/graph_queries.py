"""Queries on graphs made from the tables: part-supplier multigraph, customer orders, nations, and small synthetic graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmafold.functions.fields import FP251
from sigmafold.operators.graph import kernels
from sigmafold.operators.graph import profiles as P
from sigmafold.operators.graph import relational as G
from sigmafold.plans.law_queries import _e, product_sql, table
from sigmafold.runtime import materialise

FOUND: dict = {}


def query(sql: str | None):
    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def _supply(spark, sf):
    """Part -> supplier arcs; parts are even, suppliers odd."""
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    return G.arcs_of(rows, "src", "dst")


_ARCS = "SELECT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst, count(*) AS mult FROM lineitem GROUP BY 1, 2"


@query(_ARCS)
def graph_build_multiplicity(spark, sf):
    return _supply(spark, sf).select("src", "dst", "mult")


@query(f"SELECT degree, count(*) AS vertices FROM (SELECT v, sum(o)::BIGINT AS degree FROM (SELECT src AS v, 1 AS o FROM ({_ARCS}) UNION ALL SELECT dst, 0 FROM ({_ARCS})) GROUP BY 1) GROUP BY 1")
def degree_histogram_out(spark, sf):
    return G.degree_histogram(_supply(spark, sf), "out_records").drop("graph_id")


@query(f"SELECT degree, count(*) AS vertices FROM (SELECT v, sum(o)::BIGINT AS degree FROM (SELECT src AS v, 0 AS o FROM ({_ARCS}) UNION ALL SELECT dst, 1 FROM ({_ARCS})) GROUP BY 1) GROUP BY 1")
def degree_histogram_in(spark, sf):
    return G.degree_histogram(_supply(spark, sf), "in_records").drop("graph_id")


@query(f"SELECT degree, count(*) AS vertices FROM (SELECT v, count(DISTINCT w) AS degree FROM (SELECT src AS v, dst AS w FROM ({_ARCS}) UNION ALL SELECT dst, src FROM ({_ARCS})) GROUP BY 1) GROUP BY 1")
def degree_histogram_support(spark, sf):
    return G.degree_histogram(_supply(spark, sf), "support").drop("graph_id")


def _follow(spark, sf, kind: str | None = None):
    """An arc from each event's user to the next event's user, where both events are of one type (or of ``kind``): directed, with loops and cycles."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    nxt = rows.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("dst"), "event_type")
    steps = rows.join(nxt, ["event_id", "event_type"])
    return G.arcs_of(steps if kind is None else steps.where(F.col("event_type") == kind), "user_id", "dst")


_FOLLOW = "SELECT a.user_id AS src, b.user_id AS dst, count(*) AS mult FROM events a JOIN events b ON b.event_id = a.event_id + 1 AND a.event_type = b.event_type GROUP BY 1, 2"
_ERRORS = _FOLLOW.replace("GROUP BY", "WHERE a.event_type = 'error' GROUP BY")
_REACH = f"""WITH RECURSIVE a AS (SELECT DISTINCT src, dst FROM ({_ERRORS})), both_ways AS (FROM a UNION SELECT dst, src FROM a),
r AS (SELECT src AS v, src AS w FROM both_ways UNION SELECT r.v, b.dst FROM r JOIN both_ways b ON r.w = b.src)"""


@query(f"{_REACH} SELECT v, min(w) AS component FROM r GROUP BY 1")
def weak_components(spark, sf):
    return G.weak_components(_follow(spark, sf, "error"))


@query(
    f"""WITH RECURSIVE a AS (SELECT DISTINCT src, dst FROM ({_ERRORS})), vs AS (SELECT src AS v FROM a UNION SELECT dst FROM a),
    r AS (SELECT v, v AS w FROM vs UNION SELECT r.v, a.dst FROM r JOIN a ON r.w = a.src)
    SELECT x.v, min(x.w) AS component FROM r x JOIN r y ON x.v = y.w AND x.w = y.v GROUP BY 1"""
)
def strong_components(spark, sf):
    return G.strong_components(_follow(spark, sf, "error"))


@query(
    f"""{_REACH}, c AS (SELECT v, min(w) AS component FROM r GROUP BY 1),
    s AS (SELECT component, count(*) AS vertices FROM c GROUP BY 1),
    t AS (SELECT component, count(*) AS records, sum(mult)::BIGINT AS mult, count(*) FILTER (WHERE src = dst) AS loops FROM ({_ERRORS}) f JOIN c ON f.src = c.v GROUP BY 1),
    e AS (SELECT component, count(DISTINCT (least(src, dst), greatest(src, dst))) AS support_edges FROM a JOIN c ON a.src = c.v WHERE src <> dst GROUP BY 1)
    SELECT component, vertices, coalesce(records, 0) AS records, coalesce(mult, 0) AS mult, coalesce(loops, 0) AS loops, coalesce(support_edges, 0) AS support_edges,
    greatest(0, coalesce(support_edges, 0) + 1 - vertices) AS cycle_rank FROM s LEFT JOIN t USING (component) LEFT JOIN e USING (component)"""
)
def global_profile(spark, sf):
    return G.global_profile(_follow(spark, sf, "error"))


_EDGES = f"SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({_FOLLOW}) WHERE src <> dst"


@query(f"WITH e AS ({_EDGES}) SELECT count(*) AS triangles FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b")
def triangle_count(spark, sf):
    return G.triangles(_follow(spark, sf)).agg(F.count(F.lit(1)).alias("triangles"))


@query(
    f"""WITH e AS ({_EDGES}) SELECT count(*) AS cliques FROM e ab JOIN e bc ON ab.b = bc.a JOIN e ac ON ac.a = ab.a AND ac.b = bc.b
    JOIN e cd ON cd.a = bc.b JOIN e ad ON ad.a = ab.a AND ad.b = cd.b JOIN e bd ON bd.a = ab.b AND bd.b = cd.b"""
)
def clique4_count(spark, sf):
    return G.cliques4(_follow(spark, sf)).agg(F.count(F.lit(1)).alias("cliques"))


@query(
    f"""WITH e AS ({_EDGES}), d AS (SELECT v, count(*) AS d FROM (SELECT a AS v FROM e UNION ALL SELECT b FROM e) GROUP BY 1),
    t AS (SELECT count(*) AS t FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b)
    SELECT 'edge' AS pattern, count(*) AS n FROM e UNION ALL SELECT 'path', (sum(d * (d - 1) // 2) - 3 * any_value(t))::BIGINT FROM d, t UNION ALL SELECT 'triangle', t FROM t"""
)
def pattern_counts_order3(spark, sf):
    return G.order3_patterns(_follow(spark, sf)).drop("graph_id")


@query(f"WITH a AS ({_FOLLOW}) SELECT x.src AS u, count(*) AS steps, sum(x.mult * y.mult)::BIGINT AS weight FROM a x JOIN a y ON x.dst = y.src WHERE y.dst <> x.src OR x.src = x.dst GROUP BY 1")
def nonbacktracking_steps(spark, sf):
    return G.transitions(_follow(spark, sf)).groupBy("u").agg(F.count(F.lit(1)).alias("steps"), F.sum("weight").alias("weight"))


@query(
    f"""WITH a AS ({_FOLLOW}), p2 AS (SELECT x.src, y.dst, sum(x.mult * y.mult)::BIGINT AS w FROM a x JOIN a y ON x.dst = y.src GROUP BY 1, 2),
    p3 AS (SELECT x.src, y.dst, sum(x.w::HUGEINT * y.mult) AS w FROM p2 x JOIN a y ON x.dst = y.src GROUP BY 1, 2)
    SELECT 1 AS length, coalesce(sum(mult), 0)::BIGINT % 65521 AS trace FROM a WHERE src = dst UNION ALL
    SELECT 2, coalesce(sum(w), 0)::BIGINT % 65521 FROM p2 WHERE src = dst UNION ALL SELECT 3, (coalesce(sum(w), 0) % 65521)::BIGINT FROM p3 WHERE src = dst"""
)
def closed_walk_traces_len_k(spark, sf):
    return G.walk_traces(_follow(spark, sf), 3, 65521).drop("graph_id")


@query(
    f"""WITH a AS ({_FOLLOW}), k AS (SELECT src AS v FROM a UNION SELECT dst FROM a), keep AS (SELECT v FROM k WHERE v % 2 = 0)
    SELECT src, dst, mult FROM a WHERE src IN (FROM keep) AND dst IN (FROM keep)"""
)
def induced_subgraph(spark, sf):
    arcs = _follow(spark, sf)
    vertices = _vertices_of(arcs)
    return G.induced(vertices, arcs, vertices.where("v % 2 = 0").select("graph_id", "v"))[1].select("src", "dst", "mult")


@query(f"SELECT src, dst, mult + (CASE WHEN src % 2 = 0 THEN 1 ELSE -1 END) AS mult FROM ({_FOLLOW}) WHERE mult + (CASE WHEN src % 2 = 0 THEN 1 ELSE -1 END) > 0")
def graph_delta_apply(spark, sf):
    arcs = _follow(spark, sf)
    changes = arcs.withColumn("change", F.when(F.col("src") % 2 == 0, 1).otherwise(-1).cast("bigint"))
    return G.apply_delta(arcs, changes).select("src", "dst", "mult")


def _vertices_of(arcs):
    ends = arcs.select("graph_id", F.explode(F.array("src", "dst")).alias("v")).distinct()
    return ends.select("graph_id", "v", F.lit(G.ENTITY).alias("kind"), F.lit("").alias("label"))


@query(
    """SELECT c_nationkey AS cell, count(*) AS n, sum(c_custkey % 251)::BIGINT % 251 AS m1, sum((c_custkey % 251) ** 2)::BIGINT % 251 AS m2,
    sum(((c_custkey % 251)::BIGINT * (c_custkey % 251) * (c_custkey % 251)))::BIGINT % 251 AS m3 FROM customer GROUP BY 1"""
)
def cell_moments(spark, sf):
    rows = table(spark, sf, "customer").withColumn("cell", F.col("c_nationkey"))
    return G.cell_moments(rows, ["cell"], _e("c_custkey"), 3)


@query(
    """WITH n AS (SELECT count(DISTINCT n_regionkey) AS regions, count(*) AS nations FROM nation), k AS (SELECT n_regionkey, count(*) AS c FROM nation GROUP BY 1),
    s AS (SELECT c, count(*) AS r FROM k GROUP BY 1)
    SELECT cells, vertices FROM (SELECT (SELECT count(*) FROM s) * 2 AS cells, regions + nations AS vertices FROM n)"""
)
def exact_1wl_partition(spark, sf):
    """Region-nation tree: the cells are the regions by size and the nations by their region's size."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"), (F.col("n_regionkey") + 1000).cast("bigint").alias("dst"))
    arcs = G.arcs_of(nations, "src", "dst", directed=False)
    return G.stable_partition(_vertices_of(arcs), arcs).agg(F.count_distinct("color").alias("cells"), F.count(F.lit(1)).alias("vertices"))


@query(FOUND["exact_1wl_partition"][1])
def label_rounds_by_nation(spark, sf):
    """Field labels of the region-nation tree after six rounds tell the same vertices apart as exact refinement."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"), (F.col("n_regionkey") + 1000).cast("bigint").alias("dst"))
    arcs = G.arcs_of(nations, "src", "dst", directed=False)
    return G.label_rounds(_vertices_of(arcs), arcs).agg(F.count_distinct("labels").alias("cells"), F.count(F.lit(1)).alias("vertices"))


def small_graphs(spark):
    """Cycles, paths, stars and two triangles, some under other numberings: vertices and arcs."""
    shapes = {
        "cycle6": [(i, (i + 1) % 6) for i in range(6)],
        "cycle6b": [(0, 2), (2, 4), (4, 1), (1, 3), (3, 5), (5, 0)],
        "triangles": [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)],
        "path5": [(i, i + 1) for i in range(4)],
        "path5b": [(3, 0), (0, 4), (4, 1), (1, 2)],
        "star5": [(0, i) for i in range(1, 5)],
    }
    rows = [(g, s, d) for g, edges in shapes.items() for a, b in edges for s, d in ((a, b), (b, a))]
    arcs = spark.createDataFrame(rows, "graph_id string, src bigint, dst bigint").select("*", F.lit("edge").alias("relation"), F.lit("").alias("role"), F.lit(1).cast("bigint").alias("mult"))
    return _vertices_of(arcs), arcs


@query("SELECT * FROM (VALUES ('cycle6', 2), ('triangles', 1), ('path5', 2), ('star5', 1)) t(first, graphs)")
def canonical_dedup(spark, sf):
    forms = kernels.canonical_forms(*small_graphs(spark))
    return forms.groupBy("form").agg(F.min("graph_id").alias("first"), F.count(F.lit(1)).cast("int").alias("graphs")).drop("form")


@query("SELECT * FROM (VALUES ('cycle6', 'cycle6b', 'isomorphic', 'search'), ('cycle6', 'triangles', 'different', 'search'), ('path5', 'star5', 'different', 'degrees'), ('cycle6', 'path5', 'different', 'counts')) t(a, b, verdict, tier)")
def adaptive_pipeline_verdicts(spark, sf):
    pairs = spark.createDataFrame([("cycle6", "cycle6b"), ("cycle6", "triangles"), ("path5", "star5"), ("cycle6", "path5")], "a string, b string")
    return kernels.compare_pairs(pairs, *small_graphs(spark))


@query("SELECT * FROM (VALUES ('cycle6', 'reuse'), ('cycle6b', 'reuse'), ('triangles', 'insert'), ('path5', 'insert'), ('path5b', 'reuse'), ('star5', 'insert')) t(graph_id, action)")
def dag_insert_reuse(spark, sf):
    forms = kernels.canonical_forms(*small_graphs(spark))
    return kernels.resolve_dag(forms.where("graph_id = 'cycle6'"), forms).select("graph_id", "action")


@query("SELECT * FROM (VALUES ('cycle6', [0, 12, 0, 36, 0, 132]::BIGINT[]), ('path5', [0, 8, 0, 20, 0, 56]::BIGINT[])) t(graph_id, traces)")
def matrix_walks_small(spark, sf):
    vertices, arcs = small_graphs(spark)
    pick = F.col("graph_id").isin("cycle6", "path5")
    return kernels.matrix_profile(vertices.where(pick), arcs.where(pick), [1, 2, 3, 4, 5, 6], [3, 5]).select("graph_id", "traces")


_BITS = "list_distinct(flatten(list([('0x' || substr(sha256(({x})::VARCHAR), 2 * i + 1, 2))::INT for i in range(0, 6)])))"


@query(
    f"""WITH m AS (SELECT p_brand, {_BITS.format(x="p_size")} AS bits FROM part GROUP BY 1), q AS (SELECT p_brand AS query, {_BITS.format(x="p_size")} AS want FROM part WHERE p_size <= 20 GROUP BY 1)
    SELECT query, p_brand FROM m, q WHERE list_has_all(bits, want)"""
)
def bloom_subset_screen(spark, sf):
    """Brands whose mask covers that of another brand's small sizes; one row per brand on both sides, of which there are as many as names."""
    parts = table(spark, sf, "part")
    mask = G.bloom_mask(parts, ["p_brand"], F.col("p_size")).select("p_brand", F.struct("w0", "w1", "w2", "w3").alias("m"))
    want = G.bloom_mask(parts.where("p_size <= 20"), ["p_brand"], F.col("p_size")).select(F.col("p_brand").alias("query"), F.struct("w0", "w1", "w2", "w3").alias("q"))
    return mask.join(want, G.covers("m", "q")).select("query", "p_brand")


@query("SELECT x.s_suppkey AS a, y.s_suppkey AS b, bit_count(xor(x.s_suppkey * 2654435761, y.s_suppkey * 2654435761))::INT AS distance FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey")
def hamming_pairs(spark, sf):
    """Hamming distances inside blocks of equal nation."""
    rows = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") * F.lit(2_654_435_761)).alias("h"))
    other = rows.select("s_nationkey", F.col("s_suppkey").alias("b"), F.col("h").alias("h2"))
    pairs = rows.join(other, "s_nationkey").where("s_suppkey < b")
    return pairs.select(F.col("s_suppkey").alias("a"), "b", F.bit_count(F.col("h").bitwiseXOR(F.col("h2"))).alias("distance"))


@query(f"SELECT p_type, p_size, {product_sql('((p_partkey % 251 + 17) % 251)')} AS signature, count(*) AS members FROM part GROUP BY 1, 2")
def isosteric_buckets(spark, sf):
    """Blocks of equal metadata with the signature of their members."""
    from sigmafold.operators import laws

    s = laws.multiset_signature(table(spark, sf, "part"), ["p_type", "p_size"], _e("p_partkey"), FP251, [17])
    return s.select("p_type", "p_size", F.col("product_0").alias("signature"), F.col("n").alias("members"))


@query("SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_partkey < y.p_partkey WHERE (x.p_size - y.p_size) ** 2 + ((x.p_retailprice - y.p_retailprice) / 10) ** 2 <= 4")
def near_pairs_within_cutoff(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return G.near_pairs(rows, "p_partkey", ["x", "y"], 2.0, [1.0, 10.0])


# --- profiles ---------------------------------------------------------------------------------------------


_DEGREES = f"""WITH a AS ({_ARCS}), v AS (SELECT src AS v FROM a UNION SELECT dst FROM a),
o AS (SELECT src AS v, count(*) AS r, sum(mult)::BIGINT AS m FROM a GROUP BY 1), i AS (SELECT dst AS v, count(*) AS r, sum(mult)::BIGINT AS m FROM a GROUP BY 1),
s AS (SELECT v, count(DISTINCT w) AS d FROM (SELECT src AS v, dst AS w FROM a UNION ALL SELECT dst, src FROM a) GROUP BY 1)"""


@query(
    f"""{_DEGREES} SELECT coalesce(s.d, 0) AS support, coalesce(o.r, 0)::BIGINT AS out_records, coalesce(i.r, 0)::BIGINT AS in_records, coalesce(o.m, 0) AS out_mult, coalesce(i.m, 0) AS in_mult, count(*) AS vertices
    FROM v LEFT JOIN o USING (v) LEFT JOIN i USING (v) LEFT JOIN s USING (v) GROUP BY 1, 2, 3, 4, 5"""
)
def degree_joint_histogram(spark, sf):
    return P.joint_degrees(_supply(spark, sf)).drop("graph_id")


_ADJ = f"WITH e AS MATERIALIZED ({_EDGES}), n AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)"


def _no(x: str, y: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM n WHERE n.a = {x} AND n.b = {y})"


@query(
    f"""{_ADJ} SELECT 'path' AS pattern, count(*) AS n FROM n x JOIN n y ON x.b = y.a JOIN n z ON y.b = z.a
      WHERE x.a < z.b AND x.a <> y.b AND z.b <> x.b AND {_no('x.a', 'y.b')} AND {_no('x.b', 'z.b')} AND {_no('x.a', 'z.b')}
    UNION ALL SELECT 'claw', count(*) FROM n x JOIN n y ON x.a = y.a AND x.b < y.b JOIN n z ON x.a = z.a AND y.b < z.b WHERE {_no('x.b', 'y.b')} AND {_no('x.b', 'z.b')} AND {_no('y.b', 'z.b')}
    UNION ALL SELECT 'cycle', count(*) FROM n x JOIN n y ON x.b = y.a JOIN n z ON y.b = z.a JOIN n w ON z.b = w.a AND w.b = x.a
      WHERE x.a < x.b AND x.a < y.b AND x.a < z.b AND x.b < z.b AND {_no('x.a', 'y.b')} AND {_no('x.b', 'z.b')}
    UNION ALL SELECT 'paw', count(*) FROM n x JOIN n y ON x.a = y.a AND x.b < y.b JOIN n t ON t.a = x.b AND t.b = y.b JOIN n z ON z.a = x.a WHERE z.b NOT IN (x.b, y.b) AND {_no('z.b', 'x.b')} AND {_no('z.b', 'y.b')}
    UNION ALL SELECT 'diamond', count(*) FROM e JOIN n x ON x.a = e.a JOIN n x2 ON x2.a = e.b AND x2.b = x.b JOIN n y ON y.a = e.a AND y.b > x.b JOIN n y2 ON y2.a = e.b AND y2.b = y.b WHERE {_no('x.b', 'y.b')}
    UNION ALL SELECT 'clique', count(*) FROM e ab JOIN e bc ON ab.b = bc.a JOIN e ac ON ac.a = ab.a AND ac.b = bc.b JOIN e cd ON cd.a = bc.b JOIN e ad ON ad.a = ab.a AND ad.b = cd.b JOIN e bd ON bd.a = ab.b AND bd.b = cd.b"""
)
def pattern_counts_order4(spark, sf):
    return P.order4_patterns(_follow(spark, sf)).drop("graph_id")


@query(
    f"""{_ADJ}, p2 AS (SELECT x.a, y.b, count(*) AS w FROM n x JOIN n y ON x.b = y.a GROUP BY 1, 2), p3 AS (SELECT x.a, y.b, sum(x.w)::BIGINT AS w FROM p2 x JOIN n y ON x.b = y.a GROUP BY 1, 2),
    v AS (SELECT DISTINCT a AS v FROM n)
    SELECT v, 1 AS length, 0::BIGINT AS walks FROM v UNION ALL SELECT v, 2, coalesce(w, 0) % 251 FROM v LEFT JOIN p2 ON p2.a = v AND p2.b = v UNION ALL SELECT v, 3, coalesce(w, 0) % 251 FROM v LEFT JOIN p3 ON p3.a = v AND p3.b = v"""
)
def closed_walks_by_vertex(spark, sf):
    return P.vertex_walks(_follow(spark, sf), 3).drop("graph_id")


@query(
    f"""WITH a AS ({_FOLLOW}), s AS (SELECT * FROM a WHERE src <> dst)
    SELECT 1 AS length, 0::BIGINT AS trace UNION ALL SELECT 2, 0 UNION ALL
    SELECT 3, (coalesce(sum(x.mult * y.mult * z.mult), 0) % 65521)::BIGINT FROM s x JOIN s y ON x.dst = y.src AND y.dst <> x.src JOIN s z ON y.dst = z.src AND z.dst = x.src"""
)
def nonbacktracking_traces(spark, sf):
    return P.nonbacktracking_traces(_follow(spark, sf), 3, 65521).drop("graph_id")


def _order_graphs(spark, sf):
    """A graph for each order: its parts and suppliers, an edge for each line."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") * 2).alias("p"), (F.col("l_suppkey") * 2 + 1).alias("s"))
    return _both_ways(lines)


def _both_ways(lines):
    ends = lines.select(F.col("l_orderkey").cast("string").alias("graph_id"), F.inline(F.array(F.struct(F.col("p").alias("src"), F.col("s").alias("dst")), F.struct(F.col("s").alias("src"), F.col("p").alias("dst")))))
    return ends.groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).alias("mult")).select("graph_id", "src", "dst", F.lit("edge").alias("relation"), F.lit("").alias("role"), "mult")


_ORDER_A = "SELECT g, src, dst, count(*) AS w FROM (SELECT l_orderkey AS g, l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey * 2 + 1, l_partkey * 2 FROM lineitem) GROUP BY 1, 2, 3"
_ORDER_POWERS = f"""WITH a AS MATERIALIZED ({_ORDER_A}), b AS MATERIALIZED (SELECT x.g, x.src, y.dst, sum(x.w * y.w)::BIGINT AS w FROM a x JOIN a y ON x.g = y.g AND x.dst = y.src GROUP BY 1, 2, 3),
c AS MATERIALIZED (SELECT x.g, x.src, y.dst, sum(x.w * y.w)::BIGINT AS w FROM b x JOIN a y ON x.g = y.g AND x.dst = y.src GROUP BY 1, 2, 3),
w AS (SELECT g, src, dst, coalesce(a.w, 0) AS w1, coalesce(b.w, 0) AS w2, coalesce(c.w, 0) AS w3 FROM a FULL JOIN b USING (g, src, dst) FULL JOIN c USING (g, src, dst))"""


@query(f"{_ORDER_POWERS} " + " UNION ALL ".join(f"SELECT g::VARCHAR AS graph_id, '{i}{j}{k}' AS triple, (sum(w{i}::HUGEINT * w{j} * w{k}) % 251)::BIGINT AS value FROM w GROUP BY 1" for i, j, k in P.THETA))
def theta_by_order(spark, sf):
    """All six contractions of each order's graph of parts and suppliers."""
    return P.theta_contractions(_order_graphs(spark, sf))


@query("SELECT l_orderkey * 2 + 1 AS src, l_partkey * 2 AS dst, count(*) AS mult FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_partkey * 2, l_orderkey * 2 + 1, count(*) FROM lineitem GROUP BY 1, 2")
def clauses_to_hyperedges(spark, sf):
    """Orders as clauses over parts."""
    return P.from_clauses(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")[1].select("src", "dst", "mult")


@query("SELECT 2::BIGINT AS graphs, 1::BIGINT AS digests, 1::BIGINT AS transcripts, 1::BIGINT AS degree_histograms")
def invariance_under_renumbering(spark, sf):
    """The supply graph and a renumbered one have equal digests, transcripts and degree histograms."""
    arcs = _supply(spark, sf)
    other = arcs.withColumns({"graph_id": F.lit("h"), "src": F.col("src") * 7 + 3, "dst": F.col("dst") * 7 + 3})
    both = materialise(arcs.unionByName(other), "arcs")
    vertices = _vertices_of(both)
    layers = materialise(G.label_layers(vertices, both, 3), "layers")
    histogram = P.joint_degrees(both).select("graph_id", F.sha2(F.concat_ws("|", *P.DEGREES, "vertices"), 256).alias("d"))
    found = P.hybrid_digest(vertices, both, layers).join(P.transcript(layers), "graph_id").join(P.ordered_digest(histogram, ["graph_id"], "d").select("graph_id", F.col("digest").alias("h")), "graph_id")
    return found.agg(F.count(F.lit(1)).alias("graphs"), F.count_distinct("digest").alias("digests"), F.count_distinct("transcript").alias("transcripts"), F.count_distinct("h").alias("degree_histograms"))


_SUPPLIED = f"SELECT count(*) FROM (SELECT src FROM ({_ARCS}) UNION SELECT dst FROM ({_ARCS}))"


@query(f"SELECT ({_SUPPLIED}) * 4 AS labels, 0::BIGINT AS differing")
def incremental_labels(spark, sf):
    """Labels of three rounds after the lines of one part are gone, by the cone alone and by all rounds again: equal everywhere."""
    before = materialise(_supply(spark, sf), "arcs")
    vertices = materialise(_vertices_of(before), "vertices")
    least = before.agg(F.min("src")).first()[0]
    after = before.withColumn("mult", F.when(F.col("src") == least, F.col("mult") + 1).otherwise(F.col("mult")))
    updated, _ = G.update_layers(materialise(G.label_layers(vertices, before, 3), "layers"), vertices, before, after, 3)
    again = G.label_layers(vertices, after, 3).withColumnRenamed("labels", "again")
    both = updated.join(again, ["graph_id", "v", "round"], "full_outer")
    return both.agg(F.count(F.lit(1)).alias("labels"), F.count_if(~F.col("labels").eqNullSafe(F.col("again"))).alias("differing"))


@query(
    f"""WITH RECURSIVE a AS MATERIALIZED ({_ERRORS}), b AS MATERIALIZED (SELECT src AS v, dst AS w FROM a UNION SELECT dst, src FROM a),
    r AS (SELECT min(src) AS v, 0 AS round FROM a UNION SELECT b.w, r.round + 1 FROM r JOIN b ON r.v = b.v WHERE r.round < 3)
    SELECT k AS round, count(DISTINCT v) AS vertices FROM (SELECT unnest(range(0, 4))::INT AS k) JOIN r ON r.round <= k GROUP BY 1"""
)
def cone_sizes(spark, sf):
    """How far a change at one user may reach, round by round."""
    arcs = materialise(_follow(spark, sf, "error"), "arcs")
    return P.cone(arcs, arcs.agg(F.first("graph_id").alias("graph_id"), F.min("src").alias("v")), 3).drop("graph_id")


@query(
    f"""WITH a AS MATERIALIZED ({_ERRORS}), b AS MATERIALIZED (SELECT src AS v, dst AS w FROM a UNION SELECT dst, src FROM a), v AS (SELECT DISTINCT v FROM b),
    two AS (SELECT v, v AS w FROM v UNION FROM b UNION SELECT x.v, y.w FROM b x JOIN b y ON x.w = y.v) SELECT v, count(DISTINCT w % 256) AS bits FROM two GROUP BY 1"""
)
def neighbour_mask_bits(spark, sf):
    """Bits of the masks of all users within two steps."""
    arcs = materialise(_follow(spark, sf, "error"), "arcs")
    masks = P.neighbour_masks(_vertices_of(arcs), arcs, 2)
    return masks.select("v", sum((F.bit_count(f"w{k}") for k in range(4)), F.lit(0)).cast("bigint").alias("bits"))


_STARS = "WITH k AS (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1), s AS (SELECT c, count(*) AS nations FROM k GROUP BY 1)"


@query(f"{_STARS} SELECT (count(*) * 2)::BIGINT AS exact_cells, (count(*) * 2)::BIGINT AS field_cells, 0::BIGINT AS aliased, (sum(CASE WHEN nations > 1 THEN nations ELSE 0 END) + sum(CASE WHEN nations * c > 1 THEN nations * c ELSE 0 END))::BIGINT AS ambiguous FROM s")
def degeneracy_of_stars(spark, sf):
    """Customers around their nations: exact cells against field labels."""
    rows = table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("src"), (F.col("c_nationkey").cast("bigint") * 2 + 1).alias("dst"))
    arcs = materialise(G.arcs_of(rows, "src", "dst"), "arcs")
    vertices = _vertices_of(arcs)
    return P.degeneracy(materialise(G.label_layers(vertices, arcs, 4), "layers"), G.stable_partition(vertices, arcs)).drop("graph_id")


@query("SELECT 'complete' AS status, count(*) AS triangles, 0::BIGINT AS cliques4 FROM part")
def motifs_of_a_regular_graph(spark, sf):
    """Parts in a ring, each linked to the two behind it: as regular as can be, so its motifs are counted."""
    from pyspark.sql import Window

    # Places in the order of keys, whatever gaps these have: numbered inside ranges, behind the rows of the ranges before.
    keys = table(spark, sf, "part").select("p_partkey").repartitionByRange("p_partkey").sortWithinPartitions("p_partkey")
    keys = materialise(keys.withColumn("id", F.monotonically_increasing_id()).select(F.expr("id >> 33").alias("range"), F.expr("id & 8589934591").alias("at")), "places")
    sizes = keys.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    n = keys.count()
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    rows = keys.join(F.broadcast(before), "range").select((F.col("before") + F.col("at")).alias("src"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    arcs = materialise(G.arcs_of(rows.withColumn("dst", F.pmod(F.col("src") + F.col("k"), F.lit(n))), "src", "dst", directed=False), "arcs")
    return P.bounded_motifs(_vertices_of(arcs), arcs).drop("graph_id")


@query(
    """WITH c AS (SELECT l_orderkey AS candidate, l_partkey % 40 AS item, count(*) AS k FROM lineitem GROUP BY 1, 2), q AS (SELECT candidate AS query, item, k AS want FROM c WHERE candidate % 100 = 0)
    SELECT query, candidate FROM q JOIN c USING (item) WHERE k >= want GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM q q2 WHERE q2.query = q.query)"""
)
def screening_cascade(spark, sf):
    """Orders whose kinds of parts hold those of each hundredth order: rarest kind, masks, then counts."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 40).alias("item"))
    return P.screen(lines, lines.where("l_orderkey % 100 = 0"), "l_orderkey", "item")
