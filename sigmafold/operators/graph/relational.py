"""Graph operators as joins, aggregates and rounds over whole tables."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmafold.functions.fields import FP251, PrimeField
from sigmafold.operators import laws
from sigmafold.operators.components import connected_components
from sigmafold.runtime import materialise, release

ENTITY, HYPEREDGE = 1, 2
ARC = ["graph_id", "src", "dst", "relation", "role"]


# --- building -------------------------------------------------------------------------------------


def arcs_of(rows: DataFrame, src: str, dst: str, graph_id: Column | None = None, relation: Column | None = None, directed: bool = True) -> DataFrame:
    """Canonical arcs: equal ones merged into a multiplicity; an undirected edge is two arcs, a loop one."""
    one = rows.select(
        (graph_id if graph_id is not None else F.lit("g")).alias("graph_id"), F.col(src).alias("src"), F.col(dst).alias("dst"),
        (relation if relation is not None else F.lit("edge")).alias("relation"), F.lit("").alias("role"),
    )
    if not directed:
        one = one.unionByName(one.where("src <> dst").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "role"))
    return one.groupBy(*ARC).agg(F.count(F.lit(1)).alias("mult"))


def hyperedge_arcs(clauses: DataFrame, edge: str, member: str, role: str) -> DataFrame:
    """A hyperedge as a vertex with arcs to and from every member, under the member's role."""
    there = clauses.select(F.lit("g").alias("graph_id"), F.col(edge).alias("src"), F.col(member).alias("dst"), F.lit("hyperedge-incidence").alias("relation"), F.col(role).alias("role"))
    back = there.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "role")
    return there.unionByName(back).groupBy(*ARC).agg(F.count(F.lit(1)).alias("mult"))


def support_edges(arcs: DataFrame) -> DataFrame:
    """graph_id, a < b: pairs of different vertices with an arc in either direction."""
    return arcs.where("src <> dst").select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def induced(vertices: DataFrame, arcs: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subgraph on the vertices (graph_id, v) of ``keep``."""
    inside = arcs.join(keep.select("graph_id", F.col("v").alias("src")), ["graph_id", "src"], "left_semi")
    return vertices.join(keep, ["graph_id", "v"], "left_semi"), inside.join(keep.select("graph_id", F.col("v").alias("dst")), ["graph_id", "dst"], "left_semi")


def boundary(arcs: DataFrame, keep: DataFrame) -> DataFrame:
    """Arcs that leave ``keep``; none means that it is closed."""
    leaving = arcs.join(keep.select("graph_id", F.col("v").alias("src")), ["graph_id", "src"], "left_semi")
    return leaving.join(keep.select("graph_id", F.col("v").alias("dst")), ["graph_id", "dst"], "left_anti")


def apply_delta(arcs: DataFrame, changes: DataFrame) -> DataFrame:
    """Arcs after signed multiplicities (the arc columns and ``change``); removing more than there is raises, zero deletes the arc."""
    both = arcs.unionByName(changes.select(*ARC, F.col("change").alias("mult")))
    total = both.groupBy(*ARC).agg(F.sum("mult").alias("mult"))
    return total.withColumn("mult", F.when(F.col("mult") < 0, F.raise_error(F.lit("arc multiplicity below zero"))).otherwise(F.col("mult"))).where("mult > 0")


# --- degrees ----------------------------------------------------------------------------------------


def degrees(arcs: DataFrame) -> DataFrame:
    """graph_id, v, out_records, in_records, out_mult, in_mult, loops, support of every vertex with an arc."""
    ends = arcs.select("graph_id", F.explode(F.array(
        F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("mult").alias("om"), F.lit(0).cast("bigint").alias("im"), (F.col("src") == F.col("dst")).cast("int").alias("loop")),
        F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).cast("bigint").alias("om"), F.col("mult").alias("im"), F.lit(0).alias("loop")),
    )).alias("e")).select("graph_id", "e.*")
    sums = ends.groupBy("graph_id", "v").agg(
        F.sum("o").alias("out_records"), F.sum("i").alias("in_records"), F.sum("om").alias("out_mult"), F.sum("im").alias("in_mult"), F.sum("loop").alias("loops")
    )
    support = support_edges(arcs)
    each = support.select("graph_id", F.explode(F.array("a", "b")).alias("v")).groupBy("graph_id", "v").agg(F.count(F.lit(1)).alias("support"))
    return sums.join(each, ["graph_id", "v"], "left").na.fill(0, ["support"])


def degree_histogram(arcs: DataFrame, kind: str) -> DataFrame:
    """graph_id, degree, vertices, for one of the degree columns."""
    return degrees(arcs).groupBy("graph_id", F.col(kind).alias("degree")).agg(F.count(F.lit(1)).alias("vertices"))


# --- components ---------------------------------------------------------------------------------------


def weak_components(arcs: DataFrame) -> DataFrame:
    """v, component (least vertex) of one graph."""
    return connected_components(arcs, "src", "dst").withColumnRenamed("vertex", "v")


def strong_components(arcs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """v, component of one graph: colour forward by the least vertex that reaches, then take who is reached backward within the colour."""
    left = materialise(arcs.where("src <> dst").select("src", "dst").distinct(), "arcs")
    open_ = materialise(arcs.select(F.explode(F.array("src", "dst")).alias("v")).distinct(), "open")
    done = None
    for _ in range(most_rounds):
        if open_.isEmpty():
            return done if done is not None else open_.withColumn("component", F.col("v"))
        color = _spread(open_.withColumn("color", F.col("v")), left)
        inside = left.join(color.select(F.col("v").alias("src"), "color"), "src").join(color.select(F.col("v").alias("dst"), F.col("color").alias("color2")), "dst").where("color = color2")
        inside = materialise(inside.select("src", "dst"), "inside")
        # Vertices that reach their colour's root within the colour form its component.
        back = color.withColumn("hit", F.when(F.col("v") == F.col("color"), F.lit(0)).otherwise(F.lit(1)))
        found = _spread(back.select("v", F.col("hit").alias("color")), inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("color = 0")
        closed = materialise(color.join(found.select("v"), "v", "left_semi").select("v", F.col("color").alias("component")), "closed")
        done = closed if done is None else done.unionByName(closed)
        open_ = materialise(open_.join(closed, "v", "left_anti"), "open")
        left = materialise(inside.join(closed.select(F.col("v").alias("src")), "src", "left_anti").join(closed.select(F.col("v").alias("dst")), "dst", "left_anti"), "arcs")
    raise RuntimeError("too many rounds")


def _spread(colors: DataFrame, arcs: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """Least color over all vertices that reach a vertex."""
    colors = materialise(colors, "colors")
    for _ in range(most_rounds):
        near = arcs.join(colors.select(F.col("v").alias("src"), "color"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("color").alias("near"))
        nxt = materialise(colors.join(near, "v", "left").select("v", F.col("color").alias("was"), F.least("color", "near").alias("color")), "colors")
        colors = nxt.select("v", "color")
        if nxt.where("color < was").isEmpty():
            return colors
    raise RuntimeError("too many rounds")


def global_profile(arcs: DataFrame) -> DataFrame:
    """component, vertices, records, mult, support_edges, loops, cycle_rank of each weak component of one graph."""
    comp = materialise(weak_components(arcs), "weak")
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("vertices"))
    owned = arcs.join(comp.withColumnRenamed("v", "src"), "src")
    sums = owned.groupBy("component").agg(F.count(F.lit(1)).alias("records"), F.sum("mult").alias("mult"), F.sum((F.col("src") == F.col("dst")).cast("bigint")).alias("loops"))
    edges = support_edges(arcs).join(comp.withColumnRenamed("v", "a"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("support_edges"))
    out = size.join(sums, "component", "left").join(edges, "component", "left").na.fill(0)
    return out.withColumn("cycle_rank", F.greatest(F.lit(0).cast("bigint"), F.col("support_edges") + 1 - F.col("vertices")))


# --- motifs and patterns ------------------------------------------------------------------------------


def _ranked_edges(arcs: DataFrame) -> DataFrame:
    """Support edges from the end of lower degree to the other: a vertex has few edges ahead, however many it has."""
    edges = support_edges(arcs)
    degree = edges.select("graph_id", F.explode(F.array("a", "b")).alias("v")).groupBy("graph_id", "v").agg(F.count(F.lit(1)).alias("d"))
    both = edges.join(degree.select("graph_id", F.col("v").alias("a"), F.col("d").alias("da")), ["graph_id", "a"]).join(degree.select("graph_id", F.col("v").alias("b"), F.col("d").alias("db")), ["graph_id", "b"])
    ahead = F.struct("da", "a") < F.struct("db", "b")
    return both.select("graph_id", F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("w"))


def triangles(arcs: DataFrame) -> DataFrame:
    """graph_id, x, y, z of every triangle once."""
    e = materialise(_ranked_edges(arcs), "ranked")
    wedges = e.select("graph_id", F.col("u").alias("x"), F.col("w").alias("y")).join(e.select("graph_id", F.col("u").alias("x"), F.col("w").alias("z")), ["graph_id", "x"]).where("y <> z")
    return wedges.join(e.select("graph_id", F.col("u").alias("y"), F.col("w").alias("z")), ["graph_id", "y", "z"]).select("graph_id", "x", "y", "z")


def cliques4(arcs: DataFrame) -> DataFrame:
    """graph_id, x, y, z, t of every clique of four once."""
    tri = materialise(triangles(arcs), "triangles")
    e = _ranked_edges(arcs)
    four = tri.join(tri.select("graph_id", "x", "y", F.col("z").alias("t")), ["graph_id", "x", "y"]).where("z <> t")
    return four.join(e.select("graph_id", F.col("u").alias("z"), F.col("w").alias("t")), ["graph_id", "z", "t"]).select("graph_id", "x", "y", "z", "t")


def order3_patterns(arcs: DataFrame) -> DataFrame:
    """graph_id, pattern (edge, path, triangle), n: connected induced subgraphs of up to three vertices, loops aside."""
    edges = support_edges(arcs)
    degree = edges.select("graph_id", F.explode(F.array("a", "b")).alias("v")).groupBy("graph_id", "v").agg(F.count(F.lit(1)).alias("d"))
    e = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    wedge = degree.groupBy("graph_id").agg(F.sum(F.expr("d * (d - 1) div 2")).alias("wedges"))
    tri = triangles(arcs).groupBy("graph_id").agg(F.count(F.lit(1)).alias("t"))
    all_ = e.join(wedge, "graph_id").join(tri, "graph_id", "left").na.fill(0, ["t"])
    return all_.select("graph_id", F.inline(F.array(
        F.struct(F.lit("edge").alias("pattern"), F.col("n").alias("n")),
        F.struct(F.lit("path").alias("pattern"), (F.col("wedges") - 3 * F.col("t")).alias("n")),
        F.struct(F.lit("triangle").alias("pattern"), F.col("t").alias("n")),
    )))


def transitions(arcs: DataFrame) -> DataFrame:
    """Non-backtracking steps: arc u -> v, then arc v -> w, unless w = u and u <> v."""
    a = arcs.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"), F.col("mult").alias("m1"))
    b = arcs.select("graph_id", F.col("src").alias("v"), F.col("dst").alias("w"), F.col("mult").alias("m2"))
    return a.join(b, ["graph_id", "v"]).where("w <> u or u = v").select("graph_id", "u", "v", "w", (F.col("m1") * F.col("m2")).alias("weight"))


def walk_traces(arcs: DataFrame, most: int, modulus: int) -> DataFrame:
    """graph_id, length, trace of A, A**2, ..., modulo a prime below 2**31: sparse products by joins, one per step."""
    a = materialise(arcs.groupBy("graph_id", "src", "dst").agg(F.pmod(F.sum("mult"), F.lit(modulus)).alias("w")), "matrix")
    power, out = a, None
    for length in range(1, most + 1):
        trace = power.where("src = dst").groupBy("graph_id").agg(F.pmod(F.sum("w"), F.lit(modulus)).alias("trace")).withColumn("length", F.lit(length))
        trace = a.select("graph_id").distinct().join(trace.drop("length"), "graph_id", "left").na.fill(0, ["trace"]).withColumn("length", F.lit(length))
        out = trace if out is None else out.unionByName(trace)
        if length < most:
            step = power.join(a.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("w").alias("w2")), ["graph_id", "dst"])
            power = materialise(step.groupBy("graph_id", "src", F.col("to").alias("dst")).agg(F.pmod(F.sum(F.pmod(F.col("w") * F.col("w2"), F.lit(modulus))), F.lit(modulus)).alias("w")), "matrix")
    return out.select("graph_id", "length", "trace")


# --- partitions and labels --------------------------------------------------------------------------------


def stable_partition(vertices: DataFrame, arcs: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """graph_id, v, color, cell_size: the coarsest stable partition (1-WL), colors comparable across graphs.

    A color is the hash of the own color and the sorted neighbour colors with relation, role and
    multiplicity, outward and inward; rounds stop when no graph's number of cells grows.  A long path
    takes about half as many rounds as it has vertices; more than ``most_rounds`` raise.
    """
    out_in = materialise(arcs.select("graph_id", F.col("src").alias("v"), F.col("dst").alias("w"), F.concat_ws("|", F.lit(">"), "relation", "role", "mult").alias("how")).unionByName(
        arcs.select("graph_id", F.col("dst").alias("v"), F.col("src").alias("w"), F.concat_ws("|", F.lit("<"), "relation", "role", "mult").alias("how"))), "incidence")
    first = vertices.select("graph_id", "v", F.sha2(F.concat_ws("|", F.col("kind").cast("string"), F.coalesce("label", F.lit(""))), 256).alias("color"))
    colors = materialise(first, "colors")
    cells = colors.select("graph_id", "color").distinct().count()
    for _ in range(most_rounds):
        seen = out_in.join(colors.select("graph_id", F.col("v").alias("w"), F.col("color").alias("c")), ["graph_id", "w"])
        # Equal neighbours are counted first, so a hub's list holds each kind of neighbour once.
        kinds = seen.groupBy("graph_id", "v", "how", "c").agg(F.count(F.lit(1)).alias("k"))
        near = kinds.groupBy("graph_id", "v").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("|", "how", "c", "k")))).alias("near"))
        nxt = colors.join(near, ["graph_id", "v"], "left").select("graph_id", "v", F.sha2(F.concat_ws("#", "color", F.coalesce("near", F.lit(""))), 256).alias("color"))
        nxt = materialise(nxt, "colors")
        n = nxt.select("graph_id", "color").distinct().count()
        if n == cells:
            release(nxt)
            break
        release(colors)
        colors, cells = nxt, n
    else:
        raise RuntimeError(f"not stable after {most_rounds} rounds")
    sizes = colors.groupBy("graph_id", "color").agg(F.count(F.lit(1)).alias("cell_size"))
    return colors.join(sizes, ["graph_id", "color"]).select("graph_id", "v", "color", "cell_size")


def cell_moments(values: DataFrame, cell: list[str], x: Column, degree: int, field: PrimeField = FP251) -> DataFrame:
    """cell, n, and the power sums of degree 1..``degree`` in the field."""
    powers, current = [], x
    for k in range(1, degree + 1):
        powers.append(F.pmod(F.sum(current), F.lit(field.p)).alias(f"m{k}"))
        current = field.c_mul(current, x)
    return values.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *powers)


def _label_parameters(lanes: int, p: int) -> dict[str, list[int]]:
    import hashlib

    def parameter(purpose: str, lane: int, banned: tuple[int, ...]) -> int:
        for attempt in range(2048):
            value = int.from_bytes(hashlib.sha256(f"label-parameter|{purpose}|{lane}|{attempt}".encode()).digest()[:8], "little") % p
            if value not in banned:
                return value
        raise ValueError("no parameter found")

    banned = {"salt": (), "neighbour": (0,), "offset": (), "update": (0, 1)}
    return {purpose: [parameter(purpose, k, out) for k in range(lanes)] for purpose, out in banned.items()}


def _label_incidence(arcs: DataFrame, p: int) -> DataFrame:
    """graph_id, v, w, side, token, mult: every arc seen from both ends."""
    token = F.pmod(F.crc32(F.concat_ws("|", "relation", "role")), F.lit(p))
    return arcs.select("graph_id", F.col("src").alias("v"), F.col("dst").alias("w"), F.lit(0).alias("side"), token.alias("token"), "mult").unionByName(
        arcs.select("graph_id", F.col("dst").alias("v"), F.col("src").alias("w"), F.lit(1).alias("side"), token.alias("token"), "mult")
    )


def _first_labels(vertices: DataFrame, both: DataFrame, parameters: dict, p: int) -> DataFrame:
    weight = both.groupBy("graph_id", "v").agg(F.sum(F.when(F.col("side") == 0, F.col("mult"))).alias("om"), F.sum(F.when(F.col("side") == 1, F.col("mult"))).alias("im"))
    start = vertices.join(weight, ["graph_id", "v"], "left").na.fill(0, ["om", "im"])
    seed = F.crc32(F.concat_ws("|", F.col("kind").cast("string"), F.coalesce("label", F.lit("")), F.col("om").cast("string"), F.col("im").cast("string")))
    return start.select("graph_id", "v", *[F.pmod(seed + F.lit(x), F.lit(p)).alias(f"l{k}") for k, x in enumerate(parameters["salt"])])


def _next_labels(labels: DataFrame, mine: DataFrame, both: DataFrame, r: int, parameters: dict, field: PrimeField) -> DataFrame:
    """Labels of the vertices of ``mine`` after round ``r``, from those of all vertices before it; ``both`` holds the arcs of ``mine`` at least."""
    p, lanes = field.p, len(parameters["salt"])
    seen = both.join(labels.withColumnRenamed("v", "w"), ["graph_id", "w"])
    aggregates = []
    for k in range(lanes):
        f = F.pmod(F.col(f"l{k}") * F.lit(parameters["neighbour"][k]) + F.col("token") + F.lit(parameters["offset"][k]) + F.col("side") * F.lit(parameters["salt"][k]), F.lit(p))
        for side in (0, 1):
            m = F.when(F.col("side") == side, F.col("mult")).otherwise(F.lit(0))
            aggregates += [laws.multiset_product(field, f, m).alias(f"p{k}{side}"), laws.multiset_zeros(f, m).alias(f"z{k}{side}")]
    joined = mine.join(seen.groupBy("graph_id", "v").agg(*aggregates), ["graph_id", "v"], "left")
    out = []
    for k in range(lanes):
        x, u = F.col(f"l{k}"), F.lit(parameters["update"][k])
        for side in (0, 1):
            for term in (F.coalesce(F.col(f"p{k}{side}"), F.lit(1)), F.coalesce(F.col(f"z{k}{side}"), F.lit(0)) * F.lit(7 + side)):
                x = F.pmod(x * u + term, F.lit(p))
        out.append(F.pmod(x * u + F.lit(r), F.lit(p)).alias(f"l{k}"))
    return joined.select("graph_id", "v", *out)


def label_layers(vertices: DataFrame, arcs: DataFrame, rounds: int = 6, lanes: int = 3, field: PrimeField = FP251, stop: int | None = None) -> DataFrame:
    """graph_id, v, round, labels: field labels of every vertex at each round from 0, one per lane.

    A round maps a label L to ((((L u + Out) u + z_out) u + In) u + z_in) u + t, where Out and In are the
    products over neighbours of (label n + relation + offset) to the multiplicity, zero factors counted
    apart.  Products are sums of logarithms, so a hub is aggregated in parts.  With ``stop`` the rounds
    end behind that one as soon as a round splits no cell.
    """
    parameters = _label_parameters(lanes, field.p)
    both = materialise(_label_incidence(arcs, field.p), "incidence")
    names = [f"l{k}" for k in range(lanes)]
    layers = [materialise(_first_labels(vertices, both, parameters, field.p), "labels")]
    cells = layers[0].distinct().select("graph_id", *names).distinct().count() if stop is not None else 0
    for r in range(1, rounds + 1):
        layers.append(materialise(_next_labels(layers[-1], layers[-1], both, r, parameters, field), "labels"))
        if stop is not None:
            n = layers[-1].select("graph_id", *names).distinct().count()
            if r >= stop and n == cells:
                break
            cells = n
    release(both)
    out = None
    for r, layer in enumerate(layers):
        one = layer.select("graph_id", "v", F.lit(r).alias("round"), F.array(*names).alias("labels"))
        out = one if out is None else out.unionByName(one)
    return out


def label_rounds(vertices: DataFrame, arcs: DataFrame, rounds: int = 6, lanes: int = 3, field: PrimeField = FP251) -> DataFrame:
    """graph_id, v, labels: the last of ``label_layers``."""
    return label_layers(vertices, arcs, rounds, lanes, field).where(F.col("round") == rounds).drop("round")


def update_layers(layers: DataFrame, vertices: DataFrame, before: DataFrame, after: DataFrame, rounds: int = 6, lanes: int = 3, field: PrimeField = FP251) -> tuple[DataFrame, DataFrame]:
    """``label_layers`` of the graph ``after``, from those of ``before``; and (round, touched): labels computed again.

    A round computes the ends of changed arcs and the neighbours of labels that the round before changed;
    all others keep their labels.
    """
    parameters, names = _label_parameters(lanes, field.p), [f"l{k}" for k in range(lanes)]
    full = [*ARC, "mult"]
    moved = before.select(*full).exceptAll(after.select(*full)).unionByName(after.select(*full).exceptAll(before.select(*full)))
    ends = materialise(moved.select("graph_id", F.explode(F.array("src", "dst")).alias("v")).distinct(), "ends")
    both = materialise(_label_incidence(after, field.p), "incidence")

    def old(r: int) -> DataFrame:
        return layers.where(F.col("round") == r).select("graph_id", "v", *[F.col("labels")[k].alias(n) for k, n in enumerate(names)])

    def merged(kept: DataFrame, fresh: DataFrame) -> DataFrame:
        return materialise(kept.join(fresh.select("graph_id", "v"), ["graph_id", "v"], "left_anti").unionByName(fresh), "labels")

    def differing(kept: DataFrame, fresh: DataFrame) -> DataFrame:
        return materialise(fresh.exceptAll(kept).select("graph_id", "v"), "changed")

    here = both.join(ends, ["graph_id", "v"], "left_semi")
    fresh = materialise(_first_labels(vertices.join(ends, ["graph_id", "v"], "left_semi"), here, parameters, field.p), "fresh")
    new, touched = [merged(old(0), fresh)], [(0, fresh.count())]
    changed = differing(old(0), fresh)
    for r in range(1, rounds + 1):
        near = both.join(changed.select("graph_id", F.col("v").alias("w")), ["graph_id", "w"], "left_semi").select("graph_id", "v")
        todo = materialise(near.unionByName(changed).unionByName(ends).distinct(), "todo")
        mine, arcs_of_todo = (x.join(todo, ["graph_id", "v"], "left_semi") for x in (new[-1], both))
        fresh = materialise(_next_labels(new[-1], mine, arcs_of_todo, r, parameters, field), "fresh")
        touched.append((r, fresh.count()))
        changed = differing(old(r), fresh)
        new.append(merged(old(r), fresh))
    out = None
    for r, layer in enumerate(new):
        one = layer.select("graph_id", "v", F.lit(r).alias("round"), F.array(*names).alias("labels"))
        out = one if out is None else out.unionByName(one)
    return out, layers.sparkSession.createDataFrame(touched, "round int, touched bigint")


def graph_signature(labels: DataFrame, offsets: list[int], field: PrimeField = FP251) -> DataFrame:
    """graph_id, n, and a multiset state per lane of all vertex labels: disjoint unions multiply."""
    aggregates = []
    for k, offset in enumerate(offsets):
        f = laws.factor(field, F.element_at("labels", k + 1), offset)
        aggregates += [laws.multiset_product(field, f).alias(f"product_{k}"), laws.multiset_zeros(f).alias(f"zeros_{k}")]
    return labels.groupBy("graph_id").agg(*aggregates, F.count(F.lit(1)).alias("n"))


# --- spatial join and bloom masks ----------------------------------------------------------------------------


def near_pairs(points: DataFrame, key: str, axes: list[str], cutoff: float, units: list[float] | None = None) -> DataFrame:
    """a < b within ``cutoff``, a difference along an axis being divided by its unit: points meet in neighbouring cells only, and distances are checked there.

    Equal points are one row for each part of the input, so their pairs need no check of their own, and
    two cells meet once.  Neither side is broadcast, as both grow with the input.
    """
    units = [1.0] * len(axes) if units is None else units
    # A little wider than the cutoff: rounding moves no pair within it apart by two cells.
    cells = [F.floor(F.col(c) / F.lit(cutoff * u * (1 + 1e-9))).cast("bigint").alias(f"c{i}") for i, (c, u) in enumerate(zip(axes, units))]
    kept = points.where(" and ".join(f"`{c}` is not null" for c in [key, *axes]))
    rows = kept.groupBy(*axes, F.spark_partition_id().alias("part")).agg(F.collect_list(key).alias("keys")).select(*[F.col(c).alias(f"x{i}") for i, c in enumerate(axes)], *cells, "keys")
    steps = [s for s in product((-1, 0, 1), repeat=len(axes)) if s >= (0,) * len(axes)]
    here = rows.select(*[F.col(f"x{i}").alias(f"a{i}") for i in range(len(axes))], *[f"c{i}" for i in range(len(axes))], F.col("keys").alias("some"))
    there = rows.select(
        *[F.col(f"x{i}").alias(f"b{i}") for i in range(len(axes))], F.col("keys").alias("others"),
        F.inline(F.array(*[F.struct(*[(F.col(f"c{i}") - F.lit(k)).alias(f"c{i}") for i, k in enumerate(s)], F.lit(not any(s)).alias("same")) for s in steps])),
    )
    apart = [(F.col(f"a{i}") - F.col(f"b{i}")) / F.lit(float(u)) for i, u in enumerate(units)]
    squared = sum((d * d for d in apart), F.lit(0.0))
    met = here.join(there.hint("merge"), [f"c{i}" for i in range(len(axes))]).where(squared <= cutoff * cutoff)
    pairs = met.select("same", "others", F.explode("some").alias("a")).select("same", "a", F.explode("others").alias("b"))
    return pairs.where("not same or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def bloom_mask(df: DataFrame, keys: list[str], item: Column, bits_per_item: int = 6) -> DataFrame:
    """keys, w0..w3: 256-bit union of the items' masks, from their SHA-256."""
    digest = F.sha2(item.cast("string"), 256)
    bits = df.select(*keys, F.explode(F.array(*[F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") for i in range(bits_per_item)])).alias("bit"))
    word = lambda k: F.when(F.expr("bit div 64") == k, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("bigint"))
    return bits.groupBy(*keys).agg(*[F.bit_or(word(k)).alias(f"w{k}") for k in range(4)])


def item_mask(item: Column, bits_per_item: int = 6) -> list[Column]:
    """The four words of one item's mask, as in ``bloom_mask``."""
    digest = F.sha2(item.cast("string"), 256)
    bits = [F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") for i in range(bits_per_item)]
    none = F.lit(0).cast("bigint")
    return [reduce(lambda x, b: x.bitwiseOR(F.when((b / 64).cast("int") == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), b % 64)).otherwise(none)), bits, none) for k in range(4)]


def covers(mask: str, query: str) -> Column:
    """Whether the mask has all bits of the query's: the items may be a subset."""
    out = F.lit(True)
    for k in range(4):
        out = out & (F.col(f"{mask}.w{k}").bitwiseAND(F.col(f"{query}.w{k}")) == F.col(f"{query}.w{k}"))
    return out
