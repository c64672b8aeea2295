"""Fields, laws, tables, reconciliation, trees, graphs, sources and streams against scalar references."""

import itertools
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from sigmafold.functions import fields
from sigmafold.functions.fields import FP251, FP65521, GF2_128, GF2_256, GOLDILOCKS, MERSENNE127
from sigmafold.operators import laws, reconcile, tables, trees
from sigmafold.operators.components import connected_components
from sigmafold.operators.graph import kernels
from sigmafold.operators.graph import relational as G
from sigmafold.sources import formats
from sigmafold.streaming.laws import LogApplier

FIELDS = [FP251, FP65521, GOLDILOCKS, MERSENNE127, GF2_128, GF2_256]


@pytest.mark.parametrize("f", FIELDS)
def test_field_axioms(f):
    rng = random.Random(1)
    draw = lambda: f.reduce(rng.randbytes(f.width))
    for _ in range(20):
        a, b, c = draw(), draw(), draw()
        assert f.mul(a, f.add(b, c)) == f.add(f.mul(a, b), f.mul(a, c))
        assert f.mul(f.mul(a, b), c) == f.mul(a, f.mul(b, c))
        assert f.sub(f.add(a, b), b) == a and f.from_bytes(f.to_bytes(a)) == a
        if a:
            assert f.mul(a, f.inverse(a)) == f.one
    items = [draw() for _ in range(9)] + [0]
    inverses, mask = fields.batch_inverse(f, items)
    assert all(f.mul(a, b) == f.one for a, b, m in zip(items, inverses, mask) if m) and not mask[-1] and inverses[-1] == 0


def test_prime_extras():
    assert FP251.generator == 6 and FP65521.generator == 17
    assert all(FP251.sqrt(x * x % 251) == min(x, 251 - x) for x in range(251))
    with pytest.raises(ValueError):
        fields.PrimeField(91)
    assert GF2_128.trace(1) == 0 and GF2_128.frobenius(5, 128) == 5


@pytest.mark.parametrize("f", [FP251, GOLDILOCKS, GF2_128])
def test_hash_to_field(f):
    a = fields.hash_to_field(f, b"x", b"d", 3)
    assert len(set(a)) == 3 and a == fields.hash_to_field(f, b"x", b"d", 3) != fields.hash_to_field(f, b"y", b"d", 3)


def test_encoders(spark):
    import pyarrow as pa

    data = [b"", b"a", bytes(range(256)) * 40]
    df = spark.createDataFrame([(bytearray(d),) for d in data], "b binary")
    want = [fields.encode_integer(FP251, d, 66) for d in data]
    assert [r.e for r in df.select(fields.c_encode_integer(FP251, F.col("b"), 66).alias("e")).collect()] == want
    assert fields.encode_integers(FP251, pa.array(data), 66) == want


def scalar(items, offset, base):
    add = sum(items) % 251
    factors = [(x + offset) % 251 for x in items]
    product = reduce(lambda a, x: a * x % 251, [x for x in factors if x], 1)
    return add, product, factors.count(0), reduce(lambda a, x: (a * base + x) % 251, items, 0)


@pytest.mark.parametrize("parts", [1, 7])
def test_laws_and_merges(spark, parts):
    rng = random.Random(parts)
    items = [rng.randrange(251) for _ in range(400)] + [234] * 3  # 234 + 17 = 0
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(items)], "k string, i int, x bigint").repartition(parts)
    add, product, zeros, horner = scalar(items, 17, 11)
    e = F.col("x")
    assert laws.additive_signature(df, ["k"], e, FP251).first()[1:] == (add, len(items))
    m = laws.multiset_signature(df, ["k"], e, FP251, [17]).first()
    assert (m.product_0, m.zeros_0, m.n) == (product, zeros, len(items))
    assert laws.sequence_signature(df, ["k"], ["i"], e, FP251, [11]).first().state_0 == horner
    b = laws.bidirectional_signature(df, ["k"], ["i"], e, FP251, 11).first()
    assert (b.forward, b.backward, b.power) == (horner, scalar(items[::-1], 17, 11)[3], pow(11, len(items), 251))
    pieces = df.withColumn("p", F.col("i") % 5)
    merged = laws.merge_multiset(laws.multiset_signature(pieces, ["k", "p"], e, FP251, [17, 53]), ["k"], FP251, 2).first()
    assert (merged.product_0, merged.zeros_0) == (product, zeros)
    runs = df.withColumn("p", F.expr("i div 37"))
    assert laws.merge_sequence(laws.sequence_signature(runs, ["k", "p"], ["i"], e, FP251, [11]), ["k"], ["p"], FP251, [11]).first().state_0 == horner


@pytest.mark.parametrize("f", [GOLDILOCKS, GF2_128])
def test_wide_folds(spark, f):
    rng = random.Random(3)
    items = [f.reduce(rng.randbytes(f.width)) for _ in range(50)] + [f.neg(17)]
    df = spark.createDataFrame([("k", bytearray(f.to_bytes(x))) for x in items], "k string, e binary").repartition(4)
    m = laws.fold_signature(df, ["k"], F.col("e"), f, "multiset", [17]).first()
    factors = [f.add(x, 17) for x in items]
    assert f.from_bytes(bytes(m.states[0])) == reduce(f.mul, [x for x in factors if x], f.one) and m.zeros == [factors.count(0)]
    a = laws.fold_signature(df, ["k"], F.col("e"), f, "additive").first()
    assert f.from_bytes(bytes(a.states[0])) == reduce(f.add, items, f.zero)
    if f is GF2_128:
        x = laws.xor_signature(df, ["k"], F.col("e"), f).first()
        assert (x.limb_0 & (1 << 64) - 1) | (x.limb_1 & (1 << 64) - 1) << 64 == reduce(f.add, items, 0)


def test_law_guards(spark):
    df = spark.createDataFrame([("k", 1)], "k string, x bigint")
    with pytest.raises(ValueError):
        laws.positions(df, ["k"], [])
    with pytest.raises(ValueError):
        laws.check_base(1)
    with pytest.raises(ValueError):
        laws.check_points([3, 3])
    assert laws.context_id(FP251, "e", "multiset", [17]) != laws.context_id(FP251, "e", "multiset", [18])


def test_transactions_fail_whole(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, x string, version int")
    schema = "op string, k int, before_x string, before_version int, after_x string, after_version int"
    good = spark.createDataFrame([("update", 1, "a", 1, "c", 2), ("delete", 2, "b", 1, None, None), ("insert", 3, None, None, "d", 1)], schema)
    assert sorted(map(tuple, tables.apply_transaction(table, good, ["k"], ["x", "version"]).collect())) == [(1, "c", 2), (3, "d", 1)]
    for bad in [("insert", 1, None, None, "x", 1), ("delete", 9, "b", 1, None, None), ("update", 1, "z", 1, "c", 2), ("update", 1, "a", 1, "c", 1)]:
        with pytest.raises(tables.ConflictError):
            tables.apply_transaction(table, spark.createDataFrame([bad], schema), ["k"], ["x", "version"])
    with pytest.raises(tables.ConflictError):
        tables.check_contiguous(spark.createDataFrame([(1,), (3,)], "revision int"), "revision")


def test_reconciliation():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ({v for v in range(8) if rng.random() < 0.5} for _ in range(2))
        xs = reconcile.points(8, 6)
        sketches = [[reduce(lambda acc, v: acc * (x - v) % 251, s, 1) for x in xs] for s in (a, b)]
        found = reconcile.reconcile(sketches[0], len(a), sketches[1], len(b), 8, 6)
        assert found == ((a - b, b - a) if len(a ^ b) <= 6 else None) or len(a ^ b) > 6 and found is None


def test_tree_equals_flat_and_edit_equals_rebuild(spark):
    rng = random.Random(4)
    rows = [(d, i, rng.randrange(251)) for d, n in ((1, 1), (2, 5), (3, 16)) for i in range(n)]
    leaf = spark.createDataFrame(rows, "d int, idx bigint, e bigint")
    nodes = trees.build(trees.leaves(leaf, "d", F.col("e")), "d", FP251, 11)
    want = {d: reduce(lambda a, x: (a * 11 + x) % 251, [e for k, _, e in rows if k == d], 0) for d in (1, 2, 3)}
    assert {r.d: r.state for r in trees.roots(nodes, "d").collect()} == want
    changed = spark.createDataFrame([(3, 7, 9), (2, 4, 1)], "d int, idx bigint, state bigint")
    new = [(d, i, 9 if (d, i) == (3, 7) else 1 if (d, i) == (2, 4) else e) for d, i, e in rows]
    want = {d: reduce(lambda a, x: (a * 11 + x) % 251, [e for k, _, e in new if k == d], 0) for d in (1, 2, 3)}
    assert {r.d: r.state for r in trees.roots(trees.edit(nodes, changed, "d", FP251, 11), "d").collect()} == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 9)] + [(k, k + 1) for k in range(20, 60)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9} | {k: 20 for k in range(20, 61)}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def graph(edges, labels=None):
    n = 1 + max(max(e) for e in edges)
    return kernels.Graph({i: (labels or {}).get(i, "") for i in range(n)}, [(s, d, "edge", "", 1) for a, b in edges for s, d in ((a, b), (b, a))])


def relabel(edges, seed):
    n = 1 + max(max(e) for e in edges)
    to = list(range(n))
    random.Random(seed).shuffle(to)
    return [(to[a], to[b]) for a, b in edges]


ROOK = [((a, b), (c, d)) for a, b, c, d in itertools.product(range(4), repeat=4) if (a, b) < (c, d) and ((a == c) != (b == d))]
SHRIKHANDE = [((a, b), ((a + i) % 4, (b + j) % 4)) for a in range(4) for b in range(4) for i, j in ((0, 1), (1, 0), (1, 1))]


def numbered(edges):
    names = sorted({v for e in edges for v in e})
    return [(names.index(a), names.index(b)) for a, b in edges]


def test_canonical_forms():
    for edges in ([(i, (i + 1) % 6) for i in range(6)], numbered(ROOK), numbered(SHRIKHANDE)):
        forms = {graph(relabel(edges, s)).canonical(20_000)[0] for s in range(4)}
        assert len(forms) == 1
    rook, shrikhande = graph(numbered(ROOK)), graph(numbered(SHRIKHANDE))
    assert kernels.compare(rook, shrikhande, 20_000)[0] == "different"
    assert kernels.compare(rook, graph(relabel(numbered(ROOK), 5)), 20_000)[0] == "isomorphic"
    assert kernels.compare(rook, shrikhande, 0)[0] == "inconclusive" and rook.canonical(1) is None


def test_graphs_of_five_vertices():
    pairs = list(itertools.combinations(range(5), 2))
    forms = set()
    for bits in range(1 << 10):
        g = kernels.Graph({i: "" for i in range(5)}, [(s, d, "edge", "", 1) for k, (a, b) in enumerate(pairs) if bits >> k & 1 for s, d in ((a, b), (b, a))])
        forms.add(g.canonical(10_000)[0])
    assert len(forms) == 34


def test_matrices():
    g = graph([(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)])
    a = kernels.matrix(g)
    power, want = a, []
    for _ in range(40):
        want.append(sum(int(power[i, i]) for i in range(4)) % 251)
        power = power.dot(a) % 251
    assert kernels.closed_walks(a, list(range(1, 41))) == want
    assert kernels.determinant([[2, 1], [1, 3]]) == 5 and kernels.characteristic([[0, 1], [1, 0]], 3) == 8


def test_label_rounds_are_invariant(spark):
    def signature(edges):
        rows = [("g", s, d, "edge", "", 1) for a, b in edges for s, d in ((a, b), (b, a))]
        arcs = spark.createDataFrame(rows, formats.ARC_SCHEMA)
        vertices = arcs.select("graph_id", F.col("src").alias("v"), F.lit(1).alias("kind"), F.lit("").alias("label")).distinct()
        return G.graph_signature(G.label_rounds(vertices, arcs, rounds=3), [17, 53, 101]).drop("graph_id").first()

    path = [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert signature(path) == signature(relabel(path, 3)) != signature([(0, 1), (0, 2), (0, 3), (0, 4)])


def test_sources(spark, tmp_path):
    assert formats.parse_graph6(formats.write_graph6(6, {(0, 1), (2, 5), (3, 4)})) == (6, [(0, 1), (3, 4), (2, 5)])
    assert formats.parse_smiles("C1CC1=O") == (["C", "C", "C", "O"], [(0, 1, 1), (1, 2, 1), (0, 2, 1), (2, 3, 2)])
    assert formats.parse_smiles("C(") is None and formats.parse_smiles("CC(Cl)[NH4+]")[0] == ["C", "C", "Cl", "NH4+"]
    (tmp_path / "a.fasta").write_text(">one\nACD\nEF\n>two\nG\n")
    records = formats.read_fasta(spark, str(tmp_path / "a.fasta"))
    assert {(r.header, r.residues) for r in records.collect()} == {("one", "ACDEF"), ("two", "G")}
    assert formats.residue_chain(records).count() == 4
    line = "ATOM      1  CA AALA A   1      11.000  12.000  13.500"
    (tmp_path / "a.pdb").write_text(line + "\n" + line.replace("ALA", "HOH") + "\n")
    assert [(r.name, r.residue, r.z) for r in formats.read_pdb_atoms(spark, str(tmp_path / "a.pdb")).collect()] == [("CA", "ALA", 13.5)]
    (tmp_path / "b.bin").write_bytes(b"abcdefg")
    assert sorted((r.idx, bytes(r.bytes)) for r in formats.read_chunks(spark, str(tmp_path / "b.bin"), 3).collect()) == [(0, b"abc"), (1, b"def"), (2, b"g")]


def test_stream_applies_a_log_once(spark, tmp_path):
    schema = "revision int, k int, op string, x string"
    rows = [(1, 1, "upsert", "a"), (2, 2, "upsert", "b"), (3, 1, "delete", None), (4, 2, "upsert", "c")]

    def apply(table, log):
        state = table.select(F.lit(0).alias("revision"), "k", F.lit("upsert").alias("op"), "x")
        return tables.replay(state.unionByName(log), ["k"], "revision", ["x"])

    path = str(tmp_path / "table")
    applier = LogApplier(spark.createDataFrame([], "k int, x string"), path, apply)
    applier(spark.createDataFrame(rows[:2], schema), 0)
    applier(spark.createDataFrame(rows, schema), 1)  # the first two again
    assert sorted(map(tuple, applier.table.collect())) == [(2, "c")]
    again = LogApplier(spark.createDataFrame([], "k int, x string"), path, apply)  # the query starts again
    again(spark.createDataFrame(rows[2:], schema), 2)
    assert again.applied == 4 and sorted(map(tuple, again.table.collect())) == [(2, "c")]
    for bad in ([(9, 1, "upsert", "z")], [(5, 1, "upsert", "z"), (5, 1, "upsert", "y")]):
        with pytest.raises(ValueError):
            again(spark.createDataFrame(bad, schema), 3)
    assert again.applied == 4


def test_entry_runs(spark, sf):
    from sigmafold.plans import registry

    assert registry.QUERIES["multiset_fp251_by_flag"](spark, sf).count() == 3
    assert set(registry.ORACLES) <= set(registry.QUERIES)
