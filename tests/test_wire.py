"""Canonical bytes fail closed; encoders, deltas, folds and graph profiles against plain Python."""

import itertools
import random
from collections import Counter
from decimal import Decimal
from functools import reduce

import pytest
from pyspark.sql import functions as F

from sigmafold.functions import encoders, fields
from sigmafold.functions.fields import FP251, FP65521, GF2_128, GF2_256, GOLDILOCKS, MERSENNE127
from sigmafold.operators import codecs, deltas, laws, tables
from sigmafold.operators.graph import kernels
from sigmafold.operators.graph import profiles as P
from sigmafold.operators.graph import relational as G
from sigmafold.sources import corpora, formats

ALL = tables.TableSchema((("key", "u64"), ("active", "bool"), ("signed", "i64"), ("raw", "bytes"), ("label", "text")), ("key",), 7, ("label",))
SPACE = codecs.namespace_of(b"tests")


def test_rows_of_all_types_round_trip_and_fail_closed(spark):
    rows = [(11, 2**64 - 1, True, -5, bytearray(b"\0\xff"), "naïve"), (1, 0, False, 2**63 - 1, bytearray(b""), None)]
    df = spark.createDataFrame([(v, Decimal(k), *rest) for v, k, *rest in rows], "version bigint, key decimal(20,0), active boolean, signed bigint, raw binary, label string")
    coded = df.select(codecs.encode_row(ALL).alias("b"))
    assert sorted((r.version, int(r.key), r.active, r.signed, bytes(r.raw), r.label) for r in codecs.decode_rows(coded, "b", ALL).collect()) == sorted((v, k, a, s, bytes(b), t) for v, k, a, s, b, t in rows)
    good = bytes(coded.first().b)
    assert codecs.read_row(ALL, good)[1] == 2**64 - 1
    other = tables.TableSchema(ALL.columns, ALL.key, 8, ALL.nullable)
    for bad in (good[:-1], good + b"\0", b"X" + good[1:], good[:4] + b"\2" + good[5:], good[:40] + bytes(8) + good[48:], good[:56] + b"\x02" + good[57:]):
        with pytest.raises(codecs.WireError):
            codecs.read_row(ALL, bad)
    with pytest.raises(codecs.WireError):
        codecs.read_row(other, good)
    for at in range(0, len(good), 3):  # no flipped byte gives the same row
        try:
            assert codecs.read_row(ALL, good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]) != codecs.read_row(ALL, good)
        except codecs.WireError:
            pass


def test_schemas_and_violations(spark):
    for columns, key, nullable in (((), ("a",), ()), ((("a", "i64"), ("a", "i64")), ("a",), ()), ((("a", "i64"),), ("a",), ("a",)), ((("a", "float"),), ("a",), ()), ((("a", "i64"),), (), ())):
        with pytest.raises(ValueError):
            tables.TableSchema(columns, key, 1, nullable)
    assert tables.TableSchema((("a", "i64"),), ("a",)).id != tables.TableSchema((("a", "i64"),), ("a",), 2).id
    df = spark.createDataFrame([(1, 1, "x"), (0, 2, "x"), (1, None, "x"), (1, 3, None)], "version int, k bigint, t string")
    schema = tables.TableSchema((("k", "i64"), ("t", "text")), ("k",), 1, ("t",))
    assert tables.violations(df, schema).count() == 2


def test_revisioned_table(spark, tmp_path):
    schema = tables.TableSchema((("k", "i64"), ("x", "text")), ("k",))
    ddl = "source_revision bigint, seq bigint, op string, before_version bigint, before_k bigint, before_x string, after_version bigint, after_k bigint, after_x string"

    def tx(*rows, space=SPACE):
        return bytes(codecs.encode_transactions(spark.createDataFrame(list(rows), ddl), schema, space).first()["transaction"])

    table = tables.RevisionedTable(spark, str(tmp_path / "t"), schema, SPACE)
    table.create(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "version bigint, k bigint, x string"))
    one = tx((0, 0, "update", 1, 1, "a", 2, 1, "c"), (0, 1, "insert", None, None, None, 1, 3, "d"))
    assert (table.apply(one).revision, table.apply(one)) == (1, tables.Report(0, 1, 1))
    bad = [
        tx((5, 0, "delete", 1, 2, "b", None, None, None)),  # another revision
        tx((1, 0, "delete", 1, 2, "b", None, None, None), space=codecs.namespace_of(b"other")),
        tx((1, 0, "delete", 1, 2, "not b", None, None, None)),
        tx((1, 0, "update", 1, 2, "b", 2, 9, "b")),  # a key is updated
        tx((1, 0, "update", 1, 2, "b", 1, 2, "z")),  # the version doesn't rise
    ]
    for data in bad:
        with pytest.raises(ValueError):
            table.apply(data)
    # A log is applied whole or not at all.
    with pytest.raises(ValueError):
        table.replay([tx((1, 0, "delete", 1, 2, "b", None, None, None)), tx((2, 0, "delete", 1, 2, "b", None, None, None))])
    assert table.revision == 1 and sorted(map(tuple, table.rows().collect())) == [(1, 2, "b"), (1, 3, "d"), (2, 1, "c")]
    with pytest.raises(ValueError):
        codecs.read_transaction(schema, SPACE, one, codecs.Limits(mutations=1))


def test_logs_journals_and_snapshots_fail_closed(spark):
    entries = spark.createDataFrame([(2, bytearray(b"two")), (1, bytearray(b"one"))], "source_revision bigint, transaction binary")
    log = bytes(codecs.encode_log(entries).first().log)
    assert codecs.read_log(log) == [b"one", b"two"]
    for bad in (log[:-1], log + b"x", b"Z" + log[1:]):
        with pytest.raises(codecs.WireError):
            codecs.read_log(bad)
    with pytest.raises(codecs.WireError):
        codecs.read_log(log, codecs.Limits(log_entries=1))
    codecs.check_journal([(0, "a"), (1, "b")])
    for journal in ([(0, "a"), (2, "b")], [(1, "a"), (0, "b")], [(0, "a"), (1, "a")]):
        with pytest.raises(codecs.WireError):
            codecs.check_journal(journal)
        with pytest.raises(ValueError):
            deltas.check_journal(spark.createDataFrame([("k", s if journal[0][0] == 0 else 5 * s, d) for s, d in journal], "k string, source_revision bigint, delta_id string"), ["k"])
    context = codecs.context_of(FP251, "e", "additive", [])
    state = spark.range(1).select(codecs.encode_state(context, [F.lit(3)], [F.lit(250)]).alias("s"))
    found = state.select(codecs.decode_state(F.col("s"), context, 1, 1, 251).alias("x")).first().x
    assert (found.c0, found.e0) == (3, 250)
    with pytest.raises(Exception, match="identity"):
        state.select(codecs.decode_state(F.col("s"), codecs.context_of(FP251, "other", "additive", []), 1, 1, 251)).collect()
    with pytest.raises(Exception, match="canonical"):
        spark.range(1).select(codecs.decode_state(codecs.encode_state(context, [F.lit(3)], [F.lit(251)]), context, 1, 1, 251)).collect()


def test_encoders(spark):
    data = [b"", b"a", b"x" * 31, b"y" * 32, b"z" * 33, bytes(range(200))]
    tag = (9).to_bytes(8, "little")
    for d in data:
        n = int.from_bytes(d + b"\1" + tag, "little")
        assert encoders.PrimeInteger(FP65521, 9).encode(d) == [n % 65521]
        x = n
        while x.bit_length() > 128:  # long division by the modulus
            x ^= GF2_128.modulus << (x.bit_length() - 129)
        assert encoders.BinaryPolynomial(GF2_128, 9).encode(d) == [x]
        acc = 0
        for piece in reversed([d[k : k + 32] for k in range(0, len(d), 32)]):
            acc = GF2_256.mul(acc, 2) ^ int.from_bytes(piece, "little")
        assert encoders.LinearChunks().encode(d) == [acc]
    assert encoders.LinearChunks(affine=True).encode(b"\xff" * 32) == [2**255 - 1]
    for f in (FP251, GOLDILOCKS, MERSENNE127, GF2_128):
        lanes = encoders.HashLanes(f, bytes(32), 1, 3)
        made = encoders.elements(spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(data)] + [(9, None)], "k int, d binary"), "d", lanes, "e").collect()
        assert {r.k: r.e and [f.from_bytes(bytes(x)) for x in r.e] for r in made} == {k: lanes.encode(d) for k, d in enumerate(data)} | {9: None}
    with pytest.raises(ValueError):
        encoders.dynamic("polynomial", FP251, tag=1)
    with pytest.raises(ValueError):
        encoders.CanonicalElement(FP251).encode(b"\xff")
    with pytest.raises(ValueError):
        encoders.PrimeInteger(FP251, 1).checked(bytes(encoders.MOST_BYTES + 1))


@pytest.mark.parametrize("f", [GOLDILOCKS, GF2_128])
def test_ordered_folds_and_residuals(spark, f):
    rng = random.Random(6)
    rows = [(k, o, bytearray(f.to_bytes(f.reduce(rng.randbytes(16))))) for k in "ab" for o in range(rng.randint(20, 40))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, e binary").repartition(3)
    got = {r.k: r for r in laws.fold_sequence(df, ["k"], ["o"], F.col("e"), f, [3, 5], backward=True).collect()}
    for key in "ab":
        items = [f.from_bytes(bytes(e)) for k, _, e in sorted(rows, key=lambda r: r[:2]) if k == key]
        for i, base in enumerate((3, 5)):
            want = [reduce(lambda s, e: f.add(f.mul(s, base), e), part, 0) for part in (items, items[::-1])]
            assert [f.from_bytes(bytes(x[i])) for x in (got[key].states, got[key].back)] == want
    last = f.from_bytes(bytes(rows[0][2]))
    state = f.add(f.mul(7, 3), last)
    df = spark.createDataFrame([(bytearray(f.to_bytes(state)), rows[0][2], 2)], "s binary, e binary, n bigint")
    assert f.from_bytes(bytes(laws.residuals(df, "s", "e", "n", f, "sequence", 3).first().rest)) == 7
    with pytest.raises(Exception, match="item absent"):
        laws.residuals(df.withColumn("n", F.lit(0)), "s", "e", "n", f, "sequence", 3).collect()


def test_deltas_and_tracked_collections(spark):
    states = spark.createDataFrame([("a", 5, 2)], "k string, state bigint, n bigint")
    with pytest.raises(Exception, match="item absent"):
        deltas.additive_delta(states, states.withColumn("n", F.col("n") + 1), states.limit(0), ["k"], FP251).collect()
    with pytest.raises(Exception, match="item absent"):
        deltas.tracked_multiset(spark.createDataFrame([("a", 1, -1)], "k string, item int, sign int"), ["k"], "item", F.col("sign")).collect()
    ops = spark.createDataFrame([("a", o, p) for o, p in enumerate("++-+--++-")], "k string, o int, p string")
    assert [(r.o, r.pos) for r in deltas.tracked_sequence(ops, ["k"], ["o"], F.col("p") == "+").collect()] == [(6, 0)]
    with pytest.raises(Exception, match="empty"):
        deltas.tracked_sequence(ops.where("o <> 0"), ["k"], ["o"], F.col("p") == "+").collect()
    assert deltas.assurance("multi_multiset", 3) == ("bounded_exact", 3) and deltas.assurance("sequence") == ("fingerprint", None) and deltas.assurance("sequence", tracked=True)[0] == "exact_tracked"


def _table(spark, graphs):
    rows = [(g, s, d, "edge", "", 1) for g, edges in graphs.items() for a, b in edges for s, d in {(a, b), (b, a)}]
    arcs = spark.createDataFrame(rows, "graph_id string, src bigint, dst bigint, relation string, role string, mult bigint")
    vertices = arcs.select("graph_id", F.explode(F.array("src", "dst")).alias("v")).distinct().withColumns({"kind": F.lit(1), "label": F.lit("")})
    return vertices, arcs


def test_patterns_of_order_four(spark):
    rng = random.Random(3)
    edges = [e for e in itertools.combinations(range(11), 2) if rng.random() < 0.45]
    _, arcs = _table(spark, {"g": edges})
    near = {frozenset(e) for e in edges}
    shapes = {(3, (1, 1, 2, 2)): "path", (3, (1, 1, 1, 3)): "claw", (4, (2, 2, 2, 2)): "cycle", (4, (1, 2, 2, 3)): "paw", (5, (2, 2, 3, 3)): "diamond", (6, (3, 3, 3, 3)): "clique"}
    want = Counter()
    for four in itertools.combinations(range(11), 4):
        inside = [p for p in itertools.combinations(four, 2) if frozenset(p) in near]
        want[shapes.get((len(inside), tuple(sorted(sum(v in p for p in inside) for v in four))))] += 1
    want.pop(None, None)
    got = P.order4_patterns(arcs)
    assert {r.pattern: r.n for r in got.collect() if r.n} == dict(want)
    assert P.pattern_fingerprints(got).count() == 1


def test_digests_evidence_and_forms(spark):
    cycle, two = [(i, (i + 1) % 6) for i in range(6)], [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)]
    named = [(0, 1), (1, 2), (2, 3), (3, 4), (1, 3), (4, 5)]  # every cell is single
    moved = [(5 - a, 5 - b) for a, b in named]
    vertices, arcs = _table(spark, {"cycle": cycle, "two": two, "one": named, "other": moved})
    vertices = vertices.withColumn("label", F.when(F.col("graph_id") == "one", F.col("v").cast("string")).when(F.col("graph_id") == "other", (5 - F.col("v")).cast("string")).otherwise(""))
    forms = {r.graph_id: r.form for r in P.discrete_form(vertices, arcs).collect()}
    assert set(forms) == {"one", "other"} and forms["one"] == forms["other"]
    layers = P.robust_layers(vertices, arcs)
    digest = {r.graph_id: r.digest for r in P.hybrid_digest(vertices, arcs, layers).collect()}
    assert digest["one"] == digest["other"] != digest["cycle"] == digest["two"]  # 1-WL can't tell the last two apart
    walks = P.vertex_walks(arcs, 3).groupBy("graph_id").agg(F.sum("walks").alias("value"))
    channels = P.evidence({"digest": P.hybrid_digest(vertices, arcs, layers).withColumnRenamed("digest", "value"), "walks": walks})
    pairs = spark.createDataFrame([("cycle", "two"), ("one", "other")], "a string, b string")
    assert {(r.a, r.verdict, r.witness) for r in P.compare_evidence(pairs, channels).collect()} == {("cycle", "different", "walks"), ("one", "indistinguishable", None)}
    exact = {r.graph_id: (r.path, r.cells, r.ambiguous) for r in kernels.canonicalize_exact(vertices, arcs).collect()}
    assert exact["one"] == ("refinement", 6, 0) and exact["cycle"] == ("search", 1, 6)
    g = kernels.Graph({0: "a", 1: "b", 2: "b"}, [(0, 1, "r", "", 2), (1, 2, "s", "x", 1)])
    form = g.canonical(1000)[0]
    assert kernels.decode_form(form).canonical(1000)[0] == form
    for bad in (b"", form[:-1], form.replace(b"2", b"-2"), b"(1, ['a'], [(0, 5, (('r', '', 1),))])"):
        with pytest.raises(ValueError):
            kernels.decode_form(bad)
    small = kernels.Graph(dict.fromkeys(range(6), ""), [(s, d, "e", "", 1) for a, b in cycle for s, d in ((a, b), (b, a))])
    other = kernels.Graph(dict.fromkeys(range(6), ""), [(s, d, "e", "", 1) for a, b in two for s, d in ((a, b), (b, a))])
    assert kernels.pair_refinement(small) != kernels.pair_refinement(other)
    assert kernels.pair_refinement(small, most_work=1) == ("skipped_budget", [])
    stored = kernels.canonical_forms(vertices, arcs).select("graph_id", "form")
    assert kernels.load_snapshot(stored, vertices, arcs).count() == 4
    with pytest.raises(Exception, match="stored form"):
        kernels.load_snapshot(stored.withColumn("form", F.reverse("form")), vertices, arcs).collect()
    assert P.suitability(GF2_128, "theta_contractions") == "avoid" and P.suitability(FP251, "theta_contractions") == "preferred"
    assert (P.update_policy(0, 0, 9), P.update_policy(1, 2, 9), P.update_policy(1, 8, 9)) == ("no_change", "incremental_cone", "full_rebuild")


def test_stable_partition_of_a_long_path(spark):
    vertices, arcs = _table(spark, {"p": [(i, i + 1) for i in range(20)]})
    assert G.stable_partition(vertices, arcs).select("color").distinct().count() == 11
    with pytest.raises(RuntimeError):
        G.stable_partition(vertices, arcs, most_rounds=2)


def test_large_graph6_lines_list_set_bits_alone():
    n = 400
    line = formats.write_graph6(n, {(0, 399), (1, 2)})
    assert formats.parse_graph6(line) == (n, [(1, 2), (0, 399)])


def test_manifests_masks_and_many_points(spark):
    binary = {"field": {"degree": 128, "modulus": {"nonzero_exponents": [128, 7, 2, 1, 0]}, "encoding": {"byte_order": "little", "canonical_bytes": 16}}}
    assert fields.field_of(binary) == GF2_128
    assert fields.field_of({"prime": {"modulus": "65521"}, "encoding": {"byte_order": "little", "canonical_bytes": 2}}) == FP65521
    for exponents in ([128, 7, 2, 0], [128, 2, 7, 1, 0], [127, 1, 0]):
        with pytest.raises(ValueError):
            fields.field_of({"field": binary["field"] | {"modulus": {"nonzero_exponents": exponents}}})
    assert [fields.is_irreducible(fields.BinaryField(m, t)) for m, t in ((2, (1, 0)), (4, (1, 0)), (4, (3, 2, 1, 0)), (4, (2, 0)), (6, (3, 0)))] == [True, True, True, False, True]
    flags = [random.Random(1).random() < 0.5 for _ in range(130)]
    df = spark.createDataFrame([(flags, [3, 0, 5])], "f array<boolean>, c array<bigint>").withColumn("m", fields.mask_of(F.col("f")))
    r = df.select(fields.mask_count(F.col("m")).alias("n"), *[fields.mask_get(F.col("m"), F.lit(k)).alias(f"b{k}") for k in (0, 63, 64, 129)], fields.c_horner_many(FP251, F.col("c"), [2, 10]).alias("h")).first()
    assert r.n == sum(flags) and [r[f"b{k}"] for k in (0, 63, 64, 129)] == [flags[k] for k in (0, 63, 64, 129)] and r.h == [17, 305 % 251]


def test_corpora_and_hooks(spark, tmp_path):
    for name, text in (("A", "1, 2\n2, 1\n3, 4\n"), ("graph_indicator", "1\n1\n2\n2\n"), ("node_labels", "0\n1\n0\n0\n"), ("edge_labels", "7\n7\n8\n"), ("graph_labels", "1\n-1\n")):
        (tmp_path / f"T_{name}.txt").write_text(text)
    vertices, arcs, classes = corpora.read_tu(spark, str(tmp_path), "T")
    assert {(r.graph_id, r.src, r.dst, r.relation) for r in arcs.collect()} == {("1", 1, 2, "bond/7"), ("1", 2, 1, "bond/7"), ("2", 3, 4, "bond/8")}
    assert {(r.graph_id, r.label) for r in classes.collect()} == {("1", 1), ("2", -1)} and vertices.where("label = 'atom/0'").count() == 3
    assert {tuple(r) for r in corpora.strata(vertices, arcs).collect()} == {("1", 2, 1, 0), ("2", 2, 1, 0)}
    corpora.build_lake(vertices, arcs, str(tmp_path / "lake"))
    assert corpora.load_stratum(spark, str(tmp_path / "lake"), 2, 1).count() == 3
    (tmp_path / "e.txt").write_text("# pairs\n1 2\n2 3\n1 2\n")
    (tmp_path / "l.txt").write_text("1 a\n2 b\n9 c\n")
    vertices, arcs = corpora.read_edge_list(spark, str(tmp_path / "e.txt"), str(tmp_path / "l.txt"))
    assert {(r.v, r.label) for r in vertices.collect()} == {(1, "a"), (2, "b"), (3, ""), (9, "c")} and {(r.src, r.dst, r.mult) for r in arcs.collect()} == {(1, 2, 2), (2, 3, 1)}
    (tmp_path / "h.json").write_text('{"edge-dict": {"x": ["a", "b"], "y": ["b"]}}')
    vertices, arcs = corpora.read_hypergraph(spark, str(tmp_path / "h.json"))
    assert (vertices.count(), arcs.count()) == (4, 6)
    line = "ATOM      {0}  CA  ALA A   1    {1:8.3f}{2:8.3f}{3:8.3f}"
    atoms = [line.format(k, *xyz) for k, xyz in ((1, (0, 0, 0)), (2, (1.5, 0, 0)), (3, (9, 0, 0)))]
    (tmp_path / "a.pdb").write_text("\n".join([*atoms, "CONECT    1    3   99"]) + "\n")
    assert {tuple(r) for r in corpora.pdb_bonds(spark, str(tmp_path / "a.pdb")).collect()} == {(1, 2), (1, 3)}
    templates = spark.createDataFrame([("G", 2, 0, 1, [(0, 1)]), ("A", 3, 0, 1, [(0, 1), (1, 2)])], "residue string, atoms int, first int, last int, bonds array<struct<i:int,j:int>>")
    chain = corpora.stitch_residues(spark.createDataFrame([("p", "aXG")], "header string, residues string"), templates)
    assert {(r.src, r.dst) for r in chain.where("src < dst").collect()} == {(0, 1), (1, 2), (1, 3), (3, 4), (4, 5), (5, 6)}
    words = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 3, 7, 0, 0, 0, 0])], "a array<bigint>, b array<bigint>")
    r = words.select(corpora.hamming(F.col("a"), F.col("b")).alias("d"), corpora.head_tail(F.col("a")).alias("t")).first()
    assert r.d == 2 + 256 and tuple(r.t) == ("0" * 15 + "1", "0" * 15 + "4")
    mapped = corpora.map_domain(spark.createDataFrame([(1, "0-1"), (2, None), (3, "bad")], "k int, t string"), "k", "t", lambda t: [(*map(int, t.split("-")), "e", "", 1)] if "-" in t else None)
    assert [tuple(r) for r in mapped.collect()] == [("1", 0, 1, "e", "", 1)]

    class Count(corpora.Experiment):
        name, domain = "count", "tests"

        def execute(self, spark):
            return spark.range(5).count()

        def verify(self, outcome):
            return outcome == 5

    records = corpora.run_experiments(spark, [Count()])
    corpora.write_telemetry(records, str(tmp_path / "t"))
    assert records.first().isomorphism_verified and spark.read.option("header", True).csv(str(tmp_path / "t")).columns == records.columns
