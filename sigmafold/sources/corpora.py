"""Parsers of public graph collections, atom records with bonds, lakes by stratum, and hooks for one's own sources."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmafold.operators.graph import relational as G
from sigmafold.sources import formats

#: Columns of a telemetry record.
TELEMETRY = (
    "domain string, experiment_name string, vertices bigint, edges bigint, density double, parse_time_ns bigint, l1_shield_time_ns bigint, galois_engine_time_ns bigint, "
    "l1_rejection_rate double, threads_utilized bigint, peak_memory_mb double, isomorphism_verified boolean, false_positives_detected bigint"
)
#: Largest distance between atoms that are bonded.
BOND_CUTOFF = 2.2


# --- collections --------------------------------------------------------------------------------------------


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1), value: lines of one file in order.  A file is read by one task, as its line numbers need it whole."""
    rows = spark.read.text(path).coalesce(1).withColumn("line", F.monotonically_increasing_id() + 1)
    return rows.select("line", F.trim("value").alias("value"))


def read_tu(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, arcs and classes (graph_id, label) of a collection in files _A, _graph_indicator, _node_labels, _edge_labels, _graph_labels."""
    part = lambda suffix: _numbered_lines(spark, f"{folder}/{name}_{suffix}.txt")
    owner = part("graph_indicator").select(F.col("line").alias("v"), F.col("value").alias("graph_id"))
    atoms = part("node_labels").select(F.col("line").alias("v"), F.concat(F.lit("atom/"), "value").alias("label"))
    vertices = owner.join(atoms, "v").select("graph_id", "v", F.lit(G.ENTITY).alias("kind"), "label")
    ends = F.split("value", r"\s*,\s*")
    pairs = part("A").select("line", ends[0].cast("bigint").alias("src"), ends[1].cast("bigint").alias("dst"))
    bonds = part("edge_labels").select("line", F.concat(F.lit("bond/"), "value").alias("relation"))
    arcs = pairs.join(bonds, "line").join(owner.withColumnRenamed("v", "src"), "src")
    strange = arcs.join(owner.select(F.col("v").alias("dst"), F.col("graph_id").alias("other")), "dst", "left")
    same = F.when(F.col("graph_id").eqNullSafe(F.col("other")), F.col("graph_id")).otherwise(F.raise_error(F.lit("an arc between two graphs")))
    arcs = strange.select(same.alias("graph_id"), "src", "dst", "relation", F.lit("").alias("role")).groupBy(*G.ARC).agg(F.count(F.lit(1)).alias("mult"))
    return vertices, arcs, part("graph_labels").select(F.col("line").cast("string").alias("graph_id"), F.col("value").cast("bigint").alias("label"))


def read_edge_list(spark: SparkSession, edges: str, labels: str | None = None, graph_id: str = "g") -> tuple[DataFrame, DataFrame]:
    """Vertices and arcs of a directed list of pairs, one a line, with labels "vertex label", one a line; comments begin with #."""
    cut = F.split(F.trim("value"), r"\s+")
    pairs = spark.read.text(edges).where("trim(value) <> '' and not value like '#%'").select(cut[0].cast("bigint").alias("src"), cut[1].cast("bigint").alias("dst"))
    arcs = G.arcs_of(pairs, "src", "dst", F.lit(graph_id))
    found = pairs.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    if labels is None:
        named = found.withColumn("label", F.lit(""))
    else:
        given = spark.read.text(labels).where("trim(value) <> ''").select(cut[0].cast("bigint").alias("v"), cut[1].alias("label"))
        named = given.join(found, "v", "full_outer").select("v", F.coalesce("label", F.lit("")).alias("label"))
    return named.select(F.lit(graph_id).alias("graph_id"), "v", F.lit(G.ENTITY).alias("kind"), "label"), arcs


def read_hypergraph(spark: SparkSession, path: str, graph_id: str = "g") -> tuple[DataFrame, DataFrame]:
    """Vertices and arcs of a JSON document with ``edge-dict``: the members of each hyperedge by its name.  Names hash to ids of their kind."""
    text = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.edge-dict"), "map<string, array<string>>").alias("edges"))
    members = text.select(F.explode("edges").alias("edge", "members")).select("edge", F.explode("members").alias("member"))
    number = lambda kind, x: F.xxhash64(F.lit(kind), x)
    rows = members.select(number("edge", F.col("edge")).alias("e"), number("member", F.col("member")).alias("m"), "edge", "member", F.lit("").alias("role"))
    entities = rows.select(F.lit(graph_id).alias("graph_id"), F.col("m").alias("v"), F.lit(G.ENTITY).alias("kind"), F.col("member").alias("label"))
    edges = rows.select(F.lit(graph_id).alias("graph_id"), F.col("e").alias("v"), F.lit(G.HYPEREDGE).alias("kind"), F.col("edge").alias("label"))
    return entities.unionByName(edges).distinct(), G.hyperedge_arcs(rows, "e", "m", "role").withColumn("graph_id", F.lit(graph_id))


# --- atoms with bonds, residues with templates ------------------------------------------------------------------


def pdb_bonds(spark: SparkSession, path: str, cutoff: float = BOND_CUTOFF) -> DataFrame:
    """a < b: bonds between kept atoms by serial number, given (CONECT) or within the cutoff."""
    atoms = formats.read_pdb_atoms(spark, path)
    near = G.near_pairs(atoms, "serial", ["x", "y", "z"], cutoff)
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("value like 'CONECT%'").select(words[1].cast("int").alias("u"), F.explode(F.slice(words, 3, 99)).alias("w"))
    given = lines.select("u", F.col("w").cast("int").alias("w")).where("u <> w").select(F.least("u", "w").alias("a"), F.greatest("u", "w").alias("b"))
    kept = atoms.select("serial")
    given = given.join(kept.withColumnRenamed("serial", "a"), "a", "left_semi").join(kept.withColumnRenamed("serial", "b"), "b", "left_semi")
    return near.select("a", "b").unionByName(given.select("a", "b")).distinct()


def stitch_residues(records: DataFrame, templates: DataFrame, fallback: str = "G") -> DataFrame:
    """Arcs (both ways) of residue chains (header, residues): each residue's template, then a bond from its last atom to the next one's first.

    ``templates`` has residue, atoms (their count), first, last (places of the two ends) and bonds, an
    array of (i, j).  A residue without a template is taken as ``fallback``.
    """
    n = F.length("residues")
    each = records.where(n > 0).select("header", F.posexplode(F.split("residues", "")).alias("at", "residue")).where("residue <> ''")
    known = templates.select("residue", F.lit(True).alias("known"))
    each = each.withColumn("residue", F.upper("residue")).join(known, "residue", "left").withColumn("residue", F.when(F.col("known"), F.col("residue")).otherwise(F.lit(fallback)))
    placed = each.drop("known").join(templates, "residue")
    order = Window.partitionBy("header").orderBy("at")
    placed = placed.withColumn("base", F.coalesce(F.sum("atoms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = placed.select("header", "base", F.inline("bonds")).toDF("header", "base", "i", "j").select("header", (F.col("base") + F.col("i")).alias("a"), (F.col("base") + F.col("j")).alias("b"))
    ahead = placed.withColumn("next", F.lead(F.col("base") + F.col("first")).over(order)).where("next is not null")
    bonds = inner.unionByName(ahead.select("header", (F.col("base") + F.col("last")).alias("a"), F.col("next").alias("b")))
    return _both_ways(bonds)


def _both_ways(bonds: DataFrame) -> DataFrame:
    ends = bonds.select(F.col("header").alias("graph_id"), F.inline(F.array(F.struct(F.col("a").cast("bigint").alias("src"), F.col("b").cast("bigint").alias("dst")), F.struct(F.col("b").cast("bigint").alias("src"), F.col("a").cast("bigint").alias("dst")))))
    return ends.groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).alias("mult")).select("graph_id", "src", "dst", F.lit("bond").alias("relation"), F.lit("").alias("role"), "mult")


# --- lakes by stratum ----------------------------------------------------------------------------------------------


def betti(edges: Column, vertices: Column) -> Column:
    """Independent cycles of a connected graph: edges - vertices + 1, never below 0."""
    return F.greatest(F.lit(0).cast("bigint"), edges.cast("bigint") - vertices.cast("bigint") + 1)


def strata(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """graph_id, v, e, betti of every graph: the keys that graphs must share before they are compared."""
    v = vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("v"))
    e = G.support_edges(arcs).groupBy("graph_id").agg(F.count(F.lit(1)).alias("e"))
    both = v.join(e, "graph_id", "left").na.fill(0, ["e"])
    return both.select("graph_id", "v", "e", betti(F.col("e"), F.col("v")).alias("betti"))


def build_lake(vertices: DataFrame, arcs: DataFrame, path: str) -> None:
    """Arcs in folders by stratum."""
    formats.write_lake(arcs.join(strata(vertices, arcs), "graph_id"), path, ["v", "e", "betti"])


def load_stratum(spark: SparkSession, path: str, v: int, e: int) -> DataFrame:
    """Arcs of the graphs of one stratum; other folders aren't opened."""
    return spark.read.parquet(path).where((F.col("v") == v) & (F.col("e") == e) & (F.col("betti") == max(0, e - v + 1)))


# --- rendering of states ----------------------------------------------------------------------------------------------


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of bigints in rows of four, and 256 for each row that one has more."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(same, F.lit(0), lambda acc, x: acc + x) + F.abs(F.size(a) - F.size(b)) * 64


def head_tail(words: Column) -> Column:
    """A struct head, tail: the first and the last bigint of an array as 16 hexadecimal digits, empty without any."""
    text = lambda x: F.coalesce(F.lpad(F.hex(x), 16, "0"), F.lit(""))
    return F.struct(text(F.try_element_at(words, F.lit(1))).alias("head"), text(F.try_element_at(words, F.lit(-1))).alias("tail"))


# --- hooks: one's own sources and experiments ------------------------------------------------------------------------------


def map_domain(df: DataFrame, key: str, raw: str, parse: Callable[[str], Iterable[tuple] | None]) -> DataFrame:
    """Arcs of a user's format: ``parse`` turns one text into (src, dst, relation, role, mult); None leaves the row out."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            out = [(k, *arc) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for arc in (parse(text) if text is not None else None) or ()]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["graph_id", "src", "dst", "relation", "role", "mult"])

    return df.select(F.col(key).cast("string").alias("graph_id"), raw).mapInArrow(run, formats.ARC_SCHEMA)


class Experiment:
    """What a user measures: override ``execute`` and ``verify``, and ``setup`` and ``telemetry`` where needed."""

    name, domain = "experiment", "domain"

    def setup(self, spark: SparkSession) -> None:
        pass

    def execute(self, spark: SparkSession):
        raise NotImplementedError

    def verify(self, outcome) -> bool:
        raise NotImplementedError

    def telemetry(self) -> dict:
        return {}


def run_experiments(spark: SparkSession, experiments: list[Experiment]) -> DataFrame:
    """One telemetry record for each experiment; a failed verification is recorded, not raised."""
    names = [f.split()[0] for f in TELEMETRY.split(", ")]
    rows = []
    for x in experiments:
        began = time.perf_counter_ns()
        x.setup(spark)
        ready = time.perf_counter_ns()
        outcome = x.execute(spark)
        ended = time.perf_counter_ns()
        record = dict.fromkeys(names, 0) | {"density": 0.0, "l1_rejection_rate": 0.0, "peak_memory_mb": 0.0, "threads_utilized": spark.sparkContext.defaultParallelism}
        record |= {"domain": x.domain, "experiment_name": x.name, "parse_time_ns": ready - began, "galois_engine_time_ns": ended - ready, "isomorphism_verified": bool(x.verify(outcome))}
        unknown = set(x.telemetry()) - set(names)
        if unknown:
            raise ValueError(f"not columns of a record: {sorted(unknown)}")
        rows.append(tuple((record | x.telemetry())[n] for n in names))
    return spark.createDataFrame(rows, TELEMETRY)


def write_telemetry(records: DataFrame, path: str) -> None:
    """Records as CSV with a header; other columns than those of a record raise."""
    names = [f.split()[0] for f in TELEMETRY.split(", ")]
    if records.columns != names:
        raise ValueError(f"a record's columns are {names}")
    formats.write_telemetry(records, path)
