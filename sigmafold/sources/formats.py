"""Sources and sinks: graph6, molecules, residue sequences, atom records, chunked files, stratified lakes."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARC_SCHEMA = "graph_id string, src bigint, dst bigint, relation string, role string, mult bigint"

#: The organic subset of atoms that need no brackets, longest first.
_ATOM = re.compile(r"Cl|Br|[BCNOPSFI]|[bcnops]|\[[^\]]+\]")
_BOND = {"-": 1, "=": 2, "#": 3, ":": 1, "/": 1, "\\": 1}


def parse_graph6(line: str) -> tuple[int, list[tuple[int, int]]]:
    """(vertices, edges) of one graph6 line of up to 258,047 vertices."""
    data = [ord(c) - 63 for c in line.strip()]
    if not data or any(not 0 <= x < 64 for x in data):
        raise ValueError("not a graph6 line")
    n, rest = (data[0], data[1:]) if data[0] < 63 else (data[1] << 12 | data[2] << 6 | data[3], data[4:])
    size = n * (n - 1) // 2
    if len(rest) != -(-size // 6):
        raise ValueError("a graph6 line has the wrong length")
    out = []
    for at, x in enumerate(rest):
        for k in range(6):
            if x >> (5 - k) & 1:
                place = 6 * at + k
                if place >= size:
                    raise ValueError("a graph6 line has bits behind its last pair")
                # Column j holds the pairs (0, j) to (j - 1, j), from place j (j - 1) / 2 on.
                j = (1 + math.isqrt(1 + 8 * place)) // 2
                out.append((place - j * (j - 1) // 2, j))
    return n, out


def write_graph6(n: int, edges: set[tuple[int, int]]) -> str:
    """The graph6 line of a graph of up to 258,047 vertices."""
    data = [0] * -(-(n * (n - 1) // 2) // 6)
    for a, b in edges:
        i, j = min(a, b), max(a, b)
        place = j * (j - 1) // 2 + i
        data[place // 6] |= 1 << (5 - place % 6)
    head = [n] if n < 63 else [63, n >> 12, n >> 6 & 63, n & 63]
    return "".join(chr(63 + x) for x in head + data)


def parse_smiles(text: str) -> tuple[list[str], list[tuple[int, int, int]]] | None:
    """(atoms, bonds as (i, j, order)); None if the string isn't understood."""
    atoms: list[str] = []
    bonds: list[tuple[int, int, int]] = []
    stack: list[int | None] = []
    rings: dict[str, tuple[int, int]] = {}
    last, order, at = None, 1, 0
    while at < len(text):
        c = text[at]
        if found := _ATOM.match(text, at):
            atoms.append(found[0].strip("[]"))
            if last is not None:
                bonds.append((last, len(atoms) - 1, order))
            last, order, at = len(atoms) - 1, 1, found.end()
            continue
        if c == "(":
            stack.append(last)
        elif c == ")":
            if not stack:
                return None
            last = stack.pop()
        elif c in _BOND:
            order = _BOND[c]
        elif c == ".":
            last = None
        elif c.isdigit() or c == "%":
            label = text[at + 1 : at + 3] if c == "%" else c
            at += 2 if c == "%" else 0
            if last is None:
                return None
            if label in rings:
                other, earlier = rings.pop(label)
                bonds.append((other, last, max(order, earlier)))
            else:
                rings[label] = (last, order)
            order = 1
        elif c != "@":
            return None
        at += 1
    return (atoms, bonds) if atoms and not rings and not stack else None


def clean_smiles(df: DataFrame, column: str = "smiles") -> DataFrame:
    """Rows without nulls, without stereo marks, distinct."""
    return df.dropna(subset=[column]).withColumn(column, F.translate(F.col(column), "@/\\", "")).distinct()


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="molecule_id string, smiles string")


def molecule_arcs(molecules: DataFrame) -> DataFrame:
    """Arcs of all molecules: a bond is an arc each way, its order the multiplicity.  Strings that aren't understood have none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for name, smiles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                atoms, bonds = parse_smiles(smiles or "") or ([], [])
                for i, j, order in bonds:
                    role = "-".join(sorted((atoms[i], atoms[j])))
                    out += [(name, i, j, "bond", role, order), (name, j, i, "bond", role, order)]
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["graph_id", "src", "dst", "relation", "role", "mult"])

    return molecules.select("molecule_id", "smiles").mapInArrow(run, ARC_SCHEMA)


def read_graph6(spark: SparkSession, path: str) -> DataFrame:
    """Arcs of every line of text files, the line as graph_id."""
    return graph6_arcs(spark.read.text(path).where("value <> ''").withColumnRenamed("value", "line"))


def graph6_arcs(lines: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for line in batch.column(0).to_pylist():
                for i, j in parse_graph6(line)[1]:
                    out += [(line, i, j, "edge", "", 1), (line, j, i, "edge", "", 1)]
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["graph_id", "src", "dst", "relation", "role", "mult"])

    return lines.select("line").mapInArrow(run, ARC_SCHEMA)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, residues: records begin with '>'; lines of residues are joined."""
    records = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    return records.select(F.trim(F.substring_index("value", "\n", 1)).alias("header"), F.regexp_replace(F.expr("substring(value, locate('\n', value) + 1)"), r"\s", "").alias("residues"))


def residue_chain(records: DataFrame) -> DataFrame:
    """Arcs between neighbouring residues of each record, with both residues as role."""
    n = F.length("residues")
    steps = records.where(n > 1).select("header", "residues", F.explode(F.sequence(F.lit(1), n - 1)).alias("i"))
    role = F.concat(F.substring(F.col("residues"), F.col("i"), F.lit(1)), F.lit("-"), F.substring(F.col("residues"), F.col("i") + 1, F.lit(1)))
    return steps.select(F.col("header").alias("graph_id"), (F.col("i") - 1).cast("bigint").alias("src"), F.col("i").cast("bigint").alias("dst"), F.lit("peptide").alias("relation"), role.alias("role"), F.lit(1).cast("bigint").alias("mult"))


def read_pdb_atoms(spark: SparkSession, path: str) -> DataFrame:
    """serial, name, residue, chain, x, y, z of atom records: water and alternates other than A are skipped."""
    lines = spark.read.text(path).where("value like 'ATOM%' or value like 'HETATM%'")
    part = lambda a, n: F.trim(F.substring("value", a, n))
    atoms = lines.select(part(7, 5).cast("int").alias("serial"), part(13, 4).alias("name"), part(17, 1).alias("alternate"), part(18, 3).alias("residue"), part(22, 1).alias("chain"),
                         *[part(a, 8).cast("double").alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z"))])
    return atoms.where("residue <> 'HOH' and alternate in ('', 'A')").drop("alternate")


def read_chunks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """path, idx, bytes: fixed-size pieces of binary files, the last may be shorter."""
    files = spark.read.format("binaryFile").load(path)
    n = F.ceil(F.col("length") / F.lit(float(size))).cast("int")
    cut = files.select("path", "content", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("idx"))
    return cut.select("path", "idx", F.substring(F.col("content"), F.col("idx") * size + 1, F.lit(size)).alias("bytes"))


def write_lake(df: DataFrame, path: str, strata: list[str]) -> None:
    """Parquet by strata, so a reader that asks for some strata opens their folders alone."""
    df.repartition(*strata).write.partitionBy(*strata).parquet(path)


def write_telemetry(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
