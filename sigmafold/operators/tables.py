"""Revisioned tables: row keys, partitions, transactions, logs and signature deltas."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmafold.functions.fields import PrimeField
from sigmafold.operators import codecs, laws
from sigmafold.runtime import materialise, release

KEY_DOMAIN = "sigmafold-row-key-v1"


@dataclass(frozen=True)
class TableSchema:
    """Named columns with types (bool, i64, u64, bytes, text), which of them may be null, and the key among them; its id is part of every row key."""

    columns: tuple[tuple[str, str], ...]
    key: tuple[str, ...]
    version: int = 1
    nullable: tuple[str, ...] = ()

    def __post_init__(self):
        names = [n for n, _ in self.columns]
        if not names or "" in names or len(set(names)) != len(names):
            raise ValueError("column names are missing or repeat")
        if any(k not in codecs.TYPES for _, k in self.columns):
            raise ValueError(f"types are {', '.join(codecs.TYPES)}")
        if not self.key or len(set(self.key)) != len(self.key) or any(k not in names or k in self.nullable for k in self.key):
            raise ValueError("the key must name columns that are never null, each once")
        if self.version < 1:
            raise ValueError("versions begin at 1")

    @property
    def id(self) -> str:
        """SHA-256 of the version, the columns and the places of the key."""
        names = [n for n, _ in self.columns]

        def number(n: int) -> bytes:
            return n.to_bytes(8, "little")

        out = b"sigmafold-schema-v1\0" + self.version.to_bytes(4, "little") + number(len(names))
        for name, kind in self.columns:
            out += number(len(name.encode())) + name.encode() + bytes([codecs.TYPES[kind], name in self.nullable])
        return hashlib.sha256(out + number(len(self.key)) + b"".join(number(names.index(k)) for k in self.key)).hexdigest()

    def row_key(self, column=F.col) -> Column:
        """SHA-256 (hexadecimal) of the domain, the schema's id and the framed bytes of each key value."""
        kinds = dict(self.columns)
        parts = [codecs.frame(codecs.value(column(k), kinds[k])) for k in self.key]
        return F.sha2(F.concat(codecs.raw(KEY_DOMAIN.encode() + b"\0" + bytes.fromhex(self.id)), *parts), 256)


def encode_value(x: Column) -> Column:
    """Null apart from text; text framed by its length in bytes."""
    text = x.cast("string")
    return F.when(x.isNull(), F.lit("0:")).otherwise(F.concat(F.lit("5:"), F.octet_length(text).cast("string"), F.lit(":"), text))


def plain_key(columns: list[str], domain: str = KEY_DOMAIN) -> Column:
    """SHA-256 (hexadecimal) of the domain and the framed key values, for rows without a schema."""
    return F.sha2(F.concat(F.lit(domain), *[encode_value(F.col(c)) for c in columns]), 256)


def partition_of(key_hex: Column, partitions: int) -> Column:
    """The first eight bytes of the key as a little-endian unsigned integer, modulo the number of partitions."""
    total = F.lit(0).cast("bigint")
    for i in range(8):
        byte = F.conv(F.substring(key_hex, 2 * i + 1, 2), 16, 10).cast("bigint")
        total = total + byte * F.lit(pow(256, i, partitions))
    return F.pmod(total, F.lit(partitions)).cast("int")


def violations(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Rows that break the schema: a null where none may be, a number out of its type's range, or a version below 1."""
    bad = F.coalesce(F.col("version") < 1, F.lit(True))
    for name, kind in schema.columns:
        if name not in schema.nullable:
            bad = bad | F.col(name).isNull()
        if kind == "u64":
            bad = bad | F.coalesce((F.col(name) < 0) | (F.col(name) >= F.lit("18446744073709551616").cast("decimal(20,0)")), F.lit(False))
    return df.where(bad)


def keyed(df: DataFrame, schema: TableSchema, partitions: int) -> DataFrame:
    """``df`` with part and row_key."""
    rows = df.withColumn("row_key", schema.row_key())
    return rows.withColumn("part", partition_of(F.col("row_key"), partitions))


def scan(df: DataFrame, schema: TableSchema, partitions: int) -> DataFrame:
    """All rows by partition, then key."""
    return keyed(df, schema, partitions).orderBy("part", "row_key")


def lookup(table: DataFrame, wanted: DataFrame, schema: TableSchema, partitions: int) -> DataFrame:
    """The rows of ``table`` (with part and row_key) whose key is that of a row of ``wanted`` (the key's columns)."""
    keys = keyed(wanted, schema, partitions).select("part", "row_key").distinct()
    return table.join(keys, ["part", "row_key"], "left_semi")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


class ConflictError(ValueError):
    """A mutation that doesn't fit the table."""


def _require_empty(df: DataFrame, what: str) -> None:
    bad = df.limit(3).collect()
    if bad:
        raise ConflictError(f"{what}: {[r.asDict() for r in bad]}")


def apply_transaction(table: DataFrame, mutations: DataFrame, key: list[str], images: list[str]) -> DataFrame:
    """The table after all mutations, or an error and no change.

    ``mutations`` has op (insert, delete, update), the key, ``before_x`` and ``after_x`` for every
    column x of ``images``.  A key occurs once; inserts need an absent key, the others the exact
    before-image; an update must raise ``version``.
    """
    _require_empty(duplicate_keys(mutations, key), "a key is changed twice")
    joined = table.withColumn("__here", F.lit(True)).join(mutations, key, "full_outer")
    same = F.lit(True)
    for c in images:
        same = same & F.col(c).eqNullSafe(F.col(f"before_{c}"))
    here = F.coalesce("__here", F.lit(False))
    bad = ((F.col("op") == "insert") & here) | (F.col("op").isin("delete", "update") & (~here | ~same))
    if "version" in images:
        bad = bad | ((F.col("op") == "update") & ~(F.col("after_version") > F.col("before_version")))
    _require_empty(joined.where(F.col("op").isNotNull() & bad).select(*key, "op"), "a mutation doesn't fit")
    changed = F.col("op").isin("insert", "update")
    kept = joined.where(F.col("op").isNull() | (F.col("op") != "delete"))
    return kept.select(*key, *[F.when(changed, F.col(f"after_{c}")).otherwise(F.col(c)).alias(c) for c in images])


def replay(log: DataFrame, key: list[str], order_by: str, images: list[str], op: str = "op") -> DataFrame:
    """The rows that are left after a whole log: the last image of every key, unless it is a delete.

    A transaction delivered twice changes nothing, as its last image is the same.
    """
    last = log.groupBy(*key).agg(F.max_by(F.struct(op, *images), F.col(order_by)).alias("last"))
    return last.where(F.col(f"last.{op}") != "delete").select(*key, *[F.col(f"last.{c}").alias(c) for c in images])


def check_contiguous(log: DataFrame, revision: str) -> None:
    """Raise on a gap or a repeated revision; nothing is buffered or reordered over a gap."""
    low, high, n, distinct = log.agg(F.min(revision), F.max(revision), F.count(F.lit(1)), F.count_distinct(revision)).first()
    if n and (n != distinct or high - low + 1 != n):
        raise ConflictError(f"revisions {low} to {high} have {n} entries, {distinct} distinct")


def summary(rows: DataFrame, key_hex: Column, partitions: int, e: Column, field: PrimeField, offset: int) -> DataFrame:
    """The multiset state of every partition of a table."""
    return laws.multiset_signature(rows.withColumn("part", partition_of(key_hex, partitions)), ["part"], e, field, [offset])


def apply_delta(states: DataFrame, changes: DataFrame, keys: list[str], field: PrimeField, e: Column, offset: int, sign: Column) -> DataFrame:
    """Multiset states (product_0, zeros_0, n) after changes with sign +1 or -1; too few items raise."""
    moved = laws.multiset_signature(changes, keys, e, field, [offset], sign).select(*keys, F.col("product_0").alias("p"), F.col("zeros_0").alias("z"), F.col("n").alias("m"))
    joined = states.join(moved, keys, "full_outer")
    n, zeros = (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) for a, b in (("n", "m"), ("zeros_0", "z")))
    product = field.c_mul(F.coalesce("product_0", F.lit(1)), F.coalesce("p", F.lit(1)))
    checked = F.when((n < 0) | (zeros < 0), F.raise_error(F.lit("item absent"))).otherwise(n)
    return joined.select(*keys, product.alias("product_0"), zeros.alias("zeros_0"), checked.alias("n"))


def merged_summary(parts: DataFrame, field: PrimeField) -> DataFrame:
    """The summary of the whole table from those of its partitions: rows, product, zeros, and the value with zeros."""
    whole = laws.merge_multiset(parts.withColumn("__all", F.lit(0)), ["__all"], field, 1)
    return whole.select("product_0", "zeros_0", "n", laws.evaluated(F.col("product_0"), F.col("zeros_0")).alias("evaluation"))


# --- tables in folders ------------------------------------------------------------------------------------


class Versions:
    """Tables that are kept by revision in a folder.

    A revision counts once its mark is there, and the mark is made when its tables are written whole; so
    a reader sees the last complete revision, whatever stopped a writer.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file_system(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        return hadoop, hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    @property
    def revision(self) -> int | None:
        hadoop, files = self._file_system()
        marks = files.globStatus(hadoop(f"{self.path}/*.done"))
        found = [int(m.getPath().getName().split(".")[0]) for m in marks or []]
        return max(found, default=None)

    def table(self, name: str, revision: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.revision if revision is None else revision}/{name}")

    def commit(self, revision: int, tables: dict[str, DataFrame]) -> None:
        now = self.revision
        if now is not None and revision <= now:
            raise ConflictError(f"revision {revision} is not behind {now}")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{revision}/{name}")
        hadoop, files = self._file_system()
        files.create(hadoop(f"{self.path}/{revision}.done"), True).close()


@dataclass(frozen=True)
class Report:
    """What a transaction or log did: entries applied and passed over, and the revision after them."""

    applied: int
    skipped: int
    revision: int


class RevisionedTable:
    """A table with a schema, a namespace and a revision, changed by transactions alone."""

    def __init__(self, spark: SparkSession, path: str, schema: TableSchema, namespace: bytes, limits: codecs.Limits = codecs.Limits()):
        self.spark, self.schema, self.namespace, self.limits = spark, schema, namespace, limits
        self.versions = Versions(spark, path)

    def create(self, rows: DataFrame) -> None:
        """Revision 0; rows have ``version`` and the schema's columns."""
        rows = rows.select("version", *[n for n, _ in self.schema.columns])
        _require_empty(violations(rows, self.schema), "rows break the schema")
        _require_empty(duplicate_keys(rows, list(self.schema.key)), "duplicate keys")
        self.versions.commit(0, {"rows": rows, "applied": self.spark.createDataFrame([], "transaction_id string, revision bigint")})

    @property
    def revision(self) -> int:
        return self.versions.revision

    def rows(self) -> DataFrame:
        return self.versions.table("rows")

    def _checked(self, found: DataFrame) -> DataFrame:
        """Mutations with their key; an update of a key raises."""
        for k in self.schema.key:
            found = found.withColumn(k, F.coalesce(f"before_{k}", f"after_{k}"))
        moved = F.lit(False)
        for k in self.schema.key:
            moved = moved | ~F.col(f"before_{k}").eqNullSafe(F.col(f"after_{k}"))
        _require_empty(found.where((F.col("op") == "update") & moved).select("seq"), "a key is updated")
        return found

    def _listed(self, transactions: list[bytes]):
        """(transaction id, source revision, mutations, nothing to release); namespace, schema and limits are checked on the way."""
        for data in transactions:
            source, _ = codecs.read_transaction(self.schema, self.namespace, data, self.limits)
            one = self.spark.createDataFrame([(bytearray(data),)], "transaction binary")
            found = self._checked(codecs.decode_transactions(one, "transaction", self.schema, self.namespace, self.limits))
            yield hashlib.sha256(b"sigmafold-transaction-v1\0" + len(data).to_bytes(8, "little") + data).hexdigest(), source, lambda found=found: (found, [])

    def _in_parts(self, parts: DataFrame):
        """The same for transactions in parts, by revision; only one that is applied is read whole."""
        codecs.check_transaction_parts(parts, self.schema, self.namespace, self.limits)
        # At most a log's entries.
        for r in codecs.transaction_ids(parts).orderBy("source_revision").collect():

            def found(source=r.source_revision):
                mine = codecs.decode_transaction_parts(parts.where(F.col("source_revision") == source), self.schema, self.namespace, self.limits)
                kept = materialise(mine, "mutations")
                return self._checked(kept), [kept]

            yield r.transaction_id, r.source_revision, found

    def replay(self, transactions: list[bytes] | DataFrame) -> Report:
        """Apply a log's transactions in order, all or none; as bytes, or in parts (see ``codecs.encode_transaction_parts``) whatever their size.

        A transaction that was applied before is passed over; one that expects another revision raises.
        """
        known = {r.transaction_id for r in self.versions.table("applied").collect()}  # at most a log's entries
        revision, rows, ids, skipped = self.revision, self.rows(), [], 0
        images = ["version", *[n for n, _ in self.schema.columns if n not in self.schema.key]]
        for name, source, found in self._in_parts(transactions) if isinstance(transactions, DataFrame) else self._listed(transactions):
            if name in known:
                skipped += 1
                continue
            if source != revision:
                raise ConflictError(f"a transaction expects revision {source}, the table has {revision}")
            mutations, done = found()
            rows = materialise(apply_transaction(rows, mutations, list(self.schema.key), images), "candidate")
            release(*done)
            known.add(name)
            ids.append((name, revision + 1))
            revision += 1
        if len(known) > self.limits.log_entries:
            raise ConflictError("over the limit of log entries")
        if ids:
            more = self.spark.createDataFrame(ids, "transaction_id string, revision bigint")
            self.versions.commit(revision, {"rows": rows.select("version", *[n for n, _ in self.schema.columns]), "applied": self.versions.table("applied").unionByName(more).coalesce(1)})
        return Report(len(ids), skipped, revision)

    def apply(self, data: bytes) -> Report:
        """Apply one transaction."""
        return self.replay([data])
