"""Canonical bytes: rows, transactions, logs, compact states, deltas, journals, snapshots and checkpoints.

Encoders are column expressions; what belongs to one transaction, log or journal is gathered under the
limits that those formats have.  Decoders are strict: a wrong length, identity, tag or order raises, and
nothing of the bytes is kept.  Integers are little-endian.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmafold.runtime import materialise

# Magics, versions, header lengths and tags of the formats.
ROW, TRANSACTION, LOG, STATE, DELTA, JOURNAL, SNAPSHOT, CHECKPOINT = (m.encode() for m in ("MFRW", "MFTX", "MFTL", "MFSG", "MFDE", "MFDJ", "MFTS", "MFST"))
VERSION = 1
TYPES = {"bool": 1, "i64": 2, "u64": 3, "bytes": 4, "text": 5}
OPS = {"insert": 1, "delete": 2, "update": 3}
DELTA_KINDS = {"additive": 1, "multiset": 2, "append": 3, "trim": 4}
SNAPSHOT_KINDS = {"sequence": 1, "multiset": 2}
SPARK_TYPES = {"bool": "boolean", "i64": "bigint", "u64": "decimal(20,0)", "bytes": "binary", "text": "string"}


class WireError(ValueError):
    """Bytes that are not canonical, or not of the expected identity."""


@dataclass(frozen=True)
class Limits:
    """Most mutations, row bytes and transaction bytes of a transaction; most entries and bytes of a log."""

    mutations: int = 100_000
    row_bytes: int = 16 << 20
    transaction_bytes: int = 64 << 20
    log_entries: int = 1_000_000
    log_bytes: int = 256 << 20


#: For transactions and logs that are kept in parts: none is gathered, so their size has no limit; that of a row stays.
IN_PARTS = Limits(mutations=(1 << 63) - 1, transaction_bytes=(1 << 63) - 1, log_bytes=(1 << 63) - 1)
#: Bytes of a part, about; small, as a reader of Parquet holds 4096 rows at once.
PART_BYTES = 8 << 10


# --- bytes as columns ---------------------------------------------------------------------------------


def raw(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def le(x: Column, size: int = 8) -> Column:
    """The low ``size`` bytes of a bigint."""
    high_first = F.decode(F.unhex(F.lpad(F.hex(x.cast("bigint")), 16, "0")), "ISO-8859-1")
    # One character a byte, so the characters reversed are the bytes reversed.
    out = F.encode(F.reverse(high_first), "ISO-8859-1")
    return out if size == 8 else F.substring(out, 1, size)


def le_unsigned(x: Column) -> Column:
    """A decimal of 0 to 2**64 - 1."""
    half = F.lit(1 << 32).cast("decimal(20,0)")
    low = F.pmod(x.cast("decimal(20,0)"), half)
    return F.concat(le(low, 4), le(((x.cast("decimal(20,0)") - low) / half).cast("bigint"), 4))


def frame(data: Column) -> Column:
    return F.concat(le(F.octet_length(data)), data)


def value(x: Column, kind: str) -> Column:
    """Tag and bytes of one value of a row; null is its tag alone."""
    if kind == "bool":
        body = F.unhex(F.when(x, F.lit("01")).otherwise(F.lit("00")))
    elif kind == "i64":
        body = le(x)
    elif kind == "u64":
        body = le_unsigned(x)
    else:
        body = frame(x.cast("binary"))
    return F.when(x.isNull(), raw(b"\0")).otherwise(F.concat(raw(bytes([TYPES[kind]])), body))


def domain_hash(domain: str, data: Column) -> Column:
    """SHA-256 (hexadecimal) of the domain, a zero, the length and the bytes."""
    return F.sha2(F.concat(raw(domain.encode() + b"\0"), frame(data)), 256)


def namespace_of(descriptor: bytes) -> bytes:
    return hashlib.sha256(b"sigmafold-namespace-v1\0" + len(descriptor).to_bytes(8, "little") + descriptor).digest()


def _joined(order: Column, data: Column) -> Column:
    """An aggregate: the binaries of a group in order, end to end."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("at"), F.hex(data).alias("bytes"))))
    return F.unhex(F.array_join(F.transform(parts, lambda p: p["bytes"]), ""))


def _within(x: Column, size: Column, most: int, what: str) -> Column:
    return F.when(size > most, F.raise_error(F.lit(f"over the limit of {what}"))).otherwise(x)


class Reader:
    """A cursor over bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int, what: str) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise WireError(f"truncated {what}")
        out, self.at = self.data[self.at : self.at + n], self.at + n
        return out

    def expect(self, data: bytes, what: str) -> None:
        if self.take(len(data), what) != data:
            raise WireError(f"wrong {what}")

    def number(self, what: str, size: int = 8) -> int:
        return int.from_bytes(self.take(size, what), "little")

    def framed(self, what: str, most: int) -> bytes:
        n = self.number(what)
        if n > most:
            raise WireError(f"over the limit of {what}")
        return self.take(n, what)

    def close(self, what: str) -> None:
        if self.at != len(self.data):
            raise WireError(f"bytes behind the {what}")


# --- rows -----------------------------------------------------------------------------------------------


def encode_row(schema, column=F.col, version: Column | None = None) -> Column:
    """The row's bytes; ``column`` gives the column of a name, ``version`` is 1 or more."""
    version = column("version") if version is None else version
    head = raw(ROW + VERSION.to_bytes(2, "little") + b"\0\0" + bytes.fromhex(schema.id))
    return F.concat(head, le(version), raw(len(schema.columns).to_bytes(8, "little")), *[value(column(n), k) for n, k in schema.columns])


def read_row(schema, data: bytes) -> tuple:
    """(version, values ...) of one row's bytes."""
    r = Reader(data)
    r.expect(ROW + VERSION.to_bytes(2, "little") + b"\0\0", "row header")
    r.expect(bytes.fromhex(schema.id), "schema")
    version = r.number("version")
    if r.number("value count") != len(schema.columns):
        raise WireError("wrong value count")
    out = []
    for name, kind in schema.columns:
        tag = r.number("value tag", 1)
        if tag == 0:
            if name not in schema.nullable:
                raise WireError(f"null in {name}")
            out.append(None)
            continue
        if tag != TYPES[kind]:
            raise WireError(f"wrong type of {name}")
        if kind == "bool":
            x = r.number("boolean", 1)
            if x > 1:
                raise WireError("a boolean is 0 or 1")
            out.append(bool(x))
        elif kind in ("i64", "u64"):
            out.append(int.from_bytes(r.take(8, kind), "little", signed=kind == "i64"))
        else:
            data = r.framed(name, 1 << 40)
            try:
                out.append(data if kind == "bytes" else data.decode())
            except UnicodeDecodeError:
                raise WireError(f"{name} is no UTF-8") from None
    r.close("row")
    if version == 0:
        raise WireError("version 0")
    return version, *out


def row_fields(schema, prefix: str = "") -> str:
    return ", ".join([f"`{prefix}version` bigint", *[f"`{prefix}{n}` {SPARK_TYPES[k]}" for n, k in schema.columns]])


def _arrow(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _emit(rows: list[tuple], arrow):
    import decimal

    import pyarrow as pa

    columns = list(zip(*rows)) if rows else [()] * len(arrow)
    wide = [pa.types.is_decimal(f.type) for f in arrow]
    return pa.RecordBatch.from_arrays([pa.array([decimal.Decimal(v) if w and v is not None else v for v in c], f.type) for c, f, w in zip(columns, arrow, wide)], schema=arrow)


def decode_rows(df: DataFrame, data: str, schema, keep: list[str] = ()) -> DataFrame:
    """``keep`` columns, version and the values of the rows' bytes in column ``data``."""
    types = dict(df.dtypes)
    ddl = ", ".join([*[f"`{k}` {types[k]}" for k in keep], row_fields(schema)])
    arrow, width = _arrow(ddl), len(keep)

    def decode(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            yield _emit([(*row[:width], *read_row(schema, row[width])) for row in zip(*columns)], arrow)

    return df.select(*keep, data).mapInArrow(decode, ddl)


# --- transactions and logs ---------------------------------------------------------------------------------


def encode_transactions(mutations: DataFrame, schema, namespace: bytes, limits: Limits = Limits()) -> DataFrame:
    """source_revision, target_revision, mutations, transaction, transaction_id: one row per revision.

    ``mutations`` has source_revision, seq (their order), op, and before_x and after_x for version and
    every column x of the schema.
    """
    rows = _mutation_bytes(mutations, schema, limits)
    # A group is one transaction: the limits bound what is gathered.
    sums = rows.groupBy("source_revision").agg(F.count(F.lit(1)).alias("mutations"), F.sum(F.octet_length("bytes")).alias("size"), _joined(F.col("seq"), F.col("bytes")).alias("body"))
    body = _within(_within(F.concat(_transaction_head(schema, namespace), F.col("body")), F.col("mutations"), limits.mutations, "mutations"), F.col("size") + 96, limits.transaction_bytes, "transaction bytes")
    out = sums.select("source_revision", (F.col("source_revision") + 1).alias("target_revision"), "mutations", body.alias("transaction"))
    return out.withColumn("transaction_id", transaction_id(F.col("transaction")))


def _transaction_head(schema, namespace: bytes) -> Column:
    head = raw(TRANSACTION + VERSION.to_bytes(2, "little") + b"\0\0" + namespace + bytes.fromhex(schema.id))
    return F.concat(head, le(F.col("source_revision")), le(F.col("source_revision") + 1), le(F.col("mutations")))


def _mutation_bytes(mutations: DataFrame, schema, limits: Limits) -> DataFrame:
    """source_revision, seq and the bytes of every mutation."""
    op = F.col("op")
    # Each image is made once, and only where the mutation has it.
    made = mutations.select(
        "source_revision", "seq", "op",
        F.when(op != "insert", encode_row(schema, lambda n: F.col(f"before_{n}"))).alias("before"),
        F.when(op != "delete", encode_row(schema, lambda n: F.col(f"after_{n}"))).alias("after"),
    )
    before, after = F.col("before"), F.col("after")
    sizes = F.greatest(F.octet_length(before), F.octet_length(after))
    images = F.when(op == "insert", frame(after)).when(op == "delete", frame(before)).when(op == "update", F.concat(frame(before), frame(after)))
    known = F.when(images.isNull(), F.raise_error(F.lit("unknown kind of mutation or null key"))).otherwise(images)
    kind = F.unhex(F.concat(F.lit("0"), F.when(F.col("op") == "insert", "1").when(F.col("op") == "delete", "2").otherwise("3")))
    return made.select("source_revision", "seq", _within(F.concat(kind, known), sizes, limits.row_bytes, "row bytes").alias("bytes"))


def transaction_id(data: Column) -> Column:
    return domain_hash("sigmafold-transaction-v1", data)


def read_transaction(schema, namespace: bytes, data: bytes, limits: Limits = Limits()) -> tuple[int, list[tuple]]:
    """(source revision, mutations as (op, before, after), a row being (version, values ...) or None)."""
    if len(data) > limits.transaction_bytes:
        raise WireError("over the limit of transaction bytes")
    r = Reader(data)
    source, n = _read_head(r, schema, namespace, limits)
    names = {v: k for k, v in OPS.items()}
    out = [_read_mutation(r, schema, names, limits) for _ in range(n)]
    r.close("transaction")
    return source, out


def _read_head(r: Reader, schema, namespace: bytes, limits: Limits) -> tuple[int, int]:
    """(source revision, number of mutations)."""
    r.expect(TRANSACTION + VERSION.to_bytes(2, "little") + b"\0\0", "transaction header")
    r.expect(namespace, "namespace")
    r.expect(bytes.fromhex(schema.id), "schema")
    source = r.number("source revision")
    if r.number("target revision") != source + 1:
        raise WireError("wrong target revision")
    n = r.number("mutation count")
    if not 0 < n <= limits.mutations:
        raise WireError("over the limit of mutations")
    return source, n


def _read_mutation(r: Reader, schema, names: dict, limits: Limits) -> tuple:
    op = names.get(r.number("kind of mutation", 1))
    if op is None:
        raise WireError("unknown kind of mutation")
    first = read_row(schema, r.framed("row", limits.row_bytes))
    second = read_row(schema, r.framed("row", limits.row_bytes)) if op == "update" else None
    return (op, None, first) if op == "insert" else (op, first, second)


def decode_transactions(df: DataFrame, data: str, schema, namespace: bytes, limits: Limits = Limits()) -> DataFrame:
    """The mutations that ``encode_transactions`` took, seq counted from 0."""
    ddl = f"source_revision bigint, seq bigint, op string, {row_fields(schema, 'before_')}, {row_fields(schema, 'after_')}"
    arrow, none = _arrow(ddl), (None,) * (len(schema.columns) + 1)

    def decode(batches):
        for batch in batches:
            for cell in batch.column(0):
                source, found = read_transaction(schema, namespace, cell.as_py(), limits)
                yield _emit([(source, k, op, *(before or none), *(after or none)) for k, (op, before, after) in enumerate(found)], arrow)

    return df.select(data).mapInArrow(decode, ddl)


def encode_log(transactions: DataFrame, limits: Limits = Limits(), magic: bytes = LOG, order: str = "source_revision", data: str = "transaction") -> DataFrame:
    """One row: the log of all transactions by revision, as bytes.  The limits bound what is gathered."""
    size, n = F.sum(F.octet_length(data) + 8) + 14, F.count(F.lit(1))
    sums = transactions.agg(n.alias("entries"), size.alias("size"), _joined(F.col(order), frame(F.col(data))).alias("body"))
    body = F.concat(raw(magic + VERSION.to_bytes(2, "little")), le(F.col("entries")), F.coalesce("body", raw(b"")))
    return sums.select("entries", _within(_within(body, F.col("entries"), limits.log_entries, "log entries"), F.col("size"), limits.log_bytes, "log bytes").alias("log"))


def read_log(data: bytes, limits: Limits = Limits(), magic: bytes = LOG, entry_bytes: int | None = None) -> list[bytes]:
    if len(data) > limits.log_bytes:
        raise WireError("over the limit of log bytes")
    r = Reader(data)
    r.expect(magic + VERSION.to_bytes(2, "little"), "log header")
    n = r.number("entry count")
    if n > limits.log_entries:
        raise WireError("over the limit of log entries")
    out = [r.framed("entry", limits.transaction_bytes if entry_bytes is None else entry_bytes) for _ in range(n)]
    r.close("log")
    return out


def decode_log(df: DataFrame, data: str, limits: Limits = Limits(), magic: bytes = LOG) -> DataFrame:
    """position and entry of every entry of the logs in column ``data``."""
    ddl = "position bigint, entry binary"
    arrow = _arrow(ddl)

    def decode(batches):
        for batch in batches:
            for cell in batch.column(0):
                yield _emit(list(enumerate(read_log(cell.as_py(), limits, magic))), arrow)

    return df.select(data).mapInArrow(decode, ddl)


# --- transactions and logs in parts ---------------------------------------------------------------------------


def encode_transaction_parts(mutations: DataFrame, schema, namespace: bytes, limits: Limits = IN_PARTS) -> DataFrame:
    """source_revision, part, first, mutations, octets, bytes: the bytes of ``encode_transactions`` in parts, whatever their size.

    Part 0 is the head, with the octets of the whole transaction; every other part holds ``mutations``
    whole ones, of which ``first`` is the number of the first.  Mutations are dealt out by revision and
    order, and a part is what a task reads at once, so no task holds a transaction.
    """
    rows = _mutation_bytes(mutations.repartitionByRange("source_revision", "seq"), schema, limits)
    known = F.coalesce("source_revision", F.raise_error(F.lit("no source revision")).cast("bigint")).cast("bigint")
    ordered = rows.sortWithinPartitions("source_revision", "seq", "bytes").select(known.alias("source_revision"), "bytes")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        place, now, part, first = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            revision, column = batch.column(0).to_numpy(), batch.column(1).cast(pa.large_binary())
            at = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: batch.num_rows + 1]
            block = (at[:-1] - at[0]) // PART_BYTES
            cuts = [0, *(np.flatnonzero((revision[1:] != revision[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
            out = []
            for low, high in zip(cuts, cuts[1:]):
                if now != revision[low]:
                    now, part, first = int(revision[low]), 0, 0
                out.append((place, now, part, first, high - low, column.buffers()[2].slice(at[low], at[high] - at[low]).to_pybytes()))
                part, first = part + 1, first + high - low
            yield _emit(out, arrow)

    ddl = "place int, source_revision bigint, part bigint, first bigint, mutations bigint, bytes binary"
    arrow = _arrow(ddl)
    parts = materialise(ordered.mapInArrow(cut, ddl), "parts")
    # What each task wrote of a revision, which has few tasks or few others beside it in its task.
    of = Window.partitionBy("source_revision").orderBy("place")
    runs = parts.groupBy("source_revision", "place").agg(F.count(F.lit(1)).alias("n"), F.sum("mutations").alias("m"))
    runs = runs.select("source_revision", "place", (F.sum("n").over(of) - F.col("n") + 1).alias("parts_before"), (F.sum("m").over(of) - F.col("m")).alias("before"))
    body = parts.join(F.broadcast(runs), ["source_revision", "place"]).select(
        "source_revision", (F.col("part") + F.col("parts_before")).alias("part"), (F.col("first") + F.col("before")).alias("first"), "mutations", F.lit(None).cast("bigint").alias("octets"), "bytes"
    )
    sums = parts.groupBy("source_revision").agg(F.sum("mutations").alias("mutations"), F.sum(F.octet_length("bytes")).alias("size"))
    head = _transaction_head(schema, namespace)
    octets = F.col("size") + F.octet_length(head)
    head = _within(_within(head, F.col("mutations"), limits.mutations, "mutations"), octets, limits.transaction_bytes, "transaction bytes")
    none = F.lit(0).cast("bigint")
    return sums.select("source_revision", none.alias("part"), none.alias("first"), none.alias("mutations"), octets.alias("octets"), head.alias("bytes")).unionByName(body)


def digests(parts: DataFrame, key: str, domain: str | None = None) -> DataFrame:
    """``key``, mutations (where the parts have them), digest: SHA-256 of each key's bytes, in a domain's frame if one is named.

    A digest takes bytes in their order: one task reads a key's parts, one after the other.
    """
    counts = "mutations" if "mutations" in parts.columns else F.lit(0).cast("bigint").alias("mutations")
    rows = parts.select(F.col(key).cast("bigint").alias(key), "part", counts, "octets", "bytes").repartition(key).sortWithinPartitions(key, "part")

    def digest(batches):
        now = None
        for batch in batches:
            for k, part, n, octets, data in zip(*batch.columns):
                k, part, data = k.as_py(), part.as_py(), data.as_buffer()
                if part == 0:
                    if now is not None:
                        yield closed(now)
                    size = octets.as_py()
                    now = [k, 0, size, 0, hashlib.sha256(b"" if domain is None else domain.encode() + b"\0" + size.to_bytes(8, "little"))]
                if now is None or now[0] != k or now[1] != part:
                    raise WireError("a part is missing")
                now[1], now[2], now[3] = part + 1, now[2] - len(data), now[3] + n.as_py()
                now[4].update(data)
        if now is not None:
            yield closed(now)

    def closed(now):
        if now[2]:
            raise WireError("parts of another length")
        return _emit([(now[0], now[3], now[4].hexdigest())], arrow)

    ddl = f"`{key}` bigint, mutations bigint, digest string"
    arrow = _arrow(ddl)
    return rows.mapInArrow(digest, ddl)


def transaction_ids(parts: DataFrame) -> DataFrame:
    """source_revision, mutations, transaction_id of every transaction in parts."""
    return digests(parts, "source_revision", "sigmafold-transaction-v1").withColumnRenamed("digest", "transaction_id")


def check_transaction_parts(parts: DataFrame, schema, namespace: bytes, limits: Limits = IN_PARTS) -> None:
    """Raise unless every transaction has its head, all its parts once, and as many mutations as the head says."""

    def heads(batches):
        for batch in batches:
            for revision, data in zip(*[c.to_pylist() for c in batch.columns]):
                r = Reader(data)
                source, n = _read_head(r, schema, namespace, limits)
                r.close("head")
                if source != revision:
                    raise WireError("wrong source revision")
                yield _emit([(revision, n)], arrow)

    ddl = "source_revision bigint, n bigint"
    arrow = _arrow(ddl)
    said = parts.where("part = 0").select("source_revision", "bytes").mapInArrow(heads, ddl)
    of = Window.partitionBy("source_revision").orderBy("part")
    rows = parts.select("source_revision", "part", "first", "mutations", F.row_number().over(of).alias("k"), (F.sum("mutations").over(of) - F.col("mutations")).alias("before"))
    ok = (F.col("part") == F.col("k") - 1) & (F.col("first") == F.col("before"))
    sums = rows.groupBy("source_revision").agg(F.min(F.coalesce(ok, F.lit(False))).alias("ok"), F.sum("mutations").alias("mutations"))
    bad = sums.join(said, "source_revision", "full_outer").where("not coalesce(ok and n = mutations, false)").select("source_revision").limit(1).collect()
    if bad:
        raise WireError(f"parts of transaction {bad[0][0]} are missing or repeat")


def decode_transaction_parts(parts: DataFrame, schema, namespace: bytes, limits: Limits = IN_PARTS) -> DataFrame:
    """The mutations of transactions in parts, as ``decode_transactions`` gives them; each part is read by itself."""
    check_transaction_parts(parts, schema, namespace, limits)
    ddl = f"source_revision bigint, seq bigint, op string, {row_fields(schema, 'before_')}, {row_fields(schema, 'after_')}"
    arrow, none, names = _arrow(ddl), (None,) * (len(schema.columns) + 1), {v: k for k, v in OPS.items()}

    def decode(batches):
        for batch in batches:
            for revision, first, n, data in zip(*batch.columns):
                r, source, at = Reader(data.as_py()), revision.as_py(), first.as_py()
                found = [_read_mutation(r, schema, names, limits) for _ in range(n.as_py())]
                r.close("part")
                yield _emit([(source, at + k, op, *(before or none), *(after or none)) for k, (op, before, after) in enumerate(found)], arrow)

    return parts.where("part > 0").select("source_revision", "first", "mutations", "bytes").mapInArrow(decode, ddl)


def encode_log_parts(parts: DataFrame, limits: Limits = IN_PARTS, magic: bytes = LOG) -> DataFrame:
    """position, part, bytes: the bytes of ``encode_log`` in parts, those of each transaction and its frame; position -1 is the log's head."""
    entries = parts.where("part = 0").select("source_revision", "octets")
    sums = entries.agg(F.count(F.lit(1)).alias("entries"), (F.coalesce(F.sum(F.col("octets") + 8), F.lit(0)) + 14).alias("size"))
    head = F.concat(raw(magic + VERSION.to_bytes(2, "little")), le(F.col("entries")))
    head = _within(_within(head, F.col("entries"), limits.log_entries, "log entries"), F.col("size"), limits.log_bytes, "log bytes")
    top = sums.select(F.lit(-1).cast("bigint").alias("position"), F.lit(0).cast("bigint").alias("part"), head.alias("bytes"))
    # One row for each entry, of which a log has a limited number.
    placed = entries.select("source_revision", (F.row_number().over(Window.orderBy("source_revision")) - 1).cast("bigint").alias("position"))
    framed = F.when(F.col("part") == 0, F.concat(le(F.col("octets")), F.col("bytes"))).otherwise(F.col("bytes"))
    return top.unionByName(parts.join(F.broadcast(placed), "source_revision").select("position", "part", framed.alias("bytes")))


def decode_log_parts(log: DataFrame, limits: Limits = IN_PARTS, magic: bytes = LOG) -> DataFrame:
    """position, part, octets, bytes of all entries of a log in parts, without their frames; a log that isn't whole raises."""
    top = log.where("position = -1").select("part", "bytes").limit(2).collect()
    if len(top) != 1 or top[0].part:
        raise WireError("wrong log header")
    r = Reader(bytes(top[0].bytes))
    r.expect(magic + VERSION.to_bytes(2, "little"), "log header")
    n = r.number("entry count")
    r.close("log header")
    if n > limits.log_entries:
        raise WireError("over the limit of log entries")
    first, size = F.col("part") == 0, F.octet_length("bytes")
    frame_of = F.when(first & (size >= 8), sum((F.conv(F.hex(F.substring("bytes", i + 1, 1)), 16, 10).cast("bigint") * F.lit(1 << (8 * i)) for i in range(7)), F.lit(0).cast("bigint")))
    rows = log.where("position <> -1").select("position", "part", size.alias("size"), frame_of.alias("frame"))
    sums = rows.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("parts"), F.min("part").alias("low"), F.max("part").alias("high"), F.sum("size").alias("size"), F.max("frame").alias("frame"))
    whole = F.expr("low = 0 and high = n - 1 and parts = n and size = frame + 8")
    seen = sums.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("position"), F.lit(0)).alias("low"), F.coalesce(F.max("position"), F.lit(-1)).alias("high"), F.coalesce(F.min(F.coalesce(whole, F.lit(False))), F.lit(True)).alias("whole"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    if not seen.whole or (seen.n, seen.low, seen.high) != (n, 0, n - 1):
        raise WireError("entries of the log are missing or repeat")
    if seen["size"] + 14 > limits.log_bytes:
        raise WireError("over the limit of log bytes")
    return log.where("position <> -1").select("position", "part", frame_of.alias("octets"), F.when(first, F.expr("substring(bytes, 9)")).otherwise(F.col("bytes")).alias("bytes"))


# --- compact states, deltas, journals ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Context:
    """Identity of a state: its law's number and the ids (32 bytes each) of field, encoder and signature."""

    law: int
    field: bytes
    encoder: bytes
    signature: bytes

    @property
    def ids(self) -> bytes:
        return self.field + self.encoder + self.signature

    @property
    def header(self) -> bytes:
        return STATE + VERSION.to_bytes(2, "little") + bytes([self.law, 0]) + self.ids


def context_of(field, encoder: str, law: str, parameters: list[int]) -> Context:
    from sigmafold.operators import laws

    def digest(text: str) -> bytes:
        return hashlib.sha256(text.encode()).digest()

    name = f"p:{field.p}" if hasattr(field, "p") else f"2:{field.m}:{field.tail}"
    return Context(laws.LAWS[law], digest(f"sigmafold-field-v1|{name}"), digest(f"sigmafold-encoder-v1|{encoder}"), bytes.fromhex(laws.context_id(field, encoder, law, parameters)))


def encode_state(context: Context, counters: list[Column], elements: list[Column], width: int = 1) -> Column:
    """Header, then counters and elements (bigints of ``width`` bytes) of a state in the order given."""
    return F.concat(raw(context.header), *[le(c) for c in counters], *[le(e, width) for e in elements])


def encode_multi_state(context: Context, n: Column, zeros: list[Column], products: list[Column], width: int = 1) -> Column:
    """The multi-point multiset law has a zero count before each product."""
    return F.concat(raw(context.header), le(n), *[x for z, p in zip(zeros, products) for x in (le(z), le(p, width))])


def decode_state(data: Column, context: Context, counters: int, elements: int, p: int, width: int = 1) -> Column:
    """A struct c0.., e0..: the counters and elements of a state of this identity; anything else raises."""
    head, at = len(context.header), len(context.header)
    size = head + 8 * counters + width * elements

    def number(start: int, n: int) -> Column:
        return sum((F.conv(F.hex(F.substring(data, start + i + 1, 1)), 16, 10).cast("bigint") * F.lit(1 << (8 * i)) for i in range(min(n, 7))), F.lit(0).cast("bigint"))

    fields = []
    for k in range(counters):
        fields.append(number(at + 8 * k, 8).alias(f"c{k}"))
    at += 8 * counters
    for k in range(elements):
        x = number(at + width * k, width)
        fields.append(F.when(x >= p, F.raise_error(F.lit("not a canonical element"))).otherwise(x).cast("bigint").alias(f"e{k}"))
    bad = (F.octet_length(data) != size) | (F.substring(data, 1, head) != raw(context.header))
    return F.when(bad, F.raise_error(F.lit("not a state of this identity"))).otherwise(F.struct(*fields))


def encode_delta(kind: str, context: Context, namespace: bytes, source_revision: Column, operations: Column, payload: Column) -> Column:
    """A delta's bytes; no operation raises."""
    head = raw(DELTA + VERSION.to_bytes(2, "little") + bytes([DELTA_KINDS[kind], 0]) + namespace)
    out = F.concat(head, le(source_revision), le(source_revision + 1), le(operations), raw(context.ids + bytes([context.law])), payload)
    return F.when(operations == 0, F.raise_error(F.lit("empty delta"))).otherwise(out)


def delta_id(data: Column) -> Column:
    return domain_hash("sigmafold-delta-v1", data)


def pair_payload(removed: Column, added: Column) -> Column:
    return F.concat(frame(removed), frame(added))


def read_delta(data: bytes, kind: str, context: Context, namespace: bytes) -> tuple[int, int, bytes]:
    """(source revision, operations, payload)."""
    r = Reader(data)
    r.expect(DELTA + VERSION.to_bytes(2, "little") + bytes([DELTA_KINDS[kind], 0]), "delta header")
    r.expect(namespace, "namespace")
    source = r.number("source revision")
    if r.number("target revision") != source + 1:
        raise WireError("wrong target revision")
    operations = r.number("operations")
    if not operations:
        raise WireError("empty delta")
    r.expect(context.ids + bytes([context.law]), "context")
    return source, operations, data[r.at :]


def check_journal(entries: list[tuple[int, str]]) -> None:
    """Entries (source revision, delta id) in their order: a gap, a reorder or a repeated id raises."""
    for k, (source, _) in enumerate(entries[1:], 1):
        if source != entries[k - 1][0] + 1:
            raise WireError("revision gap or reorder")
    if len({i for _, i in entries}) != len(entries):
        raise WireError("duplicate delta id")


# --- tracked snapshots and checkpoints -------------------------------------------------------------------------------


def encode_snapshot(items: DataFrame, keys: list[str], kind: str, compact: DataFrame, order: str, item: str, most_items: int = 1_000_000, most_bytes: int = 64 << 20) -> DataFrame:
    """keys, snapshot: a tracked collection and its compact state (column ``state`` of ``compact``).

    ``items`` has one row per entry with ``item`` (binary) and ``multiplicity``, 1 throughout in a
    sequence; ``order`` sorts them.  The limits bound what is gathered.
    """
    m = F.col("multiplicity")
    bad = (m <= 0) if kind == "multiset" else (m != 1)
    entry = F.when(bad, F.raise_error(F.lit("wrong multiplicity"))).otherwise(F.concat(frame(F.col(item)), le(m)))
    sums = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(m).alias("__items"), F.sum(F.octet_length(item) + 16).alias("__size"), _joined(F.col(order), entry).alias("__body"))
    joined = sums.join(compact.select(*keys, "state"), keys)
    head = F.concat(raw(SNAPSHOT + VERSION.to_bytes(2, "little") + bytes([SNAPSHOT_KINDS[kind], 0])), le(F.octet_length("state")), le(F.col("__n")))
    out = _within(_within(F.concat(head, F.col("state"), F.col("__body")), F.col("__items"), most_items, "items"), F.col("__size") + F.octet_length("state") + 24, most_bytes, "total bytes")
    return joined.select(*keys, out.alias("snapshot"))


def read_snapshot(data: bytes, kind: str, most_items: int = 1_000_000, most_item_bytes: int = 16 << 20) -> tuple[bytes, list[tuple[bytes, int]]]:
    """(compact state, entries as (item, multiplicity)); a multiset's items ascend and don't repeat."""
    r = Reader(data)
    r.expect(SNAPSHOT + VERSION.to_bytes(2, "little") + bytes([SNAPSHOT_KINDS[kind], 0]), "snapshot header")
    size, n = r.number("state length"), r.number("entry count")
    compact, out, total = r.take(size, "state"), [], 0
    for _ in range(n):
        item = r.framed("item", most_item_bytes)
        m = r.number("multiplicity")
        total += m
        if m == 0 or (kind == "sequence" and m != 1) or total > most_items:
            raise WireError("wrong multiplicity")
        if kind == "multiset" and out and item <= out[-1][0]:
            raise WireError("items don't ascend")
        out.append((item, m))
    r.close("snapshot")
    return compact, out


def decode_snapshots(df: DataFrame, keys: list[str], data: str, kind: str) -> DataFrame:
    """keys, state, at, item, multiplicity of every entry; comparing the state with one made of the items is the reader's check."""
    types = dict(df.dtypes)
    ddl = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "state binary, at bigint, item binary, multiplicity bigint"])
    arrow, width = _arrow(ddl), len(keys)

    def decode(batches):
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                compact, found = read_snapshot(row[width], kind)
                yield _emit([(*row[:width], compact, k, item, m) for k, (item, m) in enumerate(found)], arrow)

    return df.select(*keys, data).mapInArrow(decode, ddl)


def encode_checkpoint(profile: bytes, revision: Column, root: Column, content: Column) -> Column:
    """A file with its revision and the compact state of its tree's root."""
    head = raw(CHECKPOINT + VERSION.to_bytes(2, "little") + b"\0\0" + profile)
    return F.concat(head, le(revision), le(F.octet_length(content)), le(F.octet_length(root)), root, content)


def decode_checkpoint(data: Column, profile: bytes) -> Column:
    """A struct revision, root, content; wrong headers or lengths raise.  The root is compared with a rebuilt tree's by the reader."""

    def number(start: int) -> Column:
        return sum((F.conv(F.hex(F.substring(data, start + i + 1, 1)), 16, 10).cast("bigint") * F.lit(1 << (8 * i)) for i in range(7)), F.lit(0).cast("bigint"))

    head = CHECKPOINT + VERSION.to_bytes(2, "little") + b"\0\0" + profile
    revision, size, root = number(40), number(48), number(56)
    bad = (F.octet_length(data) < 64) | (F.substring(data, 1, 40) != raw(head)) | (F.octet_length(data) != root + size + 64)
    cut = F.struct(revision.alias("revision"), F.substring(data, F.lit(65), root.cast("int")).alias("root"), F.substring(data, (root + 65).cast("int"), size.cast("int")).alias("content"))
    return F.when(bad, F.raise_error(F.lit("not a checkpoint of this profile"))).otherwise(cut)
