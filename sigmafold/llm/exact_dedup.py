"""Exact duplicates by deterministic block naming.

A document is cut into blocks of a fixed number of bytes.  Distinct blocks are sorted and replaced by
integers; then adjacent pairs of integers are sorted and renamed, again and again, until one integer
is left of each document.  Each renaming is one-to-one, so equal integers mean equal documents: no
hash value decides.
"""

from __future__ import annotations

import hashlib

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmafold.runtime import materialise, numbered

#: Bytes of normalised text in a block; most documents are one block, a text of n bytes needs log2(n / BLOCK_BYTES) renamings.
BLOCK_BYTES = 16_384
_ROW_BITS = 40


def _cutter(block_bytes: int):
    def cut(batches):
        import pyarrow as pa
        import xxhash
        import zstandard

        # A lossless code keeps blocks apart as their bytes do, with fewer bytes to sort.  Its tag only
        # finds it: see _named_blocks.
        packer = zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False)
        names = ["uid", "doc_id", "pos", "n_blocks", "tag", "code", "text_sha256"]
        for batch in batches:
            out = [[] for _ in names]
            for uid, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
                n = max(1, -(-len(raw) // block_bytes))
                for pos in range(n):
                    part = raw[pos * block_bytes : (pos + 1) * block_bytes]
                    for column, value in zip(out, (uid, doc_id, pos, n, xxhash.xxh3_128_digest(part), packer.compress(part), hashlib.sha256(raw).hexdigest() if pos == 0 else None)):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    return cut


def _number(batches):
    """Give the sorted rows of each partition consecutive integers; the partition's number leads."""
    import numpy as np
    import pyarrow as pa

    name = TaskContext.get().partitionId() << _ROW_BITS
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(name, name + n, dtype=np.int64))], names=[*batch.schema.names, "name"])
        name += n


def _named(rows: DataFrame, keys: list[str], kinds: str) -> DataFrame:
    """``rows`` with a ``name`` that is equal where ``keys`` are equal.

    Distinct keys are found with a map-side step, so a key that a third of all rows share reaches the
    exchange once a task.  The way back is a sort-merge join of two plain exchanges, which adaptive
    execution splits where one key is hot.
    """
    names = rows.select(*keys).distinct().sortWithinPartitions(*keys).mapInArrow(_number, f"{kinds}, name bigint")
    return rows.join(names, keys)


def _unpacked(batches):
    """Raw bytes in the place of codes."""
    import pyarrow as pa
    import zstandard

    reader = zstandard.ZstdDecompressor()
    for batch in batches:
        raw = pa.array([reader.decompress(c) for c in batch.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), raw, batch.column(2)], names=["tag", "raw", "name"])


def _named_blocks(pieces: DataFrame) -> DataFrame:
    """``pieces`` with a ``name`` in the place of tag and code, equal where the blocks' bytes are equal.

    Distinct codes are found and sorted whole, so no hash decides; the way back to the rows is by tag
    where a tag belongs to one code, which is checked, else by code.  Codes of one tag may differ for
    equal bytes, if executors have other versions of the coder: then the bytes are compared.
    """
    codes = pieces.select("tag", "code").distinct().sortWithinPartitions("tag", "code").mapInArrow(_number, "tag binary, code binary, name bigint")
    codes = materialise(codes, "codes")
    shared = materialise(codes.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tag"), "shared-tags")
    if shared.isEmpty():
        return pieces.drop("code").join(codes.select("tag", "name"), "tag").drop("tag")
    several = materialise(codes.join(shared, "tag"), "shared-codes")
    bytes_named = several.mapInArrow(_unpacked, "tag binary, raw binary, name bigint")
    first = bytes_named.groupBy("tag", "raw").agg(F.min("name").alias("least"), F.collect_set("name").alias("names"))
    same = materialise(first.select(F.explode("names").alias("name"), "least"), "same-codes")
    settled = several.join(same, "name").select("tag", "code", F.col("least").alias("name"))
    plain = pieces.join(shared, "tag", "left_anti").drop("code").join(codes.select("tag", "name"), "tag").drop("tag")
    return plain.unionByName(pieces.join(settled, ["tag", "code"]).drop("tag", "code"))


def name_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, uid: Column | None = None) -> DataFrame:
    """One row per input row: uid, doc_id, n_blocks, name, text_sha256.

    Two rows have the same (n_blocks, name) exactly if their texts are equal after lower-casing A-Z.
    A null text counts as empty; other columns are not read but ``uid``, a number of each row that is
    drawn here if there is none.
    """
    uid = F.monotonically_increasing_id() if uid is None else uid
    pieces = docs.select(uid.alias("uid"), F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(
        _cutter(block_bytes), "uid bigint, doc_id bigint, pos bigint, n_blocks bigint, tag binary, code binary, text_sha256 string"
    )
    level = materialise(_named_blocks(materialise(pieces, "pieces")), "blocks")
    single = level.where("n_blocks = 1").select("uid", "doc_id", "n_blocks", "name", "text_sha256")
    most = level.where("n_blocks > 1").agg(F.max("n_blocks")).first()[0] or 1
    if most == 1:
        return single
    heads = level.where("n_blocks > 1 and pos = 0").select("uid", "doc_id", "n_blocks", "text_sha256")
    current, width = level.where("n_blocks > 1").select("uid", "pos", "name"), most
    while width > 1:
        half = F.expr("pos div 2").alias("pos")
        pairs = current.groupBy("uid", half).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),
        )
        current = materialise(_named(pairs, ["first", "second"], "first bigint, second bigint").select("uid", "pos", "name"), "pairs")
        width = -(-width // 2)
    long = heads.join(current.select("uid", "name"), "uid").select("uid", "doc_id", "n_blocks", "name", "text_sha256")
    return single.unionByName(long)


def _marked(docs: DataFrame, block_bytes: int, uid: Column | None = None) -> DataFrame:
    named = materialise(name_documents(docs, block_bytes, uid), "named")
    rank = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("doc"), F.col("doc_id").alias("keep_id"), F.col("uid"))
    groups = named.groupBy("n_blocks", "name").agg(F.max(rank).alias("top"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = materialise(groups.select("n_blocks", "name", "top.keep_id", F.col("top.uid").alias("top_uid"), "group_size"), "groups")
    joined = named.join(groups, ["n_blocks", "name"], "left")
    alone = F.col("top_uid").isNull()
    return joined.select(
        "uid",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("uid") == F.col("top_uid"))).alias("kept"),
        "text_sha256",
    )


def dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Mark exact duplicates: doc_id, keep_id, group_size, kept, text_sha256, one row per input row.

    Of equal texts the row with the largest doc_id stays; of rows that repeat this doc_id, one.  Null
    and empty texts are equal.  A row without doc_id stays only where its group has no other.  An
    empty table gives an empty result; extra columns are ignored.
    """
    return _marked(docs, block_bytes).drop("uid")


def drop_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of equal texts one, see ``dedup``."""
    keyed, row = numbered(docs, "rows")
    gone = _marked(keyed, block_bytes, F.col(row)).where("not kept").select(F.col("uid").alias(row))
    return keyed.join(gone.hint("merge"), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents; null texts are empty ones."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""
