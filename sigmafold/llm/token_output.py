"""Token ids as Simple-8b files.

A file holds the ids of whole documents in ascending doc_id order, in blocks.  A block has a header
with the place of each of its streams, and the streams: doc_id differences, document lengths, the
block's ids by falling frequency, and every document's ids as ranks in that list.  Each stream is a
row of 64-bit words; a word's top four bits select how many values of which width it packs.
"""

from __future__ import annotations

import struct
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmafold.llm.token_ids import PieceEncoder, slices
from sigmafold.runtime import scratch_path

#: Fixed values of the coding: values in a word and bits of each, by selector; selector 0 is the
#: escape, whose low bits are the place of a value of over 60 bits behind the last word.
PACKED = ((0, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
MAGIC = b"S8B1"
_HEADER = struct.Struct("<4sIqQQ8Q")
#: A block ends with the document that brings it to so many ids.
BLOCK_TOKENS = 1 << 18
END = 2


def _LIMITS():
    """The least value of 1, 2, 3 ... bits."""
    import numpy as np

    return np.uint64(1) << np.arange(64, dtype=np.uint64)


def encode(values):
    """Values (unsigned 64-bit array) as words, and the count of words before the escaped values."""
    import numpy as np

    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), 0
    # Bits of each value, and of the widest of the next 1, 2, 4 ... values; behind the last one nothing is wide.
    widths = np.searchsorted(_LIMITS(), values, "right").astype(np.uint8)
    widest, best = [np.concatenate([widths, np.zeros(120, np.uint8)])], np.zeros(n, np.uint8)
    for k in range(6):
        widest.append(np.maximum(widest[k][: -(1 << k)], widest[k][1 << k :]))
    for selector in range(15, 0, -1):
        count, bits = PACKED[selector]
        k = count.bit_length() - 1
        # Two runs of a power of two cover ``count`` values.
        wide = np.maximum(widest[k][:n], widest[k][count - (1 << k) : count - (1 << k) + n])
        best[wide <= bits] = selector
    steps, choice, path, at = [max(1, c) for c, _ in PACKED], best.tobytes(), [], 0
    while at < n:
        path.append(at)
        at += steps[choice[at]]
    path = np.array(path)
    chosen = best[path]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(120, np.uint64)])
    for selector in range(2, 16):
        here = np.flatnonzero(chosen == selector)
        if len(here):
            count, bits = PACKED[selector]
            for k in range(count):
                words[here] |= padded[path[here] + k] << np.uint64(k * bits)
    escaped = path[chosen == 0]
    words[chosen == 0] |= np.arange(len(escaped), dtype=np.uint64)
    return np.concatenate([words, values[escaped]]), len(words)


def decode(words, n_packed: int, n: int):
    """The first ``n`` values of words made by ``encode``."""
    import numpy as np

    words = np.asarray(words, np.uint64)
    packed, escaped = words[:n_packed], words[n_packed:]
    selectors = (packed >> np.uint64(60)).astype(np.int64)
    counts = np.array([max(1, c) for c, _ in PACKED])[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in range(2, 16):
        here = np.flatnonzero(selectors == selector)
        if len(here):
            count, bits = PACKED[selector]
            mask = np.uint64((1 << bits) - 1)
            for k in range(count):
                out[starts[here] + k] = (packed[here] >> np.uint64(k * bits)) & mask
    here = np.flatnonzero(selectors == 0)
    out[starts[here]] = escaped[(packed[here] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


def encode_block(doc_ids: list[int | None], lengths, ids) -> bytes:
    """One block.  ``doc_ids`` ascend, nulls first; ``ids`` are those of all documents, end to end."""
    import numpy as np

    ids = np.asarray(ids).astype(np.int64)
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    seen = np.bincount(ids)
    order = np.flatnonzero(seen)
    order = order[np.argsort(-seen[order], kind="stable")]
    rank = np.zeros(len(seen), np.int64)
    rank[order] = np.arange(len(order))
    streams = [encode(x) for x in (np.diff(known, prepend=known[:1]).view(np.uint64), lengths, order, rank[ids])]
    sizes = [x for words, n_packed in streams for x in (len(words), n_packed)]
    first = int(known[0]) if len(known) else 0
    head = _HEADER.pack(MAGIC, nulls, first, len(doc_ids), len(order), *sizes)
    return head + b"".join(words.astype("<u8").tobytes() for words, _ in streams)


def decode_block(payload: bytes):
    """Back to (doc_ids, lengths, ids); ids are unsigned 32-bit."""
    import numpy as np

    magic, nulls, first, n_docs, n_ids, *sizes = _HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at, streams = _HEADER.size, []
    for size, n_packed in zip(sizes[::2], sizes[1::2]):
        streams.append((np.frombuffer(payload, "<u8", size, at), n_packed))
        at += 8 * size
    if at != len(payload):
        raise ValueError("a block of token ids has the wrong length")
    known = decode(*streams[0], n_docs - nulls).view(np.int64).cumsum() + first
    lengths = decode(*streams[1], n_docs).astype(np.int64)
    order = decode(*streams[2], n_ids).astype(np.uint32)
    ranks = decode(*streams[3], int(lengths.sum())).astype(np.int64)
    return [None] * nulls + known.tolist(), lengths, order[ranks] if n_ids else np.zeros(0, np.uint32)


def _writer(tokenizer: str, end: int, block_tokens: int):
    def write(batches):
        import numpy as np
        import pyarrow as pa

        encoder = PieceEncoder.of(tokenizer)
        shard, block, ahead = TaskContext.get().partitionId(), 0, 0
        keys, lengths, parts, held = [], [], [], 0

        def flush():
            nonlocal block, ahead, held
            payload = encode_block(keys, np.array(lengths, np.uint64), np.concatenate(parts))
            row = [shard, block, ahead, len(keys), held, payload]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["shard", "block", "ahead", "n_docs", "n_tokens", "payload"])
            block, ahead, held = block + 1, ahead + held, 0
            for x in (keys, lengths, parts):
                x.clear()
            return out

        for batch in slices(batches, 1):
            flat, starts = encoder.encode(batch.column(1), end)
            sizes = np.diff(starts)
            for i, (key, n) in enumerate(zip(batch.column(0).to_pylist(), sizes.tolist())):
                keys.append(key)
                lengths.append(n)
                parts.append(flat[starts[i] : starts[i + 1]])
                held += n
                if held >= block_tokens:
                    yield flush()
        if keys:
            yield flush()

    return write


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = END, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every text (null: empty), append ``end`` and write the files below ``path``, in ascending doc_id order.

    Texts move once, to their range of doc_id.  Rows that repeat a doc_id follow each other by text;
    rows without doc_id come first.  An empty table writes no block; extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = ordered.mapInArrow(_writer(tokenizer, end, block_tokens), "shard bigint, block bigint, ahead bigint, n_docs bigint, n_tokens bigint, payload binary")
    # Spark's own writer commits a task's files whole or not at all, in any store.
    blocks.write.option("compression", "none").parquet(path)


def _digests(batches):
    import pyarrow as pa

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for base, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            doc_ids, lengths, ids = decode_block(payload.as_py())
            raw, stops = memoryview(ids.astype("<u4").tobytes()), lengths.cumsum()
            crcs = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), lengths.tolist())]
            columns = [doc_ids, stops - lengths + base, lengths, crcs]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _texts(batches):
    import pyarrow as pa

    for batch in batches:
        for base, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            doc_ids, lengths, ids = decode_block(payload.as_py())
            stops = lengths.cumsum()
            lists = pa.ListArray.from_arrays(pa.array([0, *stops.tolist()], pa.int32()), pa.array(ids.astype("int64")))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(stops - lengths + base), lists], names=["doc_id", "start", "ids"])


def _placed(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.schema("shard bigint, block bigint, ahead bigint, n_docs bigint, n_tokens bigint, payload binary").parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row for each partition that wrote: as many as the writing job had tasks.
    return files.join(F.broadcast(shards), "shard").select((F.col("base") + F.col("ahead")).alias("base"), "payload")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids, as the files have them."""
    return _placed(spark, path).mapInArrow(_texts, "doc_id bigint, start bigint, ids array<bigint>")


def digest_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files."""
    return _placed(spark, path).mapInArrow(_digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written in ascending doc_id and read back; null texts are an end alone."""
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digest_token_files(spark, path)
