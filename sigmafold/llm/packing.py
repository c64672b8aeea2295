"""Packing token pieces into sequences: vector bin packing by dot products.

A sequence has three limits: tokens, segments and tokens that bear loss.  The open sequence takes the
piece whose demand has the largest dot product with what is left of the limits; when no piece fits
whole, one is cut to fill the rest.
"""

from __future__ import annotations

import zlib

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmafold.llm.token_ids import REMEMBERED, PieceEncoder, slices

SEQUENCE_TOKENS = 4096
#: Documents in a sequence, at most.
SEGMENTS = 64
END = 2
#: Pieces are chosen from so many tokens at a time; the rest waits for the next round.
ROUND_TOKENS = 1 << 21
_SEQUENCE_BITS = 36


def pack_pieces(lengths, losses, limits: tuple[int, int, int], last: bool):
    """Place documents of these token counts; one call packs one round.

    Returns ``(placed, rest)``: placed is a list of sequences, each a list of (document, start, length);
    rest the (document, start) that were not placed (none if ``last``).  Every sequence but the last
    ones is full in one of its limits.  ``losses`` counts the loss-bearing tokens of a document, taken
    as spread evenly over it.

    Documents are kept in classes of similar length and loss; of each class the next in order stands
    for all, so a choice compares some dozens of candidates.
    """
    import numpy as np

    tokens, segments, loss = limits
    lengths, losses = np.asarray(lengths, np.int64), np.asarray(losses, np.int64)
    placed: list[list[tuple[int, int, int]]] = []
    start = np.zeros(len(lengths), np.int64)
    share = losses / np.maximum(lengths, 1)

    def room(doc: int, free: np.ndarray) -> int:
        """Tokens of ``doc`` that the limits still take."""
        by_loss = free[2] / share[doc] if share[doc] > 0 else tokens
        return int(min(free[0], by_loss)) if free[1] >= 1 else 0

    # Whole sequences first: what a long document has beyond the last of them is packed with the others.
    whole = np.array([tokens, segments, loss], float)
    for doc in np.flatnonzero(lengths >= tokens):
        step = room(doc, whole)
        while step and lengths[doc] - start[doc] >= step:
            placed.append([(int(doc), int(start[doc]), step)])
            start[doc] += step
    left = lengths - start
    width = 16
    classes: dict[tuple[int, int], list[int]] = {}
    for doc in np.flatnonzero(left > 0)[::-1]:
        n = int(left[doc])
        size = n.bit_length() * 4 + ((n << 2) >> n.bit_length()) if n > 3 else n
        classes.setdefault((size, int(share[doc] * width)), []).append(int(doc))
    keys = list(classes)
    demand = np.zeros((len(keys), 3))
    limit = np.array([tokens, segments, loss], float)

    def measure(i: int) -> None:
        stack = classes[keys[i]]
        demand[i] = (left[stack[-1]], 1, left[stack[-1]] * share[stack[-1]]) if stack else (np.inf, np.inf, np.inf)

    for i in range(len(keys)):
        measure(i)
    waiting = int((left > 0).sum())
    total = int(left.sum())
    while waiting and (last or total >= 4 * tokens):
        free, here = limit.copy(), []
        while waiting and free[0] >= 1 and free[1] >= 1:
            fits = np.flatnonzero((demand <= free).all(axis=1))
            if len(fits):
                i = int(fits[np.argmax(((demand[fits] / limit) * (free / limit)).sum(axis=1))])
            else:
                # None fits whole: cut the one that comes nearest, so that the fewest tokens are left over.
                i = int(np.argmin(np.where(np.isfinite(demand[:, 0]), demand[:, 0], np.inf)))
            doc = classes[keys[i]][-1]
            n = min(int(left[doc]), room(doc, free))
            if n <= 0:
                break
            here.append((doc, int(start[doc]), n))
            start[doc] += n
            left[doc] -= n
            total -= n
            free -= (n, 1, n * share[doc])
            if left[doc] == 0:
                classes[keys[i]].pop()
                waiting -= 1
            measure(i)
        if not here:
            raise ValueError(f"limits {limits} hold no piece of document {doc}")
        placed.append(here)
    rest = [(int(d), int(start[d])) for d in np.flatnonzero(left > 0)]
    return placed, rest


def halve(sequence: list[tuple[int, int, int]], tokens: int) -> list[list[tuple[int, int, int]]]:
    """Cut a sequence that isn't full into sequences whose lengths are powers of two, longest first."""
    used = sum(n for _, _, n in sequence)
    if used >= tokens or used & (used - 1) == 0:
        return [sequence]
    out, queue = [], list(sequence)
    for bit in reversed(range(used.bit_length())):
        if used >> bit & 1:
            need, here = 1 << bit, []
            while need:
                doc, start, n = queue[0]
                take = min(n, need)
                here.append((doc, start, take))
                need -= take
                if take == n:
                    queue.pop(0)
                else:
                    queue[0] = (doc, start + take, n - take)
            out.append(here)
    return out


def _packer(tokenizer: str, end: int, limits: tuple[int, int, int], with_loss: bool, remembered: int):
    def pack(batches):
        import numpy as np
        import pyarrow as pa

        encoder = PieceEncoder.of(tokenizer, remembered)
        base = TaskContext.get().partitionId() << _SEQUENCE_BITS
        ids, keys, shares, parts = [], [], [], []  # of the documents of this round; parts: start of what is left
        made = 0

        def rows(placed):
            nonlocal made
            out = [[] for _ in range(7)]
            for sequence in placed:
                at = 0
                for doc, start, n in sequence:
                    crc = zlib.crc32(ids[doc][start : start + n].astype("<u4").tobytes())
                    for column, value in zip(out, (keys[doc], start + parts[doc][0], n, crc, parts[doc][1], base + made, at)):
                        column.append(value)
                    at += n
                made += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=names)

        def settle(last):
            nonlocal ids, keys, shares, parts
            lengths = np.array([len(x) for x in ids], np.int64)
            losses = np.rint(lengths * np.array(shares)).astype(np.int64) if with_loss else lengths
            placed, rest = pack_pieces(lengths, losses, limits, last)
            out = rows([part for sequence in placed for part in halve(sequence, limits[0])])
            kept = [(ids[d][s:], keys[d], shares[d], (parts[d][0] + s, parts[d][1])) for d, s in rest]
            ids, keys, shares, parts = [list(x) for x in zip(*kept)] if kept else ([], [], [], [])
            return out

        held = 0
        for part in slices(batches, 1):
            flat, starts = encoder.encode(part.column(1), end)
            loss = part.column(2).to_pylist() if with_loss else [1.0] * part.num_rows
            for i, (key, share) in enumerate(zip(part.column(0).to_pylist(), loss)):
                own = flat[starts[i] : starts[i + 1]]
                ids.append(own)
                keys.append(key)
                shares.append(min(1.0, max(0.0, share)) if share is not None else 1.0)
                parts.append((0, len(own)))
                held += len(own)
                if held >= ROUND_TOKENS:
                    yield settle(False)
                    held = sum(map(len, ids))
        if ids:
            yield settle(True)

    return pack


def pack(
    docs: DataFrame,
    tokenizer: str,
    sequence_tokens: int = SEQUENCE_TOKENS,
    segments: int = SEGMENTS,
    loss_tokens: int | None = None,
    loss_share: Column | None = None,
    end: int = END,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``loss_share`` is the share of a row's tokens that bear loss (null: all); ``remembered`` bounds the
    distinct pieces of text that a worker keeps the ids of.  Every partition packs
    its own rows as they come, without an exchange.  A sequence that isn't full, for want of rows or
    because of another limit, is cut into powers of two.  A null text counts as empty and is its end alone; rows that repeat
    are packed one by one; an empty table gives an empty result; extra columns are ignored.
    """
    limits = (sequence_tokens, segments, sequence_tokens if loss_tokens is None else loss_tokens)
    columns = [F.col("doc_id").cast("bigint"), F.col("text")] + ([loss_share.cast("double").alias("loss_share")] if loss_share is not None else [])
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select(*columns).mapInArrow(_packer(tokenizer, end, limits, loss_share is not None, remembered), schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences, every token bearing loss; null texts are an end alone."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
