"""Quality classifier: histogram gradient-boosted trees over document statistics.

All trees are complete and lie in flat arrays, so a batch of documents walks them level by level in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmafold.llm.language_id import _buffers, _schema_with, free_name, held_out
from sigmafold.llm.token_ids import slices

THRESHOLD = 0.3
#: Labelled documents that training reads, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS = 80, 4, 64, 0.15, 20
#: Characters whose shares are statistics of their own.
MARKS = "!#$%&*|.,;:?-_/\\<>{}[]()=+@\"'"
#: Documents are taken in groups of about so many bytes.
GROUP_BYTES = 4 << 20
#: Bytes that are hashed or counted at once.
_WINDOW = 1 << 18


def _ratio(a, b):
    import numpy as np

    return a / np.maximum(b, 1)


def _per_doc(values, cuts, n_docs: int):
    """Sums of consecutive values by document: ``cuts`` has the first place of each and one more."""
    import numpy as np

    out = np.zeros(n_docs)
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, cuts[some], dtype=np.float64)
    return out


def _byte_counts(raw, bounds):
    """How often each document has each of the 256 bytes."""
    import numpy as np

    out = np.zeros((len(bounds) - 1, 256), np.int64)
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        for at in range(a, b, _WINDOW):
            out[k] += np.bincount(raw[at : min(b, at + _WINDOW)], minlength=256)
    return out


_powers = None


def _POWERS():
    """Powers of the base of the hash of runs modulo 2**64, and of its inverse, as far as a window reaches."""
    global _powers
    if _powers is None:
        import numpy as np

        base = 0x9E3779B97F4A7C15
        _powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_WINDOW, p, np.uint64)])) for p in (base, pow(base, -1, 1 << 64))]
    return _powers


def _units(raw, breaks, bounds):
    """Runs between breaks: start, length, hash, and the first run of each document (and one more).

    Hashes are made some runs at a time, so a long text needs little more than its own bytes; a run that
    is longer than a window has a hash of another kind.
    """
    import hashlib

    import numpy as np

    inside = ~breaks
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True  # no run crosses a document's end
    opens = inside & np.concatenate([[True], breaks[:-1]]) | inside & edge[:-1]
    start = np.flatnonzero(opens)
    stop = np.flatnonzero(inside & (np.concatenate([breaks[1:], [True]]) | edge[1:])) + 1
    code, at, powers = np.zeros(len(start), np.uint64), 0, _POWERS()
    while at < len(start):
        first = int(start[at])
        to = int(np.searchsorted(stop, first + _WINDOW, "right"))
        if to == at:
            code[at] = int.from_bytes(hashlib.blake2b(raw[first : stop[at]].tobytes(), digest_size=8).digest(), "little")
            at += 1
            continue
        # A polynomial hash of each run, from running sums modulo 2**64, moved back to the run's own start.
        part = raw[first : int(stop[to - 1])].astype(np.uint64)
        part += np.uint64(1)
        part *= powers[0][: len(part)]
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
        code[at:to] = (running[stop[at:to] - first] - running[start[at:to] - first]) * powers[1][start[at:to] - first]
        at = to
    return start, stop - start, code, np.searchsorted(start, bounds)


def _distinct_share(code, firsts):
    """Share of distinct codes among those of each document."""
    import numpy as np

    n = np.diff(firsts)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((code, doc))
    d, c = doc[order], code[order]
    new = np.ones(len(c), bool)
    new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
    return _ratio(np.bincount(d[new], minlength=len(n)).astype(float), n)


def _group_statistics(raw, bounds):
    import numpy as np

    n_docs, size = len(bounds) - 1, np.diff(bounds)

    counts = _byte_counts(raw, bounds)

    def share(chosen):
        return _ratio(counts[:, chosen].sum(1), size)

    code_points = size - counts[:, 0x80:0xC0].sum(1)
    newline, blank = raw == 10, (raw == 32) | ((raw >= 9) & (raw <= 13))
    upper, lower, digits = list(range(65, 91)), list(range(97, 123)), list(range(48, 58))
    columns = [np.log1p(code_points), share(upper + lower), share(upper), share(digits), share(list(range(128, 256))), share([10]), share([32, 9, 10, 11, 12, 13])]
    columns += [share([ord(mark)]) for mark in MARKS]
    start, length, code, firsts = _units(raw, blank, bounds)
    words = np.diff(firsts)
    columns += [np.log1p(words), _ratio(_per_doc(length, firsts, n_docs), words), np.sqrt(_ratio(_per_doc(length.astype(float) ** 2, firsts, n_docs), words))]
    again = np.zeros(len(code), bool)
    again[1:] = code[1:] == code[:-1]
    again[firsts[:-1][words > 0]] = False
    columns += [_ratio(_per_doc(again, firsts, n_docs), words), _distinct_share(code, firsts)]
    last = raw[start + length - 1] if len(start) else np.zeros(0, np.uint8)
    odd = ~(((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128) | (last == 46) | (last == 44))
    columns += [_ratio(_per_doc(odd, firsts, n_docs), words), _ratio(_per_doc(length == 1, firsts, n_docs), words)]
    if len(start):
        capital = (raw[start] >= 65) & (raw[start] <= 90)
    else:
        capital = np.zeros(0, bool)
    columns.append(_ratio(_per_doc(capital, firsts, n_docs), words))
    _, line_length, line_code, line_firsts = _units(raw, newline, bounds)
    lines = np.diff(line_firsts)
    columns += [np.log1p(lines), np.log1p(_ratio(_per_doc(line_length, line_firsts, n_docs), lines)), _distinct_share(line_code, line_firsts)]
    return np.stack(columns, 1)


def statistics(texts):
    """Statistics (documents x features) of an Arrow string array; null counts as empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    raw, bounds = _buffers(pc.fill_null(texts.cast(pa.string()), ""))
    out, at = [], 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + GROUP_BYTES, "right")) - 1)
        out.append(_group_statistics(raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]))
        at = to
    return np.concatenate(out) if out else np.zeros((0, 0))


@dataclass
class Trees:
    """Complete trees of equal depth in flat arrays, node i above nodes 2i+1 and 2i+2."""

    base: float
    feature: object  # trees x inner nodes
    bound: object  # trees x inner nodes: a larger value goes right
    leaf: object  # trees x leaves

    def score(self, x):
        """Chance of label 1 of every row."""
        import numpy as np

        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def boost(x, y) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins."""
    import numpy as np

    n, width = x.shape if len(x) else (0, 1)
    rate = (np.sum(y) + 1) / (n + 2)
    base = float(np.log(rate / (1 - rate)))
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    feature, bound, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    if n == 0 or len(set(y.tolist())) < 2:
        return Trees(base, feature[:0], bound[:0], leaf[:0])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    total = np.full(n, base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, here = (1 << depth) - 1, 1 << depth
            local = node - first
            best, chosen, cut = np.zeros(here), np.zeros(here, np.int64), np.full(here, np.inf)
            for f in range(width):
                if not len(edges[f]):
                    continue
                place = local * BINS + bins[:, f]
                sums = [np.bincount(place, v, here * BINS).reshape(here, BINS).cumsum(1) for v in (g, h, np.ones(n))]
                (gl, hl, nl), (ga, ha, na) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                gain[(nl < LEAST_ROWS) | (na - nl < LEAST_ROWS)] = 0
                gain = gain[:, : len(edges[f])]
                k = gain.argmax(1)
                value = gain[np.arange(here), k]
                better = value > best + 1e-9
                best[better], chosen[better], cut[better] = value[better], f, edges[f][k[better]]
            feature[t, first : first + here], bound[t, first : first + here] = chosen, cut
            node = 2 * node + 1 + (x[np.arange(n), chosen[local]] > cut[local])
        at = node - inner
        leaf[t] = -RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + 1)
        total += leaf[t][at]
    return Trees(base, feature, bound, leaf)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Learn ``labels.quality`` (doc_id, quality) from the texts of ``docs``.

    At most ``sample`` labelled rows are used, those with the lowest hash of doc_id; their ids are
    sent to the executors, which return statistics alone.  Labels without a text, an id or a value
    teach nothing; a label given twice counts twice, and so does one whose doc_id several rows have.
    """
    import numpy as np

    rows = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("double").alias("quality"))
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    n = rows.count()
    chosen = rows.where(F.col("draw") * F.lit(n) <= F.lit(1.05 * sample * (1 << 30))) if n > sample else rows
    wanted = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("draw", "quality", "text")

    def measure(batches):
        import pyarrow as pa

        for batch in slices(batches, 2, 10_000, GROUP_BYTES):
            x = statistics(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["draw", "quality", "x"])

    found = wanted.mapInArrow(measure, "draw bigint, quality double, x array<double>").collect()
    found = sorted(found, key=lambda r: (r.draw, r.quality, r.x))[:sample]
    x = np.array([r.x for r in found]) if found else np.zeros((0, 1))
    return boost(x, np.array([r.quality for r in found]))


def score(docs: DataFrame, trees: Trees, keep: list[Column] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` of every row, and score (0 to 1) and predicted (1 from ``threshold`` on).

    A null text counts as empty; empty texts get a score too.  An empty table gives an empty result;
    rows that repeat are scored alike; columns not named in ``keep`` are not read.
    """
    text = free_name(docs, "__text")
    kept = docs.select(*keep, F.col("text").alias(text))
    columns = kept.drop(text)
    names_kept = columns.columns

    def judge(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, len(names_kept), 10_000, GROUP_BYTES):
            value = trees.score(statistics(batch.column(batch.num_columns - 1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value), pa.array((value >= threshold).astype("int32"))], names=[*names_kept, "score", "predicted"])

    return kept.mapInArrow(judge, _schema_with(columns, "score double, predicted int"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from labels that are not held out; empty and null texts get a score too."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out(F.col("doc_id"), 5, 0)
    trees = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~out))
    return score(docs, trees, [F.col("doc_id"), out.alias("held_out")])
