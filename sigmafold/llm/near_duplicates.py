"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Documents are sets of word shingles.  Each tree of the forest is a sorted trie of labels, a label being
a row of minimum hashes; documents that share a prefix of a tree are candidates.  Prefixes begin at full
length.  The weakest link that was found tells how alike the documents may be that are still missed:
prefixes are shortened until pairs of that likeness meet in some tree with the target probability, and
again while weaker links turn up.  Members of a branch are compared with its first one, which joins
copies into cores; only members of different cores of a branch are then compared in pairs.  Linked
candidates form clusters, and inside a cluster every pair is compared exactly, in blocks, without a row
for each pair.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmafold.llm.language_id import _buffers
from sigmafold.llm.quality import _units
from sigmafold.llm.token_ids import slices
from sigmafold.operators.components import connected_components
from sigmafold.runtime import materialise, numbered, release

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
TREES, DEPTH = 20, 8
#: Candidates are kept together if the share of their hashes that agree is at most so many standard deviations below the threshold.
DEVIATIONS = 5.5
#: Members of a bucket or cluster that meet in one task: two blocks of at most so many, with at most so many shingles.
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 21
_SEED = 5
_CHUNK = 1 << 15
#: Bytes of text that are hashed at once.
TEXT_BYTES = 1 << 22


def prefix_length(similarity: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """Longest prefix at which pairs of this similarity share a tree with probability ``recall``; an error if none does."""
    for length in range(depth, 0, -1):
        if 1 - (1 - similarity**length) ** trees >= recall:
            return length
    raise ValueError(f"{trees} trees can't find pairs of similarity {similarity} with probability {recall}")


def least_agreement(threshold: float) -> float:
    """Hashes (of TREES * DEPTH) in which candidates must agree."""
    n = TREES * DEPTH
    return threshold * n - DEVIATIONS * (threshold * (1 - threshold) * n) ** 0.5


def _mixed(x):
    """A bijection of 64-bit integers that spreads every bit."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _short_sets(texts):
    """``shingle_sets`` of texts that are hashed at once."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    raw, bounds = _buffers(pc.fill_null(texts.cast(pa.string()), ""))
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    _, _, code, firsts = _units(raw, (raw == 32) | ((raw >= 9) & (raw <= 13)), bounds)
    code = _mixed(code)
    words = np.diff(firsts)
    counts = np.where(words > 0, np.maximum(words - SHINGLE_WORDS + 1, 1), 0)
    n = len(code)
    padded = np.concatenate([code, np.zeros(SHINGLE_WORDS, np.uint64)])
    doc_end = np.repeat(firsts[1:], words)
    joined = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        inside = np.arange(n) + k < doc_end
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, padded[k : k + n], np.uint64(0))
    starts = np.repeat(firsts[:-1], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    shingles = _mixed(joined[starts])
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((shingles, doc))
    shingles, doc = shingles[order], doc[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    return shingles[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(counts)))])


def _long_set(text):
    """The sorted distinct shingle hashes of one text of any length, some megabytes at a time."""
    import numpy as np
    import pyarrow as pa

    raw, found, at = text.as_buffer(), [], 0
    data = np.frombuffer(raw, np.uint8)
    while at < len(data):
        size = TEXT_BYTES
        while True:
            part = data[at : at + size]
            blank = (part == 32) | ((part >= 9) & (part <= 13))
            ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1  # behind each whole word
            if at + size >= len(data) or len(ends) > SHINGLE_WORDS:
                break
            size *= 2
        last = at + size >= len(data)
        part = part if last else part[: ends[-1]]
        found.append(_short_sets(pa.array([part.tobytes().decode()]))[0])
        # The next part begins with the last words of this one, so every shingle lies in some part.
        at = len(data) if last else at + int(ends[-SHINGLE_WORDS])
        if len(found) > 8:
            found = [np.unique(np.concatenate(found))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def shingle_sets(texts):
    """Sorted distinct shingle hashes of every text, and where each document's begin (one more at the end).

    Words are runs without white space, A-Z in lower case.  A text of fewer than five words is one
    shingle; a text without words (or null) has none.  A text over TEXT_BYTES is hashed in parts.
    """
    import numpy as np
    import pyarrow.compute as pc

    if len(texts) != 1 or (pc.binary_length(texts)[0].as_py() or 0) <= TEXT_BYTES:
        return _short_sets(texts)
    found = _long_set(texts[0])
    return found, np.array([0, len(found)])


def signatures(shingles, bounds):
    """Minimum hashes (documents x TREES * DEPTH, unsigned 16-bit) of non-empty sets; zeros for empty ones."""
    import numpy as np

    factors = np.random.default_rng(_SEED).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n_docs = len(bounds) - 1
    low = np.full((n_docs, len(factors)), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        part = shingles[at : at + _CHUNK]
        first, last = np.searchsorted(bounds, [at, at + len(part) - 1], "right") - 1
        docs = np.arange(first, last + 1)
        docs = docs[bounds[docs + 1] > bounds[docs]]
        cuts = np.maximum(bounds[docs] - at, 0)
        for j, factor in enumerate(factors):
            low[docs, j] = np.minimum(low[docs, j], np.minimum.reduceat(part * factor, cuts))
    out = (_mixed(low) & np.uint64(0xFFFF)).astype(np.uint16)
    out[bounds[1:] == bounds[:-1]] = 0
    return out


def _grouped(batches, column: int):
    for part in slices(batches, column, 512, TEXT_BYTES):
        yield part, *shingle_sets(part.column(column))


def _digest(shingles) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _describe(batches):
    """Rows of documents with what the forest needs of them; the labels of all trees are end to end in ``labels``."""
    import numpy as np
    import pyarrow as pa

    for part, shingles, bounds in _grouped(batches, 2):
        labels = signatures(shingles, bounds).astype(">u2")  # sorts as bytes do
        columns = [
            part.column(0),
            part.column(1),
            pa.array([_digest(shingles[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()),
            pa.array(np.diff(bounds)),
            pa.array([row.tobytes() for row in labels], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "digest", "n_shingles", "labels"])


def _local_components(n: int, a, b):
    """Least member of the component of each of ``n`` vertices, for edges a-b."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label[a] == label[b]).all():
            break
    return label


def _agreements(batches):
    """(src, dst, agree) of rows (src, dst, labels, labels): in how many hashes the two agree."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((one == two).sum(1))], names=["src", "dst", "agree"])


def _across_cores(least: float):
    """Edges between members of a branch that are of different cores and agree.  Rows come sorted by branch and label."""
    keys = ("branch", "first", "second")

    def edges(table):
        import numpy as np
        import pyarrow as pa

        n = table.num_rows
        new = np.ones(n, bool)
        new[1:] = False
        for name in keys:
            codes = table.column(name).combine_chunks().dictionary_encode().indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        run = np.cumsum(new)
        left = np.bincount(run)[run] - (np.arange(n) - np.flatnonzero(new)[run - 1]) - 1  # members of the run behind each row
        labels = np.frombuffer(b"".join(table.column("labels").to_pylist()), np.uint16).reshape(n, -1)
        one, two, block, node = (table.column(c).to_numpy() for c in ("first", "second", "block", "node"))
        _, core = np.unique(table.column("core").to_numpy(), return_inverse=True)
        joined = np.arange(int(core.max()) + 1 if n else 0)  # cores that a link was found between count as one from then on
        out = [[], [], []]
        for offset in range(1, int(left.max()) + 1 if n else 0):
            i = np.flatnonzero(left >= offset)
            # Two different blocks meet to compare across them; each one's own pairs meet elsewhere.
            i = i[((one[i] == two[i]) | (block[i] != block[i + offset])) & (joined[core[i]] != joined[core[i + offset]])]
            for at in range(0, len(i), 1 << 14):
                k = i[at : at + (1 << 14)]
                agree = (labels[k] == labels[k + offset]).sum(1)
                k, agree = k[agree >= least], agree[agree >= least]
                if not len(k):
                    continue
                a, b = joined[core[k]], joined[core[k + offset]]
                # One link, the weakest, joins two cores.
                order = np.lexsort((agree, np.maximum(a, b), np.minimum(a, b)))
                pair = np.stack([np.minimum(a, b)[order], np.maximum(a, b)[order]])
                order = order[np.append(True, (pair[:, 1:] != pair[:, :-1]).any(0))]
                for column, values in zip(out, (node[k[order]], node[k[order] + offset], agree[order])):
                    column.append(values)
                joined = _local_components(len(joined), a, b)[joined]
        a, b, agree = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(agree)], names=["src", "dst", "agree"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            # The last branch may go on in the next batch.
            differs = np.zeros(table.num_rows, bool)
            for name in keys:
                codes = table.column(name).combine_chunks().dictionary_encode().indices.to_numpy()
                differs |= codes != codes[-1] if len(codes) else differs
            cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if cut:
                yield edges(table.slice(0, cut).combine_chunks())
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield edges(held.combine_chunks())

    return run


def _branches(nodes: DataFrame, length: int) -> DataFrame:
    """(node, branch, leader, members): every node in each branch of its trees that has two or more; the leader is its least.

    A branch is named by a hash of its tree and prefix: two of one name would only add candidates.
    """
    prefix = lambda t: F.substring(F.col("labels"), t * (2 * DEPTH) + 1, F.lit(2 * length))
    names = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, prefix(t)))
    hits = nodes.select("node", F.explode(names).alias("branch"))
    many = materialise(hits.groupBy("branch").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1"), "branches")
    # Large joins are merge joins at every size: what is candidate here grows with the input.
    found = materialise(hits.join(many.hint("merge"), "branch"), "members")
    release(many)
    return found


def _to_leaders(members: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Edges from members of branches to their leaders, where they agree: one comparison a member."""
    pairs = members.where("node <> leader").select("node", "leader").distinct()
    own = pairs.join(nodes.select("node", "labels").hint("merge"), "node")
    both = own.join(nodes.select(F.col("node").alias("leader"), F.col("labels").alias("leader_labels")).hint("merge"), "leader")
    found = both.select("node", "leader", "labels", "leader_labels").mapInArrow(_agreements, "src bigint, dst bigint, agree bigint")
    return materialise(found.where(F.col("agree") >= least), "leader-links")


def _between_cores(members: DataFrame, nodes: DataFrame, cores: DataFrame, least: float) -> DataFrame:
    """Edges between members of a branch that are of different cores, where they agree.

    A branch's largest core is compared with the rest, and the rest within itself, in pairs of blocks:
    members of the largest core are not compared with each other and go once to each block of the rest.
    """
    keys = ["branch"]
    known = cores.select(F.col("vertex").alias("node"), F.col("component").alias("core"))
    rows = materialise(members.select("node", *keys, "members").join(known.hint("merge"), "node", "left").withColumn("core", F.coalesce("core", "node")), "cores")
    sizes = rows.groupBy(*keys, "core").agg(F.count(F.lit(1)).alias("n"), F.first("members").alias("members"))
    mixed = sizes.groupBy(*keys).agg(F.max(F.struct("n", "core")).alias("top"), F.first("members").alias("members")).where("top.n < members")
    blocks = {name: F.ceil(n / F.lit(BLOCK_ROWS)).cast("int") for name, n in (("top_blocks", F.col("top.n")), ("rest_blocks", F.col("members") - F.col("top.n")))}
    mixed = materialise(mixed.select(*keys, F.col("top.core").alias("top"), *[n.alias(name) for name, n in blocks.items()]), "mixed")
    rows = rows.drop("members").join(mixed.hint("merge"), keys)
    in_top = F.col("core") == F.col("top")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.when(in_top, F.col("top_blocks")).otherwise(F.col("rest_blocks"))).cast("int"))

    def upto(n):
        return F.sequence(F.lit(0), n - 1)

    # Tasks with first < 0 hold a block of the largest core and one of the rest, the others two blocks of the rest.
    nowhere = F.array().cast("array<struct<first:int,second:int,block:int>>")
    with_top = F.when(in_top, F.transform(upto(F.col("rest_blocks")), lambda k: F.struct((-1 - F.col("block")).alias("first"), k.alias("second"), F.lit(-1).alias("block"))))
    with_top = with_top.otherwise(F.transform(upto(F.col("top_blocks")), lambda k: F.struct((-1 - k).alias("first"), F.col("block").alias("second"), F.lit(0).alias("block"))))
    in_rest = F.transform(upto(F.col("rest_blocks")), lambda k: F.struct(F.least("block", k).alias("first"), F.greatest("block", k).alias("second"), F.col("block").alias("block")))
    rows = rows.select("node", "core", *keys, F.inline(F.concat(with_top, F.when(in_top, nowhere).otherwise(in_rest))))
    signed = rows.join(nodes.select("node", "labels").hint("merge"), "node")
    tasks = [*keys, "first", "second"]
    ordered = signed.select(*tasks, "block", "core", "node", "labels").repartition(*tasks).sortWithinPartitions(*tasks, "labels", "node")
    return materialise(ordered.mapInArrow(_across_cores(least), "src bigint, dst bigint, agree bigint"), "core-links")


def candidate_clusters(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vertex, component) of nodes (node, labels) that have a candidate: the adaptive descent described above."""
    least, hashes = least_agreement(threshold), TREES * DEPTH
    shortest = prefix_length(threshold, recall)
    members = _branches(nodes, DEPTH)
    found = [_to_leaders(members, nodes, least)]
    reached = None

    def wanted() -> int:
        """The prefix at which pairs like the weakest link so far are found; without any, those at the threshold."""
        weakest = min((x for x in (links.agg(F.min("agree")).first()[0] for links in found) if x is not None), default=0)
        return max(shortest, prefix_length(max(threshold, weakest / hashes), recall))

    while reached is None or wanted() < reached:
        length = wanted()
        if length < DEPTH:
            release(members)
            members = _branches(nodes, length)
            found.append(_to_leaders(members, nodes, least))
        linked = found[0]
        for links in found[1:]:
            linked = linked.unionByName(links)
        # Nodes that agree with one leader are linked through it.  Leaders may be linked too: that only
        # means some more comparisons.
        cores = linked.groupBy(F.col("src").alias("vertex")).agg(F.min("dst").alias("component"))
        found.append(_between_cores(members, nodes, cores, least))
        reached = length
    linked = found[0]
    for links in found[1:]:
        linked = linked.unionByName(links)
    out = connected_components(linked)
    release(members, *found)
    return out


def _in_blocks(members: DataFrame, n_blocks) -> DataFrame:
    """Every member once for each pair of blocks that its block is part of; a group of one block as it is."""
    rows = members.withColumn("n_blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("n_blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int"))))
    return rows.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).drop("other")


def _compare(threshold: float):
    """Exact comparison of all pairs that meet in one task: links counted in documents, and star edges."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        across = table.column("first")[0].as_py() != table.column("second")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        n, sizes = len(sets), np.array([len(s) for s in sets])
        flat, row = np.concatenate(sets), np.repeat(np.arange(n), sizes)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        change = np.ones(len(flat), bool)
        change[1:] = flat[1:] != flat[:-1]
        column = np.cumsum(change) - 1
        common = np.bincount(column)[column] > 1  # a shingle of one set alone is in no intersection
        _, column = np.unique(column[common], return_inverse=True)
        row = row[common]
        shared = np.zeros((n, n), np.float32)
        width = max(1, min(1 << 14, (1 << 24) // n))
        starts = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + 1, width))
        for k, at in enumerate(starts):
            to = starts[k + 1] if k + 1 < len(starts) else len(column)
            x = np.zeros((n, width), np.float32)
            x[row[at:to], column[at:to] - k * width] = 1
            shared += x @ x.T
        union = (sizes[:, None] + sizes[None, :]).astype(np.float64) - shared
        linked = shared >= threshold * union * (1 - 1e-12)  # a pair at the threshold itself is linked
        np.fill_diagonal(linked, False)
        if across:
            linked &= block[:, None] != block[None, :]
        label = _local_components(n, *np.nonzero(np.triu(linked)))
        links = linked @ copies.astype(np.float64)
        return pa.table({"node": node, "links": links.astype(np.int64), "root": node[label], "many": np.full(n, table.column("n_blocks")[0].as_py() > 1)})

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, set_id, n_links.

    Documents are linked if the Jaccard similarity of their shingle sets is at least ``threshold``;
    ``n_links`` counts the other documents that one is linked to.  ``set_id`` is the least doc_id with
    the same set, ``class_id`` the least doc_id of the connected component.  Documents without words
    are linked to nothing.  A null doc_id has null ids where its class has no other; rows that
    repeat a doc_id or are repeated whole count one by one; an empty table gives an empty result; extra
    columns are ignored.  A threshold that the forest can't serve with this recall raises.
    """
    keyed, row = numbered(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "texts")
    return _classes(keyed, row, threshold, recall).drop("uid", "group")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of every class the row with the largest doc_id."""
    keyed, row = numbered(docs, "rows")
    rows = materialise(_classes(keyed, row, threshold, recall).where("group is not null").select("uid", "group", "doc_id"), "grouped")
    top = rows.groupBy("group").agg(F.max(F.struct("doc_id", "uid")).alias("top")).select("group", F.col("top.uid").alias("top_uid"))
    gone = rows.join(top, "group").where("uid <> top_uid").select(F.col("uid").alias(row))
    return keyed.join(gone.hint("merge"), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _classes(keyed: DataFrame, row: str, threshold: float, recall: float) -> DataFrame:
    """The columns of ``join``, uid, and group: a key of classes of two or more rows.  ``keyed`` is a written table with a number in ``row``."""
    source = keyed.select(F.col(row).alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = materialise(source.mapInArrow(_describe, "uid bigint, doc_id bigint, digest binary, n_shingles bigint, labels binary"), "signatures")
    sets = rows.where("digest is not null").groupBy("digest")
    sets = materialise(sets.agg(F.min("uid").alias("node"), F.min("doc_id").alias("set_id"), F.count(F.lit(1)).alias("copies")), "sets")
    nodes = materialise(rows.join(sets.select(F.col("node").alias("uid"), "node", "copies").hint("merge"), "uid").select("node", "copies", "n_shingles", "labels"), "nodes")
    clusters = candidate_clusters(nodes, threshold, recall)

    # Clusters: their members' shingles are made again from the texts and compared exactly.
    chosen = nodes.join(clusters.withColumnRenamed("vertex", "node").withColumnRenamed("component", "cluster"), "node")
    chosen = materialise(chosen.select("node", "cluster", "copies", "n_shingles"), "clusters")
    totals = chosen.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).alias("n_blocks"))
    # One text of each set, by its row's number.
    texts = source.select(F.col("uid").alias("node"), "text").join(chosen.drop("n_shingles").join(totals, "cluster").hint("merge"), "node")

    def shingled(batches):
        import pyarrow as pa

        names = ["node", "cluster", "copies", "n_blocks", "shingles"]
        for part, shingles, bounds in _grouped(batches, 4):
            sets_here = [shingles[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.array(sets_here, pa.binary())], names=names)

    held = texts.select("node", "cluster", "copies", "n_blocks", "text").mapInArrow(shingled, "node bigint, cluster bigint, copies bigint, n_blocks bigint, shingles binary")
    pairs = _in_blocks(held, F.col("n_blocks"))
    compared = pairs.groupBy("cluster", "first", "second").applyInArrow(_compare(threshold), "node bigint, links bigint, root bigint, many boolean")
    compared = materialise(compared, "compared")
    linked = materialise(compared.groupBy("node").agg(F.sum("links").alias("links")).where("links > 0"), "linked")
    # A cluster that met in one task has its components already; those of others are joined over their blocks.
    classes = compared.where("not many").select(F.col("node").alias("vertex"), F.col("root").alias("component"))
    spread = compared.where("many and node <> root")
    if not spread.isEmpty():
        classes = classes.unionByName(connected_components(spread, "node", "root"))

    known = linked.join(classes.withColumnRenamed("vertex", "node"), "node").join(sets.select("node", "set_id", "digest", "copies"), "node")
    least = known.groupBy("component").agg(F.min("set_id").alias("class_id"))
    known = materialise(known.join(least, "component").select("digest", "component", "class_id", "links"), "classes")
    release(nodes, chosen, compared, linked)
    # Copies of one set may be a large part of all rows: both joins are between plain exchanges.
    out = rows.select("uid", "doc_id", "digest").join(sets.select("digest", "node", "set_id", "copies"), "digest", "left").join(known, "digest", "left")
    return out.select(
        "uid",
        F.coalesce("component", F.when(F.col("copies") > 1, F.col("node"))).alias("group"),
        "doc_id",
        F.coalesce("class_id", "set_id", "doc_id").alias("class_id"),
        F.coalesce("set_id", "doc_id").alias("set_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of all documents; texts without words are linked to nothing."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by shared shingles of all pairs of sets, and reachability.
ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct([array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)]) END AS sh FROM w),
k AS MATERIALIZED (SELECT doc_id, sh, md5(array_to_string(list_sort(sh), chr(10))) AS key, len(sh) AS n FROM s),
sets AS MATERIALIZED (SELECT key, any_value(sh) AS sh, any_value(n) AS n, count(*) AS copies, min(doc_id) AS set_id FROM k WHERE n > 0 GROUP BY key),
e AS MATERIALIZED (SELECT key, unnest(sh) AS x FROM sets),
c AS (SELECT a.key AS a, b.key AS b, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.key <> b.key GROUP BY 1, 2),
l AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN sets x ON x.key = c.a JOIN sets y ON y.key = c.b WHERE c.common >= 0.8 * (x.n + y.n - c.common)),
r AS (SELECT DISTINCT a AS v, a AS u FROM l UNION SELECT r.v, l.b FROM r JOIN l ON r.u = l.a),
comp AS (SELECT v, min(sets.set_id) AS class_id FROM r JOIN sets ON sets.key = r.u GROUP BY v),
links AS (SELECT l.a, sum(sets.copies) AS links FROM l JOIN sets ON sets.key = l.b GROUP BY 1)
SELECT doc_id, coalesce(class_id, set_id, doc_id) AS class_id, coalesce(set_id, doc_id) AS set_id, (coalesce(links, 0) + coalesce(copies, 1) - 1)::BIGINT AS n_links
FROM k LEFT JOIN sets USING (key) LEFT JOIN comp ON comp.v = k.key LEFT JOIN links ON links.a = k.key
"""
