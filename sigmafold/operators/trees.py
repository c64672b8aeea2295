"""Summary trees of chunked content: leaves are chunk signatures, adjacent nodes concatenate upwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmafold.functions.fields import PrimeField
from sigmafold.operators import codecs
from sigmafold.operators.laws import check_base
from sigmafold.runtime import materialise


def text_chunks(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, idx, chunk: pieces of ``size`` characters, the last may be shorter; an empty text has none."""
    n = F.ceil(F.length(text) / F.lit(float(size))).cast("int")
    idx = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    cut = df.select(F.col(key), F.col(text).alias("__text"), idx.alias("idx"))
    return cut.select(key, F.col("idx").cast("bigint"), F.substring(F.col("__text"), F.col("idx") * size + 1, F.lit(size)).alias("chunk"))


def leaves(chunks: DataFrame, key: str, e: Column) -> DataFrame:
    return chunks.select(key, F.lit(0).alias("level"), "idx", e.alias("state"), F.lit(1).cast("bigint").alias("n"))


def parents(nodes: DataFrame, key: str, field: PrimeField, base: int) -> DataFrame:
    """The next level: left * base ** len(right) + right; an odd node goes up as it is."""
    left, right = (F.max(F.when(F.col("idx") % 2 == side, F.struct("state", "n"))) for side in (0, 1))
    pairs = nodes.groupBy(key, F.expr("idx div 2").alias("idx"), (F.col("level") + 1).alias("level")).agg(left.alias("l"), right.alias("r"))
    state = F.when(F.col("r").isNull(), F.col("l.state")).otherwise(
        F.pmod(field.c_mul(F.col("l.state"), field.c_power(check_base(base), F.col("r.n"))) + F.col("r.state"), F.lit(field.p))
    )
    return pairs.select(key, "level", "idx", state.alias("state"), (F.col("l.n") + F.coalesce(F.col("r.n"), F.lit(0))).alias("n"))


#: Levels that are made in one pass.
STEP = 8


def build(leaf_nodes: DataFrame, key: str, field: PrimeField, base: int) -> DataFrame:
    """All levels, STEP of them in a pass; each pass is written, so the plan doesn't grow.

    A node is the sum of the states below it, each times base ** (length behind it).  Within a block of
    2 ** STEP nodes that is base ** (length up to the node's end) times a sum of scaled states, whatever
    the level.
    """
    columns = [key, "level", "idx", "state", "n"]
    current = materialise(leaf_nodes.select(*columns), "tree")
    out, most, at = current, (current.agg(F.max("idx")).first()[0] or 0) + 1, 0
    while most > 1:
        jumps = min(STEP, (most - 1).bit_length())
        ahead = F.sum("n").over(Window.partitionBy(key, F.shiftright("idx", jumps)).orderBy("idx"))
        rows = current.withColumn("__end", ahead)
        scaled = field.c_mul(F.col("state"), field.c_power(check_base(base), -F.col("__end")))
        rows = rows.select(key, "idx", "n", "__end", scaled.alias("__scaled"), F.explode(F.sequence(F.lit(1), F.lit(jumps))).alias("__up"))
        sums = rows.groupBy(key, (F.col("__up") + at).alias("level"), F.expr("shiftright(idx, __up)").alias("idx")).agg(
            F.sum("__scaled").alias("__sum"), F.max("__end").alias("__end"), F.sum("n").alias("n")
        )
        state = field.c_mul(F.pmod("__sum", F.lit(field.p)), field.c_power(base, F.col("__end")))
        fresh = materialise(sums.select(key, "level", "idx", state.alias("state"), "n"), "tree")
        out, at, most = out.unionByName(fresh), at + jumps, -(-most >> jumps)
        current = fresh.where(F.col("level") == at)
    return out


def roots(nodes: DataFrame, key: str) -> DataFrame:
    """key, state, n of the root: the topmost node."""
    return nodes.groupBy(key).agg(F.max_by(F.struct("state", "n"), "level").alias("top")).select(key, "top.state", "top.n")


def edit(nodes: DataFrame, changed: DataFrame, key: str, field: PrimeField, base: int) -> DataFrame:
    """All levels after some leaves (key, idx, state) got new states: only their ancestors are computed again."""
    top = nodes.agg(F.max("level")).first()[0] or 0
    fresh = materialise(changed.select(key, F.lit(0).alias("level"), "idx", "state", F.lit(1).cast("bigint").alias("n")), "edit")
    out = fresh
    for level in range(top):
        here = nodes.where(F.col("level") == level)
        families = fresh.select(key, F.expr("idx div 2").alias("up")).distinct()
        near = here.withColumn("up", F.expr("idx div 2")).join(families, [key, "up"], "left_semi").drop("up")
        current = near.join(fresh.select(key, "idx"), [key, "idx"], "left_anti").unionByName(fresh)
        fresh = materialise(parents(current, key, field, base), "edit")
        out = out.unionByName(fresh)
    return nodes.join(out.select(key, "level", "idx"), [key, "level", "idx"], "left_anti").unionByName(out)


# --- files ------------------------------------------------------------------------------------------------


def export(chunks: DataFrame, key: str, data: str = "chunk") -> DataFrame:
    """key, content: the pieces of each file in order, end to end.  A file is one value, so it must fit one."""
    parts = F.array_sort(F.collect_list(F.struct("idx", F.hex(F.col(data).cast("binary")).alias("bytes"))))
    return chunks.groupBy(key).agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["bytes"]), "")).alias("content"))


def replace_range(content: Column, start: Column, stop: Column, new: Column) -> Column:
    """The file with bytes ``start`` to ``stop`` replaced; a range outside the file raises.  A change of length moves every later chunk, so the tree is built again."""
    size = F.octet_length(content)
    bad = (start < 0) | (start > stop) | (stop > size)
    out = F.concat(F.substring(content, F.lit(1), start.cast("int")), new, F.substring(content, (stop + 1).cast("int"), (size - stop).cast("int")))
    return F.when(bad, F.raise_error(F.lit("range outside the file"))).otherwise(out)


def insert(content: Column, at: Column, new: Column) -> Column:
    return replace_range(content, at, at, new)


def remove(content: Column, start: Column, stop: Column) -> Column:
    return replace_range(content, start, stop, F.unhex(F.lit("")))


def append(content: Column, new: Column) -> Column:
    return insert(content, F.octet_length(content), new)


def truncate(content: Column, size: Column) -> Column:
    return remove(content, size, F.octet_length(content))


def binary_chunks(df: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """key, idx, chunk: pieces of ``size`` bytes, the last may be shorter."""
    n = F.ceil(F.octet_length(content) / F.lit(float(size))).cast("int")
    cut = df.select(F.col(key), F.col(content).alias("__content"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("idx"))
    return cut.select(key, F.col("idx").cast("bigint"), F.substring(F.col("__content"), F.col("idx") * size + 1, F.lit(size)).alias("chunk"))


def chunk_frame(chunk: Column) -> Column:
    """The bytes that a leaf signs: a fixed head, the length and the piece."""
    return F.concat(codecs.raw(b"MFFC" + (1).to_bytes(2, "little")), codecs.frame(chunk))


def verify_checkpoint(decoded: DataFrame, key: str, rebuilt: DataFrame) -> DataFrame:
    """``decoded`` (key, root ...) where the root is that of the tree built again (key, root_again); another root raises."""
    joined = decoded.join(rebuilt, key)
    return joined.withColumn("root", F.when(F.col("root") == F.col("root_again"), F.col("root")).otherwise(F.raise_error(F.lit("root mismatch")))).drop("root_again")
