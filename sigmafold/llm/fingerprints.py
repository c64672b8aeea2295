"""Document fingerprints: a homomorphic multiset hash, with DataFrame and SQL functions only.

A text is a multiset of paragraphs.  Every paragraph is hashed to a wide vector of signs; the
fingerprint is the number of paragraphs and the sum of their vectors, each lane modulo 2**16.  Sums
don't depend on order, and a paragraph is inserted or deleted by adding or subtracting its vector.
The cosine of two fingerprints estimates the cosine of the two multisets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A line break ends a paragraph; so does a blank behind punctuation, so that texts of one line have parts too.
PARAGRAPH_END = r"\n|(?<=\p{Punct}) "
_HASHES = 2
#: Two lanes in each partial sum, bits j and j + HALF of a hash: a lane counts to 2**31, more than the paragraphs a text can have.
_HALF = 31
LANES = 2 * _HALF * _HASHES
_MODULUS = 1 << 16
#: Neighbours are found in ranges of about so many rows and so many bytes of text.
RANGE_ROWS = 512
RANGE_BYTES = 1 << 22
#: Quantiles of doc_id, at most; beyond them a range is cut evenly.
QUANTILES = 8192
#: The first rows of ranges are broadcast up to so many (some 30 bytes each), and joined beyond.
BROADCAST_RANGES = 100_000
_CUT_BITS = 24


def _hashes(paragraph: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), paragraph) for k in range(_HASHES)]


def sums_of(paragraph: Column) -> list[Column]:
    """The aggregates that make a fingerprint: the count and the packed lane sums."""
    mask = F.lit((1 << _HALF) + 1)
    packed = [F.sum(F.shiftright(h, j).bitwiseAND(mask)).alias(f"s{k}_{j}") for k, h in enumerate(_hashes(paragraph)) for j in range(_HALF)]
    return [F.count(F.lit(1)).alias("n_paragraphs"), *packed]


def _signed(x: Column) -> Column:
    return F.pmod(x + F.lit(_MODULUS // 2), F.lit(_MODULUS)) - F.lit(_MODULUS // 2)


def lanes() -> Column:
    """The lane sums of +1 and -1, modulo 2**16 around zero, from the columns of ``sums_of``."""
    low = F.lit((1 << _HALF) - 1)
    parts = []
    for k in range(_HASHES):
        for j in range(_HALF):
            s = F.col(f"s{k}_{j}")
            parts += [s.bitwiseAND(low), F.shiftright(s, _HALF)]
    return F.array(*[_signed(F.lit(2) * p - F.col("n_paragraphs")).cast("int") for p in parts])


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the multiset union (sign 1) or of what is left when ``b`` is taken out of ``a`` (sign -1)."""
    return F.zip_with(a, b, lambda x, y: _signed(x + F.lit(sign) * y).cast("int"))


def render(n_paragraphs: Column, lane_sums: Column) -> Column:
    """The fingerprint as hexadecimal text: 8 digits of the count, 4 of each lane."""
    digits = F.transform(lane_sums, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(_MODULUS - 1))), 4, "0"))
    return F.lower(F.concat(F.lpad(F.hex(n_paragraphs), 8, "0"), F.array_join(digits, "")))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two lane vectors, 0 to 1."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    cosine = F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def fingerprint(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_paragraphs, lanes, fingerprint of every key; rows of one key are joined into one multiset.  Null counts as empty."""
    parts = docs.select(key, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), PARAGRAPH_END)).alias("paragraph"))
    sums = parts.groupBy(key).agg(*sums_of(F.col("paragraph"))).select(key, "n_paragraphs", lanes().alias("lanes"))
    return sums.withColumn("fingerprint", render(F.col("n_paragraphs"), F.col("lanes")))


def _quantile_of(key: Column, table: Column, n: int) -> Column:
    """How many of the ``n`` sorted values of an array are at most ``key``: a binary search."""
    step, steps = 1, []
    while step <= n:
        steps.append(step)
        step *= 2
    jumps = F.array(*[F.lit(s) for s in reversed(steps)])
    return F.aggregate(jumps, F.lit(0), lambda at, jump: F.when((at + jump <= n) & (F.try_element_at(table, at + jump) <= key), at + jump).otherwise(at))


def _range_of(key: Column, tie: Column, found: list[int], cuts: int) -> Column:
    """The range of a row, ascending with key, then descending with tie.

    ``found`` are quantiles of the key, with repeats.  Between two of them a range is cut into ``cuts``
    even parts; a key that several quantiles share is cut by its tie into as many parts as it fills.
    """
    if not found:
        return F.lit(0).cast("bigint")
    bounds = sorted(set(found))
    heavy = {b: found.count(b) * cuts for b in bounds if found.count(b) > 1}
    table = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    at = _quantile_of(key, table, len(bounds))
    low, high = F.try_element_at(table, at), F.try_element_at(table, at + 1)
    share = (tie.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    # Doubles don't overflow, and rounding keeps the order; a key that they hold exactly is spread by its tie.
    spread = F.when(F.abs(key.cast("double")) < F.lit(2.0**50), F.greatest(F.lit(0.0), F.lit(1.0) - share)).otherwise(F.lit(0.0))
    even = F.floor((key.cast("double") - low.cast("double") + spread) / (high.cast("double") - low.cast("double")) * F.lit(float(cuts)))
    even = F.least(F.lit(cuts - 1), F.greatest(F.lit(0), F.coalesce(even, F.lit(0))))
    out = at.cast("bigint") * F.lit(1 << (_CUT_BITS + 1)) + (F.lit(1 << _CUT_BITS) + even).cast("bigint")
    if heavy:
        parts = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for b, n in heavy.items() for x in (b, min(n, (1 << _CUT_BITS) - 1))]), key)
        by_tie = parts - 1 - F.least(parts - 1, F.floor(share * parts))
        # A heavy key is the lowest of its quantile: its parts lie below the others.
        out = F.when(parts.isNotNull(), at.cast("bigint") * F.lit(1 << (_CUT_BITS + 1)) + by_tie).otherwise(out)
    return out


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in ranges of doc_id, each range ended by a copy of the next one's first row: see ``edits``.

    Columns: range, last (1 for such a copy), doc_id, key, tie, text.  Rows are in descending doc_id,
    nulls last, then by a hash of their text, then by text; ranges follow each other downwards.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()
    ranges = max(1, -(-n // RANGE_ROWS), -(-size // RANGE_BYTES))
    quantiles, found = min(ranges, QUANTILES), []
    if ranges > 1:
        found = list(rows.agg(F.percentile_approx("key", [i / quantiles for i in range(quantiles + 1)], 8 * quantiles)).first()[0])
    rows = rows.withColumn("range", _range_of(F.col("key"), F.col("tie"), found, -(-ranges // quantiles)))
    first = F.struct("key", F.bitwise_not("tie").alias("not_tie"))
    tops = rows.groupBy("range").agg(F.max(first).alias("top")).select("range", "top.key", F.bitwise_not("top.not_tie").alias("tie"))
    # The first row of a range follows the last of the range above; the topmost follows the lowest.
    above = tops.select("range", F.lead("range").over(Window.orderBy("range")).alias("above"), F.min("range").over(Window.partitionBy(F.lit(1))).alias("lowest"))
    ends = tops.join(above, "range").select("range", "key", "tie", F.coalesce("above", "lowest").alias("before"))
    ends = F.broadcast(ends) if ranges <= BROADCAST_RANGES else ends
    heads = rows.join(ends, ["range", "key", "tie"]).groupBy("before", "key", "tie").agg(F.min("text").alias("text"))
    heads = heads.select(F.col("before").alias("range"), F.lit(1).alias("last"), F.lit(None).cast("bigint").alias("doc_id"), "key", "tie", "text")
    return rows.select("range", F.lit(0).alias("last"), F.col("doc_id").cast("bigint").alias("doc_id"), "key", "tie", "text").unionByName(heads)


def edits(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts move once, to their range of doc_id; neighbours, sums and comparisons then stay there.
    A null text counts as empty, a text of one row follows itself, rows that repeat a doc_id follow each
    other by a hash of their text and may lie in several ranges, rows without doc_id come last.  An empty table gives an empty result; extra columns are ignored.
    """
    line = Window.partitionBy("range").orderBy("last", F.col("key").desc(), "tie", "text")
    rows = with_next(docs).select("range", "last", "doc_id", F.row_number().over(line).alias("row"), "text", F.lead("text").over(line).alias("next_text"))
    n, half = F.length("text"), F.expr("length(text) div 2")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("range", "last", "doc_id", "row", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    variants = F.when(F.col("last") == 0, F.array("text", "edited")).otherwise(F.array("text"))
    keys = ["range", "row", "version", "last", "doc_id", "n_chars", "edited_sha256"]
    parts = rows.select("range", "row", "last", "doc_id", "n_chars", "edited_sha256", F.posexplode(variants).alias("version", "text"))
    parts = parts.select(*keys, F.explode(F.split("text", PARAGRAPH_END)).alias("paragraph"))
    sums = parts.groupBy(*keys).agg(*sums_of(F.col("paragraph"))).select(*keys, "n_paragraphs", lanes().alias("lanes"))
    # In a range the rows run: text, its edit, the next text, its edit, ..., the next range's first text.
    run = Window.partitionBy("range").orderBy("row", "version")
    ahead = [F.lead("lanes", 1).over(run).alias("edited_lanes"), F.lead("n_paragraphs", 1).over(run).alias("edited_n"), F.lead("lanes", 2).over(run).alias("next_lanes")]
    found = sums.select(*keys, "n_paragraphs", "lanes", *ahead).where("last = 0 and version = 0")
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        render(F.col("n_paragraphs"), F.col("lanes")).alias("fingerprint"),
        render(F.col("edited_n"), F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; null texts are empty ones."""
    return edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
