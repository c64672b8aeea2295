"""Mixing sources to target weights by temperature, with DataFrame and SQL functions only.

The weight of a source is its token share to the power ``exponent``, normalised.  The exponent is
bisected until the weights meet a target entropy or a repetition limit.  The weights are realised
from keyed permutations of every source: whole passes, then the head of one more, dealt into blocks
that each hold the target mixture.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmafold.runtime import materialise, numbered

#: Exponents probed in one pass over the sources: PROBES + 1 equal parts, five bisections at once.
PROBES = 31
PASSES = 10
BLOCK_TOKENS = 65_536
SEED = 20_240_501
#: Passes over the source that is seen most, in the query.
MAX_REPEATS = 2.0


@dataclass(frozen=True)
class Target:
    """What the weights shall meet: ``max_repeats`` passes over any source, or ``entropy`` in nats; ``budget`` in tokens.

    Without a budget every document is used at least once, so the largest pass count follows from the
    weights alone.  With neither limit the exponent is 1, that is, the shares as they are.
    """

    max_repeats: float | None = None
    entropy: float | None = None
    budget: int | None = None


def word_cost(text: Column) -> Column:
    """Words of a text and one end; a null or empty text costs the end alone."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)) + 1).cast("bigint")


def _metrics(exponent: float, target: Target) -> Column:
    """Entropy, or most passes over a source, at this exponent: an aggregate over (ln_share, tokens)."""
    power = F.exp(F.lit(exponent) * F.col("ln_share"))
    if target.max_repeats is None:
        total = F.sum(power)
        return F.log(total) - F.lit(exponent) * F.sum(power * F.col("ln_share")) / total
    per_token = F.exp(F.lit(exponent - 1.0) * F.col("ln_share"))
    if target.budget is None:
        return F.max(per_token) / F.min(per_token)
    return F.max(per_token) / F.sum(power) * F.lit(float(target.budget)) / F.sum("tokens")


def bisect_exponent(shares: DataFrame, target: Target) -> float:
    """Both metrics fall as the exponent rises from 0 to 1.

    A repetition limit takes the smallest exponent that keeps it, an entropy the largest that reaches
    it; if no exponent does, 1 and 0.  Each pass is one aggregate over the sources, however many.
    """
    if target.max_repeats is None and target.entropy is None:
        return 1.0
    limit = target.max_repeats if target.max_repeats is not None else target.entropy
    low, high = 0.0, 1.0
    for step in range(PASSES):
        points = [low + (high - low) * i / (PROBES + 1) for i in range(PROBES + 2)]
        row = shares.agg(*[_metrics(p, target).alias(f"m{i}") for i, p in enumerate(points)]).first()
        values = list(row)
        if step == 0:
            if values[0] is None:
                return 1.0
            if values[0] <= limit:
                return 0.0
            if values[-1] > limit:
                return 1.0
        k = next(i for i, v in enumerate(values) if v <= limit or i == PROBES + 1)
        low, high = points[max(0, k - 1)], points[k]
    return high if target.max_repeats is not None else low


def weigh(costs: DataFrame, target: Target) -> DataFrame:
    """One row per source: src, tokens, n_rows, weight, quota (tokens to place), passes, rest."""
    sums = materialise(costs.groupBy("src").agg(F.sum("cost").alias("tokens"), F.count(F.lit(1)).alias("n_rows")), "sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.withColumn("ln_share", F.log(F.col("tokens") / F.lit(float(max(total, 1)))))
    exponent = bisect_exponent(shares, target)
    powers = shares.withColumn("power", F.exp(F.lit(exponent) * F.col("ln_share")))
    norm, cover = powers.agg(F.sum("power"), F.max(F.col("tokens") / F.col("power"))).first()
    budget = F.lit(float(target.budget)) if target.budget is not None else F.lit(norm or 1.0) * F.lit(cover or 0.0)
    weight = F.col("power") / F.lit(norm or 1.0)
    quota = F.floor(weight * budget + F.lit(1e-6))
    return (
        powers.select("src", "tokens", "n_rows", weight.alias("weight"), quota.alias("quota"), budget.alias("budget"))
        .withColumn("passes", F.expr("quota div tokens"))
        .withColumn("rest", F.expr("quota - (quota div tokens) * tokens"))
    )


def _draw(*parts: Column | str) -> Column:
    """48 bits that depend on the parts alone, alike on every engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12), 16, 10).cast("bigint")


def place(costs: DataFrame, target: Target, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """One row per copy that the mixture uses: the columns of ``costs`` and pass_no, weight, block, slot.

    ``costs`` has doc_id, src, cost (1 or more), tie (text that tells rows of one doc_id apart) and uid,
    a key of its rows.  The running totals of a
    source are taken over about sqrt(rows) parts and then inside each, so no task sees all of a hot source.
    """
    sources = weigh(costs, target)
    copies = costs.join(sources, "src").withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes"))))
    copies = copies.withColumn("draw", _draw(F.lit(str(seed)), "pass_no", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "tie"))
    parts = F.ceil(F.sqrt(F.col("n_rows").cast("double")))
    copies = copies.withColumn("part", F.floor(F.col("draw") / F.lit(float(1 << 48)) * parts))
    keys = ["src", "pass_no", "part"]
    before = Window.partitionBy("src", "pass_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = copies.groupBy(*keys).agg(F.sum("cost").alias("part_cost")).withColumn("base", F.coalesce(F.sum("part_cost").over(before), F.lit(0)))
    inside = Window.partitionBy(*keys).orderBy("draw", "doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1)
    local = copies.withColumn("ahead", F.coalesce(F.sum("cost").over(inside), F.lit(0)))
    placed = local.join(bases.select(*keys, "base"), keys).withColumn("ahead", F.col("base") + F.col("ahead"))
    placed = placed.where((F.col("pass_no") < F.col("passes")) | (F.col("ahead") + F.col("cost") <= F.col("rest")))
    blocks = F.greatest(F.lit(1.0), F.ceil(F.col("budget") / F.lit(float(block_tokens))))
    at = (F.col("pass_no") * F.col("tokens") + F.col("ahead")).cast("double") / F.col("quota").cast("double")
    placed = placed.withColumn("block", F.floor(at * blocks))
    order = Window.partitionBy("block").orderBy(_draw(F.lit(str(seed)), F.lit("slot"), "pass_no", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "tie"), "pass_no", "doc_id", "uid")
    return placed.withColumn("slot", (F.row_number().over(order) - 1).cast("bigint")).select(*costs.columns, "pass_no", "weight", "block", "slot")


def costed(docs: DataFrame, uid: Column) -> DataFrame:
    """doc_id, source, src, cost, tie, uid of every row; a null source counts as the source without a name.

    The tie is a digest of the text, so that rows without a doc_id, or of the same, are dealt apart.
    """
    tie = F.coalesce(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), F.lit(""))
    return docs.select("doc_id", "source", F.coalesce("source", F.lit("")).alias("src"), word_cost(F.col("text")).alias("cost"), tie.alias("tie"), uid.alias("uid"))


def mix(docs: DataFrame, target: Target, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """The mixture as doc_id, source, pass_no, n_tokens, weight, block, slot.

    Rows that repeat are placed one by one.  Null texts count as empty and cost one token; null
    sources form one source.  An empty table gives an empty mixture; extra columns are ignored.
    """
    costs = materialise(costed(docs, F.monotonically_increasing_id()), "costs")
    return place(costs, target, block_tokens, seed).select("doc_id", "source", "pass_no", F.col("cost").alias("n_tokens"), F.round("weight", 6).alias("weight"), "block", "slot")


def mix_rows(docs: DataFrame, target: Target, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, one per placed copy, with their own columns, in the order of block and slot.

    A block lies in one partition and partitions follow one another, so what reads the rows as they
    come sees block after block of the target mixture.
    """
    keyed, row = numbered(docs, "rows")
    costs = materialise(costed(keyed, F.col(row)), "costs")
    placed = place(costs, target, block_tokens, seed).select(F.col("uid").alias(row), "block", "slot")
    copies = keyed.alias("docs").join(placed.alias("placed"), row).select("docs.*", F.col("placed.block").alias(f"{row}_block"), F.col("placed.slot").alias(f"{row}_slot"))
    copies = copies.repartitionByRange(f"{row}_block").sortWithinPartitions(f"{row}_block", f"{row}_slot")
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source with at most MAX_REPEATS passes; null sources are one source, null texts cost one token."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), Target(max_repeats=MAX_REPEATS))


def _sql_draw(*parts: str) -> str:
    return f"CAST('0x' || substr(sha256(concat_ws(':', {', '.join(parts)})), 1, 12) AS BIGINT)"


#: Without a budget the limit has a closed form: (largest share / smallest share) ** (1 - exponent) = MAX_REPEATS.
ORACLE = f"""
WITH costs AS (
  SELECT doc_id, source, coalesce(source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) + 1 AS cost, coalesce(substr(md5(text), 1, 8), '') AS tie FROM documents),
sums AS (SELECT src, sum(cost)::BIGINT AS tokens, count(*) AS n_rows FROM costs GROUP BY src),
spread AS (SELECT ln(max(tokens) / min(tokens)) AS ratio, sum(tokens) AS total FROM sums),
fit AS (SELECT CASE WHEN ratio <= ln({MAX_REPEATS}) THEN 0 ELSE 1 - ln({MAX_REPEATS}) / ratio END AS exponent, total FROM spread),
powers AS (SELECT sums.*, pow(tokens / total, exponent) AS power FROM sums, fit),
norm AS (SELECT sum(power) AS z, max(tokens / power) AS cover FROM powers),
plan AS (SELECT src, tokens, n_rows, power / z AS weight, z * cover AS budget,
         floor(power * cover + 1e-6)::BIGINT AS quota FROM powers, norm),
copies AS (SELECT c.*, p.* EXCLUDE (src), unnest(range(0, quota // tokens + 1)) AS pass_no FROM costs c JOIN plan p ON c.src = p.src),
drawn AS (SELECT *, {_sql_draw(f"'{SEED}'", "pass_no", "coalesce(doc_id::VARCHAR, '')", "tie")} AS draw FROM copies),
run AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY src, pass_no ORDER BY draw, doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM drawn),
placed AS (SELECT *, floor((pass_no * tokens + ahead)::DOUBLE / quota::DOUBLE * greatest(1.0, ceil(budget / {BLOCK_TOKENS})))::BIGINT AS block
        FROM run WHERE pass_no < quota // tokens OR ahead + cost <= quota - (quota // tokens) * tokens)
SELECT doc_id, source, pass_no, cost AS n_tokens, round(weight, 6) AS weight, block,
       row_number() OVER (PARTITION BY block ORDER BY {_sql_draw(f"'{SEED}'", "'slot'", "pass_no", "coalesce(doc_id::VARCHAR, '')", "tie")}, pass_no, doc_id) - 1 AS slot
FROM placed
"""
