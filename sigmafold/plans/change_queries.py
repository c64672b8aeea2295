"""Queries on tables under change: keys, partitions, transactions, deltas, trees, reconciliation, tracked sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmafold.functions.fields import FP251
from sigmafold.operators import deltas, laws, reconcile, tables, trees
from sigmafold.plans.law_queries import _e, fold_sql, product_sql, table

FOUND: dict = {}


def query(sql: str | None):
    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


_SCHEMA = tables.TableSchema((("c_custkey", "i64"),), ("c_custkey",))
_KEY_HEX = " || ".join(f"printf('%02x', (c_custkey >> {8 * i}) & 255)" for i in range(8))
_KEY_SQL = f"sha256(unhex('{(tables.KEY_DOMAIN.encode() + bytes(1)).hex()}{_SCHEMA.id}' || '0900000000000000' || '02' || {_KEY_HEX}))"
_PART_SQL = "(" + " + ".join(f"(('0x' || substr(k, {2 * i + 1}, 2))::BIGINT * {pow(256, i, 12)})" for i in range(8)) + ") % 12"


@query(f"SELECT c_custkey, k AS row_key, ({_PART_SQL})::INT AS part FROM (SELECT c_custkey, {_KEY_SQL} AS k FROM customer)")
def row_key_sha256(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", _SCHEMA.row_key().alias("row_key"))
    return rows.withColumn("part", tables.partition_of(F.col("row_key"), 12))


_F17 = "((c_custkey % 251 + 17) % 251)"


@query(
    f"""SELECT ({_PART_SQL})::INT AS part, {product_sql(_F17)} AS product_0, count(*) FILTER (WHERE {_F17} = 0) AS zeros_0, count(*) AS n
    FROM (SELECT *, {_KEY_SQL} AS k FROM customer) GROUP BY 1"""
)
def partition_summary(spark, sf):
    rows = table(spark, sf, "customer").withColumn("row_key", _SCHEMA.row_key())
    return tables.summary(rows, F.col("row_key"), 12, _e("c_custkey"), FP251, 17)


@query(
    """SELECT event_type, item, sum(CASE WHEN event_id % 4 = 0 AND event_id > first THEN 0 ELSE 1 END)::BIGINT AS multiplicity
    FROM (SELECT event_type, user_id % 50 AS item, event_id, min(event_id) OVER (PARTITION BY event_type, user_id % 50) AS first FROM events) GROUP BY 1, 2 HAVING multiplicity > 0"""
)
def tracked_multiset_counts(spark, sf):
    rows = table(spark, sf, "events").withColumn("item", F.col("user_id") % 50)
    gone = rows.join(rows.groupBy("event_type", "item").agg(F.min("event_id").alias("first")), ["event_type", "item"])
    changes = rows.select("event_type", "item", F.lit(1).alias("sign")).unionByName(gone.where("event_id % 4 = 0 and event_id > first").select("event_type", "item", F.lit(-1).alias("sign")))
    return deltas.tracked_multiset(changes, ["event_type"], "item", F.col("sign"))


@query("SELECT user_id FROM events GROUP BY 1 HAVING count(*) % 2 = 1")
def symmetric_difference_items(spark, sf):
    return reconcile.symmetric_difference(table(spark, sf, "events"), "user_id")


def _log(spark, sf):
    op = F.when(F.col("event_id") % 5 == 0, "delete").otherwise("upsert")
    return table(spark, sf, "events").select("user_id", F.col("event_id").alias("revision"), op.alias("op"), "event_type", "value")


_LAST = """SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_id % 5 <> 0"""


@query(_LAST)
def txn_replay_final_state(spark, sf):
    return tables.replay(_log(spark, sf), ["user_id"], "revision", ["event_type", "value"])


@query(_LAST)
def txn_replay_idempotent(spark, sf):
    """Half of the log is delivered twice."""
    log = _log(spark, sf)
    return tables.replay(log.unionByName(log.where("revision % 2 = 0")), ["user_id"], "revision", ["event_type", "value"])


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 1 END AS version
    FROM orders WHERE o_orderkey % 3 <> 2 UNION ALL SELECT -o_orderkey, 0.5, 1 FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey > 0"""
)
def txn_apply_mutations(spark, sf):
    """Deletes, updates and inserts of one transaction, each checked against its before-image."""
    base = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("version"))
    after = {"after_o_totalprice": F.col("o_totalprice") + 1, "after_version": F.lit(2)}
    cols = ["op", "o_orderkey", "before_o_totalprice", "before_version", "after_o_totalprice", "after_version"]
    seen = base.withColumns({"before_o_totalprice": F.col("o_totalprice"), "before_version": F.col("version")})
    update = seen.where("o_orderkey % 3 = 1").withColumn("op", F.lit("update")).withColumns(after).select(*cols)
    none = {c: F.lit(None) for c in ("after_o_totalprice", "after_version")}
    delete = seen.where("o_orderkey % 3 = 2").withColumn("op", F.lit("delete")).withColumns(none).select(*cols)
    fresh = base.where("o_orderkey % 11 = 0 and o_orderkey > 0").select(
        F.lit("insert").alias("op"), (-F.col("o_orderkey")).alias("o_orderkey"), F.lit(None).cast("double").alias("before_o_totalprice"), F.lit(None).cast("int").alias("before_version"),
        F.lit(0.5).alias("after_o_totalprice"), F.lit(1).alias("after_version"),
    )
    return tables.apply_transaction(base, update.unionByName(delete).unionByName(fresh), ["o_orderkey"], ["o_totalprice", "version"])


_O17 = "((o_custkey % 251 + 17) % 251)"


@query(f"SELECT o_orderpriority, {product_sql(_O17)} AS product_0, count(*) FILTER (WHERE {_O17} = 0) AS zeros_0, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1")
def signature_delta_apply(spark, sf):
    """The states without a fifth of the rows, from the whole states and the rows taken out."""
    rows = table(spark, sf, "orders")
    whole = laws.multiset_signature(rows, ["o_orderpriority"], _e("o_custkey"), FP251, [17])
    gone = rows.where("o_orderkey % 5 = 0").withColumn("sign", F.lit(-1))
    return tables.apply_delta(whole, gone, ["o_orderpriority"], FP251, _e("o_custkey"), 17, F.col("sign"))


CHUNK, BASE = 256, 11
_CHUNKS_SQL = f"SELECT doc_id, unnest(range(0, (length(text) + {CHUNK - 1}) // {CHUNK})) AS idx, text FROM documents"
_E_SQL = f"(('0x' || substr(md5(substr(text, idx * {CHUNK} + 1, {CHUNK})), 1, 8))::BIGINT % 251)"


def _tree(spark, sf):
    return _tree_of(table(spark, sf, "documents"))


def _tree_of(documents):
    e = F.pmod(F.conv(F.substring(F.md5("chunk"), 1, 8), 16, 10).cast("bigint"), F.lit(251))
    chunks = trees.text_chunks(documents, "doc_id", "text", CHUNK)
    return trees.build(trees.leaves(chunks, "doc_id", e), "doc_id", FP251, BASE)


@query(f"SELECT doc_id, {fold_sql(f'list({_E_SQL} ORDER BY idx)', 0, '(a * 11 + x) % 251')} AS state, count(*) AS n FROM ({_CHUNKS_SQL}) GROUP BY 1")
def summary_tree_root(spark, sf):
    """Level by level; the root equals the flat sequence of all chunks."""
    return trees.roots(_tree(spark, sf), "doc_id")


@query(
    f"SELECT doc_id, {fold_sql(f'list(CASE WHEN idx = 1 THEN 7 ELSE {_E_SQL} END ORDER BY idx)', 0, '(a * 11 + x) % 251')} AS state, count(*) AS n FROM ({_CHUNKS_SQL}) GROUP BY 1"
)
def summary_tree_edit(spark, sf):
    """The second chunk of every document is replaced; only its ancestors are computed again."""
    nodes = _tree(spark, sf)
    changed = nodes.where("level = 0 and idx = 1").select("doc_id", "idx", F.lit(7).cast("bigint").alias("state"))
    return trees.roots(trees.edit(nodes, changed, "doc_id", FP251, BASE), "doc_id")


@query(
    """WITH l AS (SELECT DISTINCT p_size % 60 AS v FROM part WHERE p_size % 23 <> 5), r AS (SELECT DISTINCT p_size % 60 AS v FROM part WHERE p_size % 17 <> 3)
    SELECT 1::BIGINT AS pair_id, 'left' AS side, v::BIGINT AS value FROM (FROM l EXCEPT FROM r) UNION ALL SELECT 1, 'right', v FROM (FROM r EXCEPT FROM l)"""
)
def reconcile_only_left_right(spark, sf):
    """Differences of two sets from their sketches of six numbers alone."""
    parts = table(spark, sf, "part").withColumn("v", (F.col("p_size") % 60).cast("bigint"))
    one, two = (
        reconcile.sketch(parts.where(cond).withColumn("pair_id", F.lit(1).cast("bigint")), ["pair_id"], F.col("v"), 60, 6) for cond in ("p_size % 23 <> 5", "p_size % 17 <> 3")
    )
    left = one.select("pair_id", F.col("evals").alias("left"), F.col("n").alias("n_left"))
    return reconcile.reconcile_pairs(left.join(two.select("pair_id", F.col("evals").alias("right"), F.col("n").alias("n_right")), "pair_id"), 60, 6)


@query("SELECT c_custkey, count(*) AS rows FROM (SELECT c_nationkey AS c_custkey FROM customer) GROUP BY 1 HAVING count(*) > 1")
def duplicate_key_check(spark, sf):
    return tables.duplicate_keys(table(spark, sf, "customer").select(F.col("c_nationkey").alias("c_custkey")), ["c_custkey"])
