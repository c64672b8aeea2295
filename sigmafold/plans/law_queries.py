"""Queries on signatures: laws, merging, residuals, scans, encoders, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmafold.functions import fields
from sigmafold.functions.fields import FP251, GF2_128, GOLDILOCKS
from sigmafold.operators import laws
from sigmafold.streaming import laws as streaming

P = 251
#: Offsets and bases of the queries.
OFFSETS = [17, 53, 101]
BASES = [11, 29]
FOUND: dict = {}


def query(sql: str | None):
    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _e(column: str):
    return FP251.c_reduce(F.col(column))


def fold_sql(values: str, start: int = 1, step: str = "(a * x) % 251") -> str:
    """A left fold of a DuckDB list."""
    return f"list_reduce(list_prepend({start}::BIGINT, coalesce({values}, [])), lambda a, x: {step})"


def product_sql(factor: str) -> str:
    return fold_sql(f"list({factor}) FILTER (WHERE {factor} <> 0)")


@query("SELECT l_returnflag, sum(l_partkey % 251)::BIGINT % 251 AS state, count(*) AS n FROM lineitem GROUP BY 1")
def additive_fp251_by_flag(spark, sf):
    return laws.additive_signature(table(spark, sf, "lineitem"), ["l_returnflag"], _e("l_partkey"), FP251)


@query("SELECT c_nationkey, bit_xor(c_custkey) AS state, count(*) AS n FROM customer GROUP BY 1")
def additive_xor_by_nation(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.bit_xor("c_custkey").alias("state"), F.count(F.lit(1)).alias("n"))


def _limb(start: int) -> str:
    """Exclusive or of eight digest bytes read as a little-endian integer, as a signed 64-bit number."""
    turned = " || ".join(f"substr(h, {start + 14 - 2 * i}, 2)" for i in range(8))
    return f"bit_xor(('0x' || {turned})::UBIGINT)"


def _signed(x: str) -> str:
    return f"(CASE WHEN {x} >= 9223372036854775808 THEN ({x}::HUGEINT - 18446744073709551616)::BIGINT ELSE {x}::BIGINT END)"


@query(
    f"""WITH k AS (SELECT l_returnflag, md5(l_orderkey::VARCHAR || ':' || l_linenumber) AS h FROM lineitem),
    x AS (SELECT l_returnflag, {_limb(1)} AS a, {_limb(17)} AS b, count(*) AS n FROM k GROUP BY 1)
    SELECT l_returnflag, {_signed('a')} AS limb_0, {_signed('b')} AS limb_1, n FROM x"""
)
def additive_gf2_128_by_flag(spark, sf):
    """The additive law over 128-bit elements made from a digest of the row's key."""
    rows = table(spark, sf, "lineitem").withColumn("b", F.unhex(F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber"))))
    return laws.xor_signature(rows, ["l_returnflag"], F.col("b"), GF2_128)


_F17 = "((l_partkey % 251 + 17) % 251)"


@query(f"SELECT l_returnflag, {product_sql(_F17)} AS product_0, count(*) FILTER (WHERE {_F17} = 0) AS zeros_0, count(*) AS n FROM lineitem GROUP BY 1")
def multiset_fp251_by_flag(spark, sf):
    return laws.multiset_signature(table(spark, sf, "lineitem"), ["l_returnflag"], _e("l_partkey"), FP251, OFFSETS[:1])


def _factors_sql(column: str) -> str:
    parts = []
    for k, offset in enumerate(OFFSETS):
        f = f"(({column} % 251 + {offset}) % 251)"
        parts += [f"{product_sql(f)} AS product_{k}", f"count(*) FILTER (WHERE {f} = 0) AS zeros_{k}"]
    return ", ".join(parts)


@query(f"SELECT o_orderpriority, {_factors_sql('o_custkey')}, count(*) AS n FROM orders GROUP BY 1")
def multiset_k3_fp251_by_mode(spark, sf):
    return laws.multiset_signature(table(spark, sf, "orders"), ["o_orderpriority"], _e("o_custkey"), FP251, OFFSETS)


@query(
    f"""SELECT o_orderpriority, CASE WHEN count(*) FILTER (WHERE (o_custkey % 251 + 17) % 251 = 0) > 0 THEN 0
    ELSE {product_sql("((o_custkey % 251 + 17) % 251)")} END AS evaluated FROM orders GROUP BY 1"""
)
def evaluated_product(spark, sf):
    s = laws.multiset_signature(table(spark, sf, "orders"), ["o_orderpriority"], _e("o_custkey"), FP251, OFFSETS[:1])
    return s.select("o_orderpriority", laws.evaluated(F.col("product_0"), F.col("zeros_0")).alias("evaluated"))


def _horner(values: str, base: int) -> str:
    return fold_sql(values, 0, f"(a * {base} + x) % 251")


@query(f"SELECT l_orderkey, {_horner('list(l_partkey % 251 ORDER BY l_linenumber, l_partkey)', 11)} AS state_0, count(*) AS n FROM lineitem GROUP BY 1")
def sequence_fp251_by_order(spark, sf):
    return laws.sequence_signature(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], _e("l_partkey"), FP251, BASES[:1])


@query(
    f"""SELECT user_id, {_horner('list(event_id % 251 ORDER BY event_id)', 11)} AS forward, {_horner('list(event_id % 251 ORDER BY event_id DESC)', 11)} AS backward,
    {fold_sql('list(11 ORDER BY event_id)')} AS power, count(*) AS n FROM events GROUP BY 1"""
)
def bidirectional_fp251_by_user(spark, sf):
    return laws.bidirectional_signature(table(spark, sf, "events"), ["user_id"], ["event_id"], _e("event_id"), FP251, 11)


@query(
    f"""SELECT conv_id, {_horner('list(length(text) % 251 ORDER BY turn, role, text)', 11)} AS state_0, {_horner('list(length(text) % 251 ORDER BY turn, role, text)', 29)} AS state_1,
    count(*) AS n FROM conversations GROUP BY 1"""
)
def sequence_k2_by_conversation(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("e", F.length("text") % P)
    return laws.sequence_signature(rows, ["conv_id"], ["turn", "role", "text"], F.col("e").cast("bigint"), FP251, BASES)


def _goldilocks_bytes(column: str):
    """A canonical element of eight bytes: the key times a large constant, as a little-endian integer below the prime."""
    digits = F.lpad(F.hex(F.col(column) * F.lit(2_654_435_761)), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


def _little_endian(states):
    """Decimal text of eight little-endian bytes."""
    b = F.hex(states)
    big = F.concat(*[F.substring(b, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(big, 16, 10)


_GOLD = "18446744069414584321::UHUGEINT"


@query(f"SELECT c_mktsegment, ((sum(c_custkey * 2654435761::HUGEINT))::UHUGEINT % {_GOLD})::VARCHAR AS state, count(*) AS n FROM customer GROUP BY 1")
def additive_goldilocks_by_segment(spark, sf):
    s = laws.fold_signature(table(spark, sf, "customer"), ["c_mktsegment"], _goldilocks_bytes("c_custkey"), GOLDILOCKS, "additive")
    return s.select("c_mktsegment", _little_endian(F.col("states")[0]).alias("state"), "n")


@query(
    f"""SELECT p_size, list_reduce(list_prepend(1::UHUGEINT, list((p_partkey::UHUGEINT * 2654435761::UHUGEINT + 17::UHUGEINT) % {_GOLD})), lambda a, x: (a * x) % {_GOLD})::VARCHAR AS product,
    count(*) AS n FROM part GROUP BY 1"""
)
def multiset_goldilocks_by_size(spark, sf):
    s = laws.fold_signature(table(spark, sf, "part"), ["p_size"], _goldilocks_bytes("p_partkey"), GOLDILOCKS, "multiset", [17])
    return s.select("p_size", _little_endian(F.col("states")[0]).alias("product"), "n")


@query(FOUND["multiset_fp251_by_flag"][1])
def combine_partials_equals_whole(spark, sf):
    parts = table(spark, sf, "lineitem").withColumn("split", F.pmod(F.xxhash64("l_orderkey"), F.lit(7)))
    states = laws.multiset_signature(parts, ["l_returnflag", "split"], _e("l_partkey"), FP251, OFFSETS[:1])
    return laws.merge_multiset(states, ["l_returnflag"], FP251, 1)


@query(FOUND["sequence_fp251_by_order"][1])
def combine_sequences_equals_whole(spark, sf):
    parts = table(spark, sf, "lineitem").withColumn("piece", F.expr("l_linenumber div 3"))
    states = laws.sequence_signature(parts, ["l_orderkey", "piece"], ["l_linenumber", "l_partkey"], _e("l_partkey"), FP251, BASES[:1])
    return laws.merge_sequence(states, ["l_orderkey"], ["piece"], FP251, BASES[:1])


@query("SELECT c_custkey, list_reduce(list_concat([0::BIGINT], list_reverse(list_concat([ord(c) for c in string_split(c_name, '')], [1, 66, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: (a * 256 + x) % 251) AS e FROM customer")
def encode_prime_framed_names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fields.c_encode_integer(FP251, F.col("c_name").cast("binary"), 66).alias("e"))


_FRAMED = "regexp_extract_all(hex(encode(coalesce(text, ''))) || '01' || '4200000000000000', '..')"
_REVERSED = f"list_reverse(list_transform({_FRAMED}, lambda b: ('0x' || b)::BIGINT))"


@query(f"SELECT doc_id, {fold_sql(_REVERSED, 0, '(a * 256 + x) % 251')} AS e FROM documents")
def encode_prime_framed_docs(spark, sf):
    """The framed encoding of whole texts, in numpy: doc_id, e."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = fields.encode_integers(FP251, texts.fill_null(b""), 66)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "e"])

    return table(spark, sf, "documents").select("doc_id", "text").mapInArrow(run, "doc_id bigint, e bigint")


@query(
    f"""WITH s AS (SELECT user_id, list(event_id % 251 ORDER BY event_id) AS es FROM events GROUP BY 1)
    SELECT user_id, {_horner('es[:-2]', 11)} AS state, len(es) - 1 AS n FROM s"""
)
def residual_remove_item(spark, sf):
    """The sequence state without the last event, from the state and that event alone."""
    rows = table(spark, sf, "events")
    s = laws.sequence_signature(rows, ["user_id"], ["event_id"], _e("event_id"), FP251, BASES[:1])
    last = rows.groupBy("user_id").agg(FP251.c_reduce(F.max("event_id")).alias("last"))
    return s.join(last, "user_id").select("user_id", laws.sequence_residual(FP251, F.col("state_0"), F.col("last"), 11).alias("state"), (F.col("n") - 1).alias("n"))


@query("SELECT event_type, true AS ok, count(*) AS n FROM events GROUP BY 1")
def residual_roundtrip_ok(spark, sf):
    """Taking the latest item out of a multiset and putting it back gives the same state."""
    rows = table(spark, sf, "events")
    s = laws.multiset_signature(rows, ["event_type"], _e("event_id"), FP251, OFFSETS[:1])
    last = rows.groupBy("event_type").agg(laws.factor(FP251, FP251.c_reduce(F.max("event_id")), OFFSETS[0]).alias("f"))
    product, zeros = laws.multiset_residual(FP251, F.col("product_0"), F.col("zeros_0"), F.col("f"))
    back = s.join(last, "event_type").withColumn("p", product).withColumn("z", zeros)
    again = F.when(F.col("f") == 0, F.col("p")).otherwise(FP251.c_mul(F.col("p"), F.col("f")))
    ok = (again == F.col("product_0")) & (F.col("z") + (F.col("f") == 0).cast("int") == F.col("zeros_0"))
    return back.select("event_type", ok.alias("ok"), "n")


_SCAN = "list_reduce(list_prepend(1::BIGINT, list(l_partkey % 251) OVER ({w})), lambda a, x: (a * x) % 251)"


@query(
    f"""SELECT l_orderkey, l_linenumber, {_SCAN.format(w="PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")} AS product,
    coalesce({_SCAN.format(w="PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")}, 1) AS before FROM lineitem"""
)
def prefix_product_scan(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    one = laws.product_scan(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"], _e("l_partkey"), FP251, "product")
    return laws.product_scan(one, ["l_orderkey"], ["l_linenumber", "l_partkey"], _e("l_partkey"), FP251, "before", exclusive=True).drop("l_partkey")


@query(
    f"""SELECT l_orderkey, l_linenumber, {_SCAN.format(w="PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")} AS product FROM lineitem"""
)
def suffix_product_scan(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return laws.product_scan(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"], _e("l_partkey"), FP251, "product", suffix=True).drop("l_partkey")


@query(
    """SELECT l_orderkey, l_linenumber, list_reduce(list_prepend(0::BIGINT, list(l_partkey % 251) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), lambda a, x: (a * 11 + x) % 251) AS state FROM lineitem"""
)
def prefix_sequence_state(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return laws.sequence_scan(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"], _e("l_partkey"), FP251, 11, "state").drop("l_partkey")


@query(
    """SELECT p_partkey, list_reduce([0::BIGINT, p_size % 251, p_partkey % 251, length(p_name) % 251], lambda a, x: (a * 29 + x) % 251) AS value,
    CASE WHEN p_partkey % 251 = 0 THEN 0 ELSE list_filter(range(1, 251), lambda y: (y * (p_partkey % 251)) % 251 = 1)[1] END AS inverse FROM part"""
)
def horner_and_inverse(spark, sf):
    coefficients = F.array(F.col("p_size") % P, F.col("p_partkey") % P, F.length("p_name") % P).cast("array<bigint>")
    return table(spark, sf, "part").select("p_partkey", fields.c_horner(FP251, coefficients, 29).alias("value"), FP251.c_inverse(_e("p_partkey")).alias("inverse"))


_STATE = f"sum(user_id % 251)::BIGINT % 251 AS state, {product_sql('((user_id % 251 + 17) % 251)')} AS product, count(*) FILTER (WHERE (user_id % 251 + 17) % 251 = 0) AS zeros, count(*) AS n"


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, {_STATE} FROM events GROUP BY 1, 2, 3")
def window_tumbling_law(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streaming.windowed(rows, "ts", ["event_type"], _e("user_id"), FP251, OFFSETS[0], "1 hour")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(
    """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM m)
    SELECT min(ts) AS start, user_id, sum(event_id % 251)::BIGINT % 251 AS state, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def session_law(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.sessions(rows, "ts", ["user_id"], _e("event_id"), FP251, "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))
