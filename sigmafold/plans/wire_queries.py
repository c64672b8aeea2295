"""Queries on canonical bytes, encoders, deltas, journals, tracked collections and files under edit.

The SQL builds the same bytes as hexadecimal text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmafold.functions import encoders
from sigmafold.functions.fields import FP251, GF2_128, GOLDILOCKS
from sigmafold.operators import codecs, deltas, laws, tables, trees
from sigmafold.operators.tables import TableSchema
from sigmafold.plans.law_queries import _e, _GOLD, _goldilocks_bytes, _little_endian, fold_sql, product_sql, table
from sigmafold.runtime import materialise, scratch_path

FOUND: dict = {}


def query(sql: str | None):
    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


CUSTOMER = TableSchema((("c_custkey", "i64"), ("c_name", "text"), ("c_nationkey", "i64"), ("c_mktsegment", "text")), ("c_custkey",), 1, ("c_mktsegment",))
ORDER = TableSchema((("o_orderkey", "i64"), ("o_orderstatus", "text"), ("o_custkey", "i64")), ("o_orderkey",))
SPACE = codecs.namespace_of(b"orders")


def _le(x: str, n: int = 8) -> str:
    return "(" + " || ".join(f"printf('%02x', (({x})::BIGINT >> {8 * i}) & 255)" for i in range(n)) + ")"


def _frame(h: str) -> str:
    return f"({_le(f'length({h}) // 2')} || {h})"


def _text(x: str) -> str:
    return f"('05' || {_frame(f'lower(hex(encode({x})))')})"


def _i64(x: str) -> str:
    return f"('02' || {_le(x)})"


def _row_head(schema: TableSchema, version: str) -> str:
    return f"'{(codecs.ROW + bytes([1, 0, 0, 0])).hex()}{schema.id}' || {_le(version)} || '{len(schema.columns).to_bytes(8, 'little').hex()}'"


_SEGMENT = "CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END"
_CUSTOMER_ROW = f"{_row_head(CUSTOMER, 'c_custkey % 5 + 1')} || {_i64('c_custkey')} || {_text('c_name')} || {_i64('c_nationkey')} || CASE WHEN s IS NULL THEN '00' ELSE {_text('s')} END"


def _customers(spark, sf):
    segment = F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))
    return table(spark, sf, "customer").select((F.col("c_custkey") % 5 + 1).alias("version"), "c_custkey", "c_name", F.col("c_nationkey").cast("bigint"), segment.alias("c_mktsegment"))


@query(f"SELECT sha256(unhex({_CUSTOMER_ROW})) AS row_hash, (c_custkey % 5 + 1)::BIGINT AS version, c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, s AS c_mktsegment FROM (SELECT *, {_SEGMENT} AS s FROM customer)")
def row_codec(spark, sf):
    """Rows to bytes and back; the hash is that of the bytes."""
    coded = _customers(spark, sf).select(codecs.encode_row(CUSTOMER).alias("bytes")).withColumn("row_hash", F.sha2("bytes", 256))
    return codecs.decode_rows(coded, "bytes", CUSTOMER, ["row_hash"])


_KEY_HEX = f"'{(tables.KEY_DOMAIN.encode() + bytes(1)).hex()}{CUSTOMER.id}' || {_frame(_i64('c_custkey'))}"
_KEYED = f"SELECT *, sha256(unhex({_KEY_HEX})) AS row_key FROM customer"
_PART = "((" + " + ".join(f"(('0x' || substr(row_key, {2 * i + 1}, 2))::BIGINT * {pow(256, i, 12)})" for i in range(8)) + ") % 12)::INT"


@query(f"SELECT row_number() OVER (ORDER BY {_PART}, row_key) AS place, {_PART} AS part, row_key, c_custkey FROM ({_KEYED})")
def table_scan_order(spark, sf):
    """Every row's place in a full scan by partition and key: partitions are counted first, then rows inside them."""
    from pyspark.sql import Window

    rows = tables.keyed(_customers(spark, sf), CUSTOMER, 12)
    before = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("row_key"))
    return rows.withColumn("inside", inside).join(before, "part").select((F.col("inside") + F.col("before")).alias("place"), "part", "row_key", "c_custkey")


@query(f"SELECT {_PART} AS part, c_custkey, c_name FROM ({_KEYED}) WHERE c_custkey % 31 = 4")
def table_point_lookup(spark, sf):
    wanted = table(spark, sf, "customer").where("c_custkey % 31 = 4").select("c_custkey")
    return tables.lookup(tables.keyed(_customers(spark, sf), CUSTOMER, 12), wanted, CUSTOMER, 12).select("part", "c_custkey", "c_name")


_F17 = "((c_custkey % 251 + 17) % 251)"


@query(f"SELECT {product_sql(_F17)} AS product_0, (count(*) FILTER (WHERE {_F17} = 0))::BIGINT AS zeros_0, count(*) AS n, CASE WHEN count(*) FILTER (WHERE {_F17} = 0) > 0 THEN 0 ELSE {product_sql(_F17)} END AS evaluation FROM customer")
def table_summary(spark, sf):
    """The table's summary from those of its partitions."""
    rows = _customers(spark, sf).withColumn("row_key", CUSTOMER.row_key())
    return tables.merged_summary(tables.summary(rows, F.col("row_key"), 12, _e("c_custkey"), FP251, 17), FP251)


# --- transactions ------------------------------------------------------------------------------------------


def _mutations(spark, sf, revisions: int):
    """Orders in turn inserted, deleted and updated, by transactions of about equal size."""
    op = F.element_at(F.array(F.lit("insert"), F.lit("delete"), F.lit("update")), (F.expr(f"(o_orderkey div {revisions}) % 3") + 1).cast("int"))
    rows = table(spark, sf, "orders").select((F.col("o_orderkey") % revisions).alias("source_revision"), F.col("o_orderkey").alias("seq"), op.alias("op"), "o_orderkey", "o_orderstatus", "o_custkey")
    for side, none, version, shift in (("before", "insert", 1, 0), ("after", "delete", 2, 1)):
        there = F.col("op") != none
        for name, x in (("version", F.lit(version)), ("o_orderkey", F.col("o_orderkey")), ("o_orderstatus", F.col("o_orderstatus")), ("o_custkey", F.col("o_custkey") + shift)):
            rows = rows.withColumn(f"{side}_{name}", F.when(there, x.cast("string" if name == "o_orderstatus" else "bigint")))
    return rows.drop("o_orderkey", "o_orderstatus", "o_custkey")


def _order_row(version: str, shift: str) -> str:
    return f"({_row_head(ORDER, version)} || {_i64('o_orderkey')} || {_text('o_orderstatus')} || {_i64(f'o_custkey + {shift}')})"


_TX_HEAD = f"'{(codecs.TRANSACTION + bytes([1, 0, 0, 0]) + SPACE).hex()}{ORDER.id}'"
_TX = f"""WITH m AS (SELECT o_orderkey % 20 AS r, (o_orderkey // 20) % 3 AS op, o_orderkey, {_order_row('1', '0')} AS b, {_order_row('2', '1')} AS a FROM orders),
f AS (SELECT r, o_orderkey, CASE op WHEN 0 THEN '01' || {_frame('a')} WHEN 1 THEN '02' || {_frame('b')} ELSE '03' || {_frame('b')} || {_frame('a')} END AS h FROM m),
t AS (SELECT r AS source_revision, count(*) AS mutations, {_TX_HEAD} || {_le('any_value(r)')} || {_le('any_value(r) + 1')} || {_le('count(*)')} || string_agg(h, '' ORDER BY o_orderkey) AS h FROM f GROUP BY r)"""
_TX_DOMAIN = (b"sigmafold-transaction-v1" + bytes(1)).hex()


@query(f"{_TX} SELECT source_revision, source_revision + 1 AS target_revision, mutations, sha256(unhex('{_TX_DOMAIN}' || {_frame('h')})) AS transaction_id FROM t")
def transaction_codec(spark, sf):
    """Ids of twenty transactions, which grow with the table and are kept in parts."""
    ids = codecs.transaction_ids(codecs.encode_transaction_parts(_mutations(spark, sf, 20), ORDER, SPACE))
    return ids.select("source_revision", (F.col("source_revision") + 1).alias("target_revision"), "mutations", "transaction_id")


@query(
    """SELECT o_orderkey % 20 AS source_revision, ['insert', 'delete', 'update'][(o_orderkey // 20) % 3 + 1] AS op, o_orderkey, o_orderstatus, CASE WHEN (o_orderkey // 20) % 3 <> 0 THEN o_custkey END AS before_o_custkey,
    CASE WHEN (o_orderkey // 20) % 3 <> 1 THEN o_custkey + 1 END AS after_o_custkey, row_number() OVER (PARTITION BY o_orderkey % 20 ORDER BY o_orderkey) - 1 AS seq FROM orders"""
)
def transaction_decode(spark, sf):
    """Mutations to bytes and back."""
    found = codecs.decode_transaction_parts(codecs.encode_transaction_parts(_mutations(spark, sf, 20), ORDER, SPACE), ORDER, SPACE)
    return found.select("source_revision", "op", F.coalesce("before_o_orderkey", "after_o_orderkey").alias("o_orderkey"), F.coalesce("before_o_orderstatus", "after_o_orderstatus").alias("o_orderstatus"), "before_o_custkey", "after_o_custkey", "seq")


@query(f"{_TX} SELECT row_number() OVER (ORDER BY source_revision) - 1 AS position, sha256(unhex(h)) AS entry_hash FROM t")
def log_codec(spark, sf):
    """All transactions as one log's bytes, and the entries read back."""
    log = codecs.encode_log_parts(codecs.encode_transaction_parts(_mutations(spark, sf, 20), ORDER, SPACE))
    return codecs.digests(codecs.decode_log_parts(log), "position").select("position", F.col("digest").alias("entry_hash"))


@query(
    """SELECT CASE WHEN (o_orderkey // 3) % 3 = 2 THEN 2 WHEN (o_orderkey // 3) % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version, o_orderkey, o_orderstatus, o_custkey + 1 AS o_custkey FROM orders WHERE (o_orderkey // 3) % 3 <> 1"""
)
def revisioned_table_replay(spark, sf):
    """A table in a folder after a log of three transactions, which is then delivered again and changes nothing."""
    mutations = materialise(_mutations(spark, sf, 3), "mutations")
    log = materialise(codecs.encode_transaction_parts(mutations, ORDER, SPACE), "log")
    store = tables.RevisionedTable(spark, scratch_path(spark, "revisions"), ORDER, SPACE, codecs.IN_PARTS)
    store.create(mutations.where("op <> 'insert'").select("before_version", *[f"before_{n}" for n, _ in ORDER.columns]).toDF("version", *[n for n, _ in ORDER.columns]))
    for again in (False, True):
        report = store.replay(log)
        assert (report.applied, report.skipped, report.revision) == ((0, 3, 3) if again else (3, 0, 3))
    return store.rows()


# --- states, deltas, journals -----------------------------------------------------------------------------------

ADDITIVE = codecs.context_of(FP251, "reduce", "additive", [])
MULTISET = codecs.context_of(FP251, "reduce", "multiset", [17])
_L17 = "((l_partkey % 251 + 17) % 251)"


@query(
    f"""SELECT l_returnflag, sha256(unhex('{MULTISET.header.hex()}' || {_le('n')} || {_le('z')} || {_le('p', 1)})) AS state_hash, n, z AS zeros, p AS product
    FROM (SELECT l_returnflag, count(*) AS n, (count(*) FILTER (WHERE {_L17} = 0))::BIGINT AS z, {product_sql(_L17)} AS p FROM lineitem GROUP BY 1)"""
)
def state_codec(spark, sf):
    """Multiset states to bytes and back."""
    states = laws.multiset_signature(table(spark, sf, "lineitem"), ["l_returnflag"], _e("l_partkey"), FP251, [17])
    coded = states.select("l_returnflag", codecs.encode_state(MULTISET, [F.col("n"), F.col("zeros_0")], [F.col("product_0")]).alias("b"))
    back = coded.withColumn("s", codecs.decode_state(F.col("b"), MULTISET, 2, 1, 251))
    return back.select("l_returnflag", F.sha2("b", 256).alias("state_hash"), F.col("s.c0").alias("n"), F.col("s.c1").alias("zeros"), F.col("s.e0").alias("product"))


def _journal(spark, sf):
    """Per event type, thirty changes: rows come in by event_id, and a quarter of each goes with the next change."""
    rows = table(spark, sf, "events").select("event_type", "event_id", F.expr("event_id % 30").alias("r"))
    added = rows.select("event_type", F.col("r").alias("source_revision"), "event_id", F.lit(1).alias("sign"))
    removed = rows.where("event_id % 4 = 1").select("event_type", (F.col("r") + 1).alias("source_revision"), "event_id", F.lit(-1).alias("sign")).where("source_revision < 30")
    return added.unionByName(removed)


def _signed(sign: int, f):
    return F.when(F.col("sign") == sign, f)


@query(
    """WITH r AS (SELECT DISTINCT event_type, event_id % 30 AS r FROM events),
    j AS (SELECT event_type, event_id % 30 AS r, event_id % 251 AS e, 1 AS n FROM events UNION ALL SELECT event_type, event_id % 30 + 1, -(event_id % 251), -1 FROM events WHERE event_id % 4 = 1)
    SELECT r.event_type, r.r + 1 AS revision, ((sum(j.e) % 251 + 251) % 251)::BIGINT AS state, sum(j.n)::BIGINT AS n FROM r JOIN j ON r.event_type = j.event_type AND j.r <= r.r GROUP BY 1, 2"""
)
def journal_additive_states(spark, sf):
    """The additive state after each entry of a journal."""
    e = _e("event_id")
    journal = _journal(spark, sf).groupBy("event_type", "source_revision").agg(
        *[x.alias(f"{name}{tail}") for sign, name in ((1, "added"), (-1, "removed")) for tail, x in (("", laws.additive(FP251, _signed(sign, e))), ("_n", F.count(_signed(sign, e))))]
    )
    journal = materialise(journal.withColumn("delta_id", codecs.domain_hash("sigmafold-delta-v1", F.concat_ws("|", "event_type", "source_revision", "added", "removed").cast("binary"))), "journal")
    deltas.check_journal(journal, ["event_type"])
    return deltas.running_additive(journal, ["event_type"], FP251)


_J17 = "((j.e + 17) % 251)"


@query(
    f"""WITH r AS (SELECT DISTINCT event_type, event_id % 30 AS r FROM events), j AS (SELECT event_type, event_id % 30 AS r, event_id % 4 = 1 AS goes, event_id % 251 AS e FROM events)
    SELECT r.event_type, r.r + 1 AS revision, {fold_sql(f"list({_J17}) FILTER (WHERE {_J17} <> 0 AND NOT (goes AND j.r < r.r))")} AS product,
    (count(*) FILTER (WHERE {_J17} = 0 AND NOT (goes AND j.r < r.r)))::BIGINT AS zeros, count(*) FILTER (WHERE NOT (goes AND j.r < r.r)) AS n
    FROM r JOIN j ON r.event_type = j.event_type AND j.r <= r.r GROUP BY 1, 2"""
)
def journal_multiset_states(spark, sf):
    f = laws.factor(FP251, _e("event_id"), 17)
    aggregates = []
    for sign, name in ((1, "added"), (-1, "removed")):
        mine = F.when(F.col("sign") == sign, F.lit(1)).otherwise(F.lit(0))
        aggregates += [laws.multiset_product(FP251, f, mine).alias(f"{name}_product"), laws.multiset_zeros(f, mine).alias(f"{name}_zeros"), F.sum(mine).cast("bigint").alias(f"{name}_n")]
    return deltas.running_multiset(_journal(spark, sf).groupBy("event_type", "source_revision").agg(*aggregates), ["event_type"], FP251)


@query(f"SELECT user_id, rn AS revision, {fold_sql('list(x) OVER (PARTITION BY user_id ORDER BY rn)', 0, '(a * 11 + x) % 251')} AS state, rn AS n FROM (SELECT user_id, event_id % 251 AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)")
def journal_sequence_states(spark, sf):
    """The ordered state after each appended event of a user."""
    from pyspark.sql import Window

    rows = table(spark, sf, "events").withColumn("source_revision", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    journal = rows.select("user_id", F.col("source_revision").cast("bigint").alias("source_revision"), _e("event_id").alias("state"), F.lit(1).cast("bigint").alias("n"))
    return deltas.running_sequence(journal, ["user_id"], FP251, 11)


_STATE_HEX = f"'{ADDITIVE.header.hex()}' || {{}}"
_DELTA_HEX = f"""'{(codecs.DELTA + bytes([1, 0, codecs.DELTA_KINDS['additive'], 0]) + SPACE).hex()}' || {_le('7')} || {_le('8')} || {_le('rn + an')} || '{(ADDITIVE.ids + bytes([ADDITIVE.law])).hex()}' || {_frame('rh')} || {_frame('ah')}"""


@query(
    f"""WITH s AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS rn, coalesce(sum(o_custkey % 251) FILTER (WHERE o_orderkey % 3 = 0), 0)::BIGINT % 251 AS r,
    count(*) FILTER (WHERE o_orderkey % 3 = 1) AS an, coalesce(sum(o_custkey % 251) FILTER (WHERE o_orderkey % 3 = 1), 0)::BIGINT % 251 AS a FROM orders GROUP BY 1),
    h AS (SELECT *, '{ADDITIVE.header.hex()}' || {_le('rn')} || {_le('r', 1)} AS rh, '{ADDITIVE.header.hex()}' || {_le('an')} || {_le('a', 1)} AS ah FROM s)
    SELECT o_orderpriority, sha256(unhex('{(b"sigmafold-delta-v1" + bytes(1)).hex()}' || {_frame(f'({_DELTA_HEX})')})) AS delta_id FROM h"""
)
def delta_codec(spark, sf):
    """Ids of deltas that take a third of the orders out and put another third in."""
    e, rows = _e("o_custkey"), table(spark, sf, "orders")
    parts = {}
    for name, k in (("r", 0), ("a", 1)):
        mine = F.when(F.col("o_orderkey") % 3 == k, e)
        parts |= {f"{name}": laws.additive(FP251, mine), f"{name}n": F.count(mine)}
    s = rows.groupBy("o_orderpriority").agg(*[x.alias(n) for n, x in parts.items()])
    removed, added = (codecs.encode_state(ADDITIVE, [F.col(f"{n}n")], [F.col(n)]) for n in ("r", "a"))
    data = codecs.encode_delta("additive", ADDITIVE, SPACE, F.lit(7), F.col("rn") + F.col("an"), codecs.pair_payload(removed, added))
    return s.select("o_orderpriority", codecs.delta_id(data).alias("delta_id"))


@query("SELECT o_orderpriority, sum(o_custkey % 251)::BIGINT % 251 AS state, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def additive_delta_apply(spark, sf):
    """Two thirds of the orders, with one third taken out and another put in."""
    rows = table(spark, sf, "orders")
    state = lambda cond: laws.additive_signature(rows.where(cond), ["o_orderpriority"], _e("o_custkey"), FP251)
    return deltas.additive_delta(state("o_orderkey % 3 <> 1"), state("o_orderkey % 3 = 0"), state("o_orderkey % 3 = 1"), ["o_orderpriority"], FP251)


_SUFFIX = "l_linenumber > 2"


@query(f"SELECT l_orderkey, {fold_sql('list(l_partkey % 251 ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_linenumber <= 2)', 0, '(a * 11 + x) % 251')} AS trimmed, count(*) FILTER (WHERE l_linenumber <= 2) AS trimmed_n, {fold_sql('list(l_partkey % 251 ORDER BY l_linenumber, l_partkey)', 0, '(a * 11 + x) % 251')} AS whole, count(*) AS whole_n FROM lineitem GROUP BY 1")
def sequence_append_trim(spark, sf):
    """The lines of an order without those behind the second, and those put back."""
    rows = table(spark, sf, "lineitem").withColumn("head", ~F.expr(_SUFFIX))
    order = ["l_linenumber", "l_partkey"]
    whole = laws.sequence_signature(rows, ["l_orderkey"], order, _e("l_partkey"), FP251, [11])
    tail = laws.sequence_signature(rows.where(_SUFFIX), ["l_orderkey"], order, _e("l_partkey"), FP251, [11]).select("l_orderkey", F.col("state_0").alias("t"), F.col("n").alias("m"))
    s = whole.join(tail, "l_orderkey", "left").na.fill(0, ["t", "m"])
    trimmed, n = deltas.trimmed(FP251, F.col("state_0"), F.col("n"), F.col("t"), F.col("m"), 11)
    s = s.select("l_orderkey", trimmed.alias("trimmed"), n.alias("trimmed_n"), "t", "m")
    back, k = deltas.appended(FP251, F.col("trimmed"), F.col("trimmed_n"), F.col("t"), F.col("m"), 11)
    return s.select("l_orderkey", "trimmed", "trimmed_n", back.alias("whole"), k.alias("whole_n"))


@query("SELECT p_brand, p_size, count(*) AS multiplicity FROM part GROUP BY 1, 2")
def tracked_multiset_snapshot(spark, sf):
    """Tracked sizes of each brand to snapshot bytes and back, with the compact state made again from the entries."""
    rows = table(spark, sf, "part").select("p_brand", "p_size", F.lit(1).alias("sign"))
    items = deltas.tracked_multiset(rows, ["p_brand"], "p_size", F.col("sign")).withColumn("item", codecs.le(F.col("p_size")))
    states = laws.multiset_signature(rows, ["p_brand"], _e("p_size"), FP251, [17])
    compact = states.select("p_brand", codecs.encode_state(MULTISET, [F.col("n"), F.col("zeros_0")], [F.col("product_0")]).alias("state"))
    back = materialise(codecs.decode_snapshots(codecs.encode_snapshot(items, ["p_brand"], "multiset", compact, "item", "item"), ["p_brand"], "snapshot", "multiset"), "snapshot")
    size = F.conv(F.hex(F.substring("item", 1, 1)), 16, 10).cast("int")
    again = laws.multiset_signature(back.withColumn("p_size", size), ["p_brand"], _e("p_size"), FP251, [17], F.col("multiplicity"))
    again = again.select("p_brand", codecs.encode_state(MULTISET, [F.col("n"), F.col("zeros_0")], [F.col("product_0")]).alias("again"))
    same = F.when(F.col("state") == F.col("again"), size).otherwise(F.raise_error(F.lit("compact state mismatch")))
    return back.join(again, "p_brand").select("p_brand", same.cast("int").alias("p_size"), "multiplicity")


@query("SELECT user_id, event_id, CASE WHEN rn % 3 = 1 THEN rn // 3 ELSE rn // 3 + 1 END AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE rn % 3 = 1 OR rn % 3 = 2 AND rn = total")
def tracked_sequence_pushes(spark, sf):
    """What is left of each user's events when every third one takes the last away."""
    from pyspark.sql import Window

    rows = table(spark, sf, "events").select("user_id", "event_id").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return deltas.tracked_sequence(rows, ["user_id"], ["event_id"], F.col("rn") % 3 != 0).select("user_id", "event_id", "pos")


# --- encoders and wide fields --------------------------------------------------------------------------------------

LANES = encoders.HashLanes(FP251, bytes(range(32)), 3, 2)


def _lane_sql(lane: int) -> str:
    head = f"'{(LANES.DOMAIN + LANES.profile).hex()}' || {_le(str(LANES.channel))} || {_le(str(lane))} || {_frame('h')}"
    draws = [f"('0x' || substr(sha256(unhex({head} || {_le(str(a))} || {_le('0')})), 1, 2))::INT" for a in range(4)]
    return "CASE " + " ".join(f"WHEN {d} < 251 THEN {d}" for d in draws) + " END"


@query(f"SELECT c_custkey, {_lane_sql(0)}::BIGINT AS lane_0, {_lane_sql(1)}::BIGINT AS lane_1 FROM (SELECT c_custkey, lower(hex(encode(c_name))) AS h FROM customer)")
def encode_hash_lanes(spark, sf):
    made = encoders.elements(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", LANES, "lanes")
    return made.select("c_custkey", *[encoders.c_canonical(FP251, F.col("lanes")[k]).alias(f"lane_{k}") for k in range(2)])


_TAGGED = f"lower(hex(encode(p_brand))) || '01' || {_le('9')}"


@query(f"SELECT p_partkey, rpad({_TAGGED}, 64, '0')[1:32] AS polynomial, rpad(lower(hex(encode(p_brand))), 64, '0') AS linear FROM part WHERE length(p_brand) <= 7")
def encode_polynomials(spark, sf):
    """Short names as polynomials of degree below 128, and as one 32-byte piece."""
    rows = table(spark, sf, "part").where("length(p_brand) <= 7").select("p_partkey", "p_brand")
    one = encoders.elements(rows, "p_brand", encoders.dynamic("polynomial", GF2_128, tag=9), "a")
    two = encoders.elements(one, "p_brand", encoders.LinearChunks(), "b")
    return two.select("p_partkey", F.lower(F.hex(F.col("a")[0])).alias("polynomial"), F.lower(F.hex(F.col("b")[0])).alias("linear"))


_FOLD = "list_reduce(list_prepend(0::UHUGEINT, list(({x}) % {g} ORDER BY l_linenumber {o}, l_partkey {o})), lambda a, x: (a * 11 + x) % {g})::VARCHAR"
_GX = "l_partkey::UHUGEINT * 2654435761::UHUGEINT"


@query(f"SELECT l_orderkey, {_FOLD.format(x=_GX, g=_GOLD, o='')} AS forward, {_FOLD.format(x=_GX, g=_GOLD, o='DESC')} AS backward, count(*) AS n FROM lineitem GROUP BY 1")
def bidirectional_goldilocks_by_order(spark, sf):
    """Both ordered states over a 64-bit field, folded in ranges of key and order."""
    s = deltas.Builder(GOLDILOCKS).bidirectional(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], _goldilocks_bytes("l_partkey"), 11)
    return s.select("l_orderkey", _little_endian(F.col("states")[0]).alias("forward"), _little_endian(F.col("back")[0]).alias("backward"), "n")


@query(f"SELECT l_returnflag, {fold_sql('list(l_partkey % 251 ORDER BY l_orderkey, l_linenumber, l_partkey)', 0, '(a * 11 + x) % 251')} AS state_0, count(*) AS n FROM lineitem GROUP BY 1")
def sequence_of_hot_keys(spark, sf):
    """Three keys hold all rows: each is cut into parts by order, and the parts are concatenated."""
    return laws.sequence_signature_in_parts(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey"], _e("l_partkey"), FP251, [11], 64)


@query(f"SELECT c_mktsegment, (((sum(c_custkey * 2654435761::HUGEINT) - max(c_custkey) * 2654435761::HUGEINT))::UHUGEINT % {_GOLD})::VARCHAR AS rest FROM customer GROUP BY 1")
def residual_goldilocks(spark, sf):
    """The additive state over a 64-bit field without the item of the largest key."""
    rows = table(spark, sf, "customer")
    s = laws.fold_signature(rows, ["c_mktsegment"], _goldilocks_bytes("c_custkey"), GOLDILOCKS, "additive")
    last = rows.groupBy("c_mktsegment").agg(F.max("c_custkey").alias("c_custkey")).select("c_mktsegment", _goldilocks_bytes("c_custkey").alias("last"))
    joined = s.select("c_mktsegment", F.col("states")[0].alias("state"), "n").join(last, "c_mktsegment")
    return laws.residuals(joined, "state", "last", "n", GOLDILOCKS, "additive").select("c_mktsegment", _little_endian(F.col("rest")).alias("rest"))


# --- files under edit ----------------------------------------------------------------------------------------------------

_H = "lower(hex(encode(coalesce(text, ''))))"
_INSERTED = f"(substr({_H}, 1, 2 * least(3, length({_H}) // 2)) || '78797a' || substr({_H}, 2 * least(3, length({_H}) // 2) + 1))"


@query(f"SELECT doc_id, octets, sha256(unhex(h)) AS content_hash FROM (SELECT doc_id, length(h) // 2 - 1 AS octets, substr(h, 1, length(h) - 2) AS h FROM (SELECT doc_id, substr({_INSERTED}, 5) || '656e64' AS h FROM documents))")
def file_edits_export(spark, sf):
    """Insert, remove, append and truncate; the file is cut into pieces and put together again."""
    size = F.octet_length("content")
    files = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    files = files.withColumn("content", trees.insert(F.col("content"), F.least(F.lit(3), size), F.lit("xyz").cast("binary")))
    files = files.withColumn("content", trees.remove(F.col("content"), F.lit(0), F.lit(2)))
    files = files.withColumn("content", trees.append(F.col("content"), F.lit("end").cast("binary")))
    files = files.withColumn("content", trees.truncate(F.col("content"), size - 1))
    whole = trees.export(trees.binary_chunks(files, "doc_id", "content", 256), "doc_id")
    return whole.select("doc_id", size.cast("bigint").alias("octets"), F.sha2("content", 256).alias("content_hash"))


_CHUNK_E = "(('0x' || substr(md5(substr(text, idx * 256 + 1, 256)), 1, 8))::BIGINT % 251)"


@query(
    f"""SELECT d.doc_id, 5::BIGINT AS revision, sha256(encode(d.text)) AS content_hash, state FROM documents d JOIN
    (SELECT doc_id, {fold_sql(f'list({_CHUNK_E} ORDER BY idx)', 0, '(a * 11 + x) % 251')} AS state FROM (SELECT doc_id, unnest(range(0, (length(text) + 255) // 256)) AS idx, text FROM documents) GROUP BY 1) s USING (doc_id)"""
)
def tree_checkpoint(spark, sf):
    """Checkpoints to bytes and back; the root is compared with that of a tree built again from the content."""
    from sigmafold.plans.change_queries import _tree_of

    profile = codecs.namespace_of(b"chunks of 256")
    files = table(spark, sf, "documents").where("text <> ''").select("doc_id", "text")
    roots = trees.roots(_tree_of(files), "doc_id").select("doc_id", F.col("state").alias("root"))
    coded = files.join(roots, "doc_id").select("doc_id", codecs.encode_checkpoint(profile, F.lit(5), codecs.le(F.col("root"), 1), F.col("text").cast("binary")).alias("b"))
    back = materialise(coded.select("doc_id", codecs.decode_checkpoint(F.col("b"), profile).alias("c")).select("doc_id", "c.*"), "checkpoint")
    again = trees.roots(_tree_of(back.select("doc_id", F.col("content").cast("string").alias("text"))), "doc_id")
    again = again.select("doc_id", codecs.le(F.col("state"), 1).alias("root_again"))
    checked = trees.verify_checkpoint(back, "doc_id", again)
    return checked.select("doc_id", "revision", F.sha2("content", 256).alias("content_hash"), F.conv(F.hex("root"), 16, 10).cast("bigint").alias("state"))
