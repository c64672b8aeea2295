"""Transactions and logs in parts: the same bytes as whole ones, without their limits, and nothing that isn't whole is read."""

import pytest
from pyspark.sql import functions as F

from sigmafold.operators import codecs, tables

SPACE = codecs.namespace_of(b"tests")
SCHEMA = tables.TableSchema((("k", "i64"), ("x", "text")), ("k",))


def test_parts_are_the_bytes_of_whole_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(codecs, "PART_BYTES", 300)
    base = spark.range(60).select((F.col("id") % 3).alias("source_revision"), F.col("id").alias("seq"), F.lit("insert").alias("op"), *[F.lit(None).cast(t).alias(f"before_{n}") for n, t in (("version", "bigint"), ("k", "bigint"), ("x", "string"))])
    rows = base.select("*", F.lit(1).cast("bigint").alias("after_version"), (F.col("seq") - 30).alias("after_k"), F.concat(F.lit("é"), F.col("seq")).alias("after_x"))
    few = codecs.Limits(mutations=10)
    with pytest.raises(Exception, match="limit of mutations"):
        codecs.encode_transactions(rows, SCHEMA, SPACE, few).collect()
    whole = {r.source_revision: r for r in codecs.encode_transactions(rows, SCHEMA, SPACE).collect()}
    parts = codecs.encode_transaction_parts(rows, SCHEMA, SPACE)
    found = sorted(parts.collect(), key=lambda r: (r.source_revision, r.part))
    assert len(found) > 6 and {s: b"".join(bytes(r.bytes) for r in found if r.source_revision == s) for s in range(3)} == {s: bytes(r.transaction) for s, r in whole.items()}
    assert {r.source_revision: (r.mutations, r.transaction_id) for r in codecs.transaction_ids(parts).collect()} == {s: (20, r.transaction_id) for s, r in whole.items()}
    again = codecs.decode_transactions(spark.createDataFrame([(r.transaction,) for r in whole.values()], "transaction binary"), "transaction", SCHEMA, SPACE)
    assert sorted(map(str, codecs.decode_transaction_parts(parts, SCHEMA, SPACE).collect())) == sorted(map(str, again.collect()))
    for bad in (parts.where("part <> 2 or source_revision <> 1"), parts.where("part > 0"), parts.unionByName(parts.where("part = 1"))):
        with pytest.raises(codecs.WireError):
            codecs.decode_transaction_parts(bad, SCHEMA, SPACE)
    log = codecs.encode_log_parts(parts)
    want = bytes(codecs.encode_log(spark.createDataFrame(list(whole.values()))).first().log)
    assert b"".join(bytes(r.bytes) for r in sorted(log.collect(), key=lambda r: (r.position, r.part))) == want
    assert codecs.decode_log_parts(log).count() == len(found)
    for bad in (log.where("position <> 1"), log.where("position <> 1 or part <> 1"), log.where("position >= 0")):
        with pytest.raises(codecs.WireError):
            codecs.decode_log_parts(bad)
    store = tables.RevisionedTable(spark, str(tmp_path / "t"), SCHEMA, SPACE, codecs.IN_PARTS)
    store.create(spark.createDataFrame([], "version bigint, k bigint, x string"))
    assert (store.replay(parts), store.replay(parts), store.rows().count()) == (tables.Report(3, 0, 3), tables.Report(0, 3, 3), 60)
