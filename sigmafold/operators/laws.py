"""Mergeable signatures of collections: additive, sequence, bidirectional, multiset, and their multi-point forms.

A signature is a row.  Over small primes every law is a native aggregate with a map-side part; over
wide fields each partition folds its own items and the few partial states are folded again.  Counters
belong to a state, and states of different contexts don't merge.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sigmafold.functions.fields import BinaryField, PrimeField

#: Numbers of the laws.
LAWS = {"additive": 1, "sequence": 2, "multiset": 3, "bidirectional": 4, "multi_multiset": 5, "multi_sequence": 6}


def context_id(field, encoder: str, law: str, parameters: list[int]) -> str:
    """Identity of field, encoder, law and parameters; states merge only if it is equal."""
    name = f"p:{field.p}" if isinstance(field, PrimeField) else f"2:{field.m}:{field.tail}"
    return hashlib.sha256(f"{name}|{encoder}|{LAWS[law]}|{len(parameters)}|{parameters}".encode()).hexdigest()


# --- native aggregates over small primes ---------------------------------------------------------


def additive(field: PrimeField, e: Column) -> Column:
    return F.pmod(F.coalesce(F.sum(e), F.lit(0)), F.lit(field.p))


def factor(field: PrimeField, e: Column, offset: int) -> Column:
    return F.pmod(e + F.lit(offset), F.lit(field.p))


def multiset_product(field: PrimeField, f: Column, multiplicity: Column | None = None) -> Column:
    """Product of the non-zero factors, by adding logarithms; ``multiplicity`` may be negative to take items out."""
    log = field.c_log(f)
    if multiplicity is not None:
        log = F.pmod(multiplicity, F.lit(field.p - 1)) * log
    return field.c_exp(F.coalesce(F.sum(log), F.lit(0)))


def multiset_zeros(f: Column, multiplicity: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.when(f == 0, F.lit(1) if multiplicity is None else multiplicity)), F.lit(0)).cast("bigint")


def evaluated(product: Column, zeros: Column) -> Column:
    """The product with its zero factors."""
    return F.when(zeros > 0, F.lit(0)).otherwise(product)


def weighted(field: PrimeField, e: Column, base: int, exponent: Column) -> Column:
    """Sum of e * base ** exponent: with the places from the end this is the Horner state of a sequence."""
    return F.pmod(F.coalesce(F.sum(field.c_mul(e, field.c_power(base, exponent))), F.lit(0)), F.lit(field.p))


def check_base(base: int) -> int:
    if base in (0, 1):
        raise ValueError("a base must not be 0 or 1")
    return base


def check_points(points: list[int]) -> list[int]:
    if len(set(points)) != len(points) or not points:
        raise ValueError("points must be distinct, and one at least")
    return points


def additive_signature(df: DataFrame, keys: list[str], e: Column, field: PrimeField) -> DataFrame:
    return df.groupBy(*keys).agg(additive(field, e).alias("state"), F.count(F.lit(1)).alias("n"))


def multiset_signature(df: DataFrame, keys: list[str], e: Column, field: PrimeField, offsets: list[int], multiplicity: Column | None = None) -> DataFrame:
    """keys, n, and product_k and zeros_k for each offset."""
    aggregates = []
    for k, offset in enumerate(check_points(offsets)):
        f = factor(field, e, offset)
        aggregates += [multiset_product(field, f, multiplicity).alias(f"product_{k}"), multiset_zeros(f, multiplicity).alias(f"zeros_{k}")]
    n = F.count(F.lit(1)) if multiplicity is None else F.sum(multiplicity)
    return df.groupBy(*keys).agg(*aggregates, n.alias("n"))


def positions(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Adds __at (0 first) and __left (items after this one).  Without an order there is no sequence."""
    if not order_by:
        raise ValueError("a sequence needs order_by")
    w = Window.partitionBy(*keys)
    numbered = df.withColumn("__at", (F.row_number().over(w.orderBy(*order_by)) - 1).cast("bigint"))
    return numbered.withColumn("__left", F.count(F.lit(1)).over(w) - F.lit(1) - F.col("__at"))


def sequence_signature(df: DataFrame, keys: list[str], order_by: list[str], e: Column, field: PrimeField, bases: list[int]) -> DataFrame:
    """keys, n, and state_k for each base: s <- s * base + e in the given order."""
    placed = positions(df.withColumn("__e", e), keys, order_by)
    states = [weighted(field, F.col("__e"), check_base(b), F.col("__left")).alias(f"state_{k}") for k, b in enumerate(check_points(bases))]
    return placed.groupBy(*keys).agg(*states, F.count(F.lit(1)).alias("n"))


def bidirectional_signature(df: DataFrame, keys: list[str], order_by: list[str], e: Column, field: PrimeField, base: int) -> DataFrame:
    """keys, n, forward and backward Horner states, and base ** n."""
    placed = positions(df.withColumn("__e", e), keys, order_by)
    forward = weighted(field, F.col("__e"), check_base(base), F.col("__left"))
    backward = weighted(field, F.col("__e"), base, F.col("__at"))
    return placed.groupBy(*keys).agg(forward.alias("forward"), backward.alias("backward"), field.c_power(base, F.count(F.lit(1))).alias("power"), F.count(F.lit(1)).alias("n"))


# --- merging and taking apart states --------------------------------------------------------------


def merge_additive(states: DataFrame, keys: list[str], field: PrimeField) -> DataFrame:
    return states.groupBy(*keys).agg(additive(field, F.col("state")).alias("state"), F.sum("n").alias("n"))


def merge_multiset(states: DataFrame, keys: list[str], field: PrimeField, points: int) -> DataFrame:
    """Products multiply (a state's product is never zero), counters add."""
    out = []
    for k in range(points):
        out += [multiset_product(field, F.col(f"product_{k}")).alias(f"product_{k}"), F.sum(f"zeros_{k}").alias(f"zeros_{k}")]
    return states.groupBy(*keys).agg(*out, F.sum("n").alias("n"))


def merge_sequence(states: DataFrame, keys: list[str], order_by: list[str], field: PrimeField, bases: list[int]) -> DataFrame:
    """Concatenate partial sequences in order: each is moved by the length of all behind it."""
    behind = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(1, Window.unboundedFollowing)
    moved = states.withColumn("__left", F.coalesce(F.sum("n").over(behind), F.lit(0)))
    return moved.groupBy(*keys).agg(
        *[weighted(field, F.col(f"state_{k}"), b, F.col("__left")).alias(f"state_{k}") for k, b in enumerate(bases)], F.sum("n").alias("n")
    )


def sequence_residual(field: PrimeField, state: Column, last: Column, base: int) -> Column:
    """The state before ``last`` was pushed, assuming it was: (s - e) / base."""
    return field.c_mul(F.pmod(state - last, F.lit(field.p)), F.lit(field.inverse(base)))


def sequence_trim(field: PrimeField, state: Column, suffix: Column, length: Column, base: int) -> Column:
    """The state without a suffix of known state and length."""
    return field.c_mul(F.pmod(state - suffix, F.lit(field.p)), field.c_power(base, -length))


def multiset_residual(field: PrimeField, product: Column, zeros: Column, f: Column) -> tuple[Column, Column]:
    """Product and zero count without one factor, assuming it was there.  Taking out an absent zero raises."""
    less = F.when((f == 0) & (zeros == 0), F.raise_error(F.lit("item absent"))).when(f == 0, zeros - 1).otherwise(zeros)
    return F.when(f == 0, product).otherwise(field.c_mul(product, field.c_inverse(f))), less


def bidirectional_residual(field: PrimeField, forward: Column, backward: Column, last: Column, n: Column, base: int) -> tuple[Column, Column]:
    """Both states before ``last`` was pushed."""
    return sequence_residual(field, forward, last, base), F.pmod(backward - field.c_mul(last, field.c_power(base, n - 1)), F.lit(field.p))


def sequence_signature_in_parts(df: DataFrame, keys: list[str], order_by: list[str], e: Column, field: PrimeField, bases: list[int], parts: int = 256) -> DataFrame:
    """``sequence_signature`` where one key may hold most rows: no task sees all rows of a key.

    The first order column (a number) is cut at its quantiles; each part of a key is a sequence of its
    own, and the few parts are concatenated.  Equal order values stay in one part.
    """
    first = F.col(order_by[0]).cast("double")
    bounds = df.agg(F.percentile_approx(first, [k / parts for k in range(1, parts)], 10 * parts)).first()[0]
    bounds = sorted(set(bounds or []))
    part = F.lit(0)
    if bounds:
        table = F.array(*[F.lit(float(b)) for b in bounds])
        part = F.size(F.filter(table, lambda b: b < first))
    # Nulls come first in an order, and here too.
    partial = sequence_signature(df.withColumn("__part", F.when(first.isNull(), -1).otherwise(part)), [*keys, "__part"], order_by, e, field, bases)
    return merge_sequence(partial, keys, ["__part"], field, bases)


# --- any field: fold in each partition, then fold the partial states --------------------------------

#: States that a partition of a fold holds at once.
HELD = 50_000


def fold_signature(df: DataFrame, keys: list[str], element: Column, field, law: str, parameters: list[int] = ()) -> DataFrame:
    """keys, n, and states and zeros as arrays of canonical bytes and counts, for the additive and multiset laws over any field.

    ``element`` is a binary column of canonical elements.  Each partition folds its own rows in one
    pass, holding at most HELD states, which then go on as partial ones; those are folded by key.
    """
    if law not in ("additive", "multiset", "multi_multiset"):
        raise ValueError(f"no unordered fold for the law {law}")
    points = [0] if law == "additive" else check_points(list(parameters))
    rows = df.select(*keys, element.alias("__e"))
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__e").schema)
    schema = f"{key_schema}, states array<binary>, zeros array<bigint>, n bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    width, combine = len(keys), field.add if law == "additive" else field.mul
    start = field.zero if law == "additive" else field.one

    def pack(found):
        import pyarrow as pa

        table = {k: [key[i] for key in found] for i, k in enumerate(keys)}
        table["states"] = [[field.to_bytes(s) for s in states] for states, _, _ in found.values()]
        table["zeros"] = [zeros for _, zeros, _ in found.values()]
        table["n"] = [n for _, _, n in found.values()]
        return pa.table(table)

    def fold(batches):
        found: dict = {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                key, e = row[:width], field.from_bytes(row[width])
                state = found.setdefault(key, [[start] * len(points), [0] * len(points), 0])
                for k, point in enumerate(points):
                    x = e if law == "additive" else field.add(e, point)
                    if law != "additive" and x == field.zero:
                        state[1][k] += 1
                    else:
                        state[0][k] = combine(state[0][k], x)
                state[2] += 1
            if len(found) > HELD:
                yield from pack(found).cast(arrow).to_batches()
                found.clear()
        if found:
            yield from pack(found).cast(arrow).to_batches()

    def merge(table):
        states, zeros, n = [start] * len(points), [0] * len(points), 0
        for s, z, m in zip(*(table.column(c).to_pylist() for c in ("states", "zeros", "n"))):
            states = [combine(a, field.from_bytes(b)) for a, b in zip(states, s)]
            zeros = [a + b for a, b in zip(zeros, z)]
            n += m
        key = tuple(table.column(k)[0].as_py() for k in keys)
        return pack({key: (states, zeros, n)}).cast(arrow)

    return rows.mapInArrow(fold, schema).groupBy(*keys).applyInArrow(merge, schema)


def fold_sequence(df: DataFrame, keys: list[str], order_by: list[str], element: Column, field, bases: list[int], backward: bool = False) -> DataFrame:
    """keys, n and states (canonical bytes, one per base) of the ordered laws over any field; ``backward`` adds the states from the other end.

    Rows are sorted into ranges of key and order, so a hot key is spread; each range folds its own run
    of a key, and the runs of a key are concatenated in the order of the ranges.
    """
    if not order_by:
        raise ValueError("a sequence needs order_by")
    for b in check_points(bases):
        check_base(b)
    placed = df.select(*[F.col(k) for k in keys], *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order_by)], element.alias("__e"))
    order = [*keys, *[f"__o{i}" for i in range(len(order_by))]]
    rows = placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*keys, "__e")
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__e").schema)
    partial_schema = f"{key_schema}, part int, states array<binary>, back array<binary>, n bigint"
    schema = f"{key_schema}, states array<binary>{', back array<binary>' if backward else ''}, n bigint"
    partial, final, width = to_arrow_schema(StructType.fromDDL(partial_schema)), to_arrow_schema(StructType.fromDDL(schema)), len(keys)

    def fold(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, key, states, back, powers, n, out = TaskContext.get().partitionId(), None, [], [], [], 0, []

        def emit():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, partial)], schema=partial)

        def close():
            if key is not None:
                out.append((*key, part, [field.to_bytes(s) for s in states], [field.to_bytes(s) for s in back], n))

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:width] != key:
                    close()
                    key, states, back, powers, n = row[:width], [field.zero] * len(bases), [field.zero] * len(bases), [field.one] * len(bases), 0
                e = field.from_bytes(row[width])
                states = [field.add(field.mul(s, b), e) for s, b in zip(states, bases)]
                back = [field.add(s, field.mul(e, q)) for s, q in zip(back, powers)]
                powers, n = [field.mul(q, b) for q, b in zip(powers, bases)], n + 1
            if len(out) > HELD:
                yield emit()
                out = []
        close()
        if out:
            yield emit()

    def merge(table):
        import pyarrow as pa

        states, back, n = [field.zero] * len(bases), [field.zero] * len(bases), 0
        for _, s, r, m in sorted(zip(*(table.column(c).to_pylist() for c in ("part", "states", "back", "n"))), key=lambda x: x[0]):
            back = [field.add(a, field.mul(field.from_bytes(x), field.power(b, n))) for a, x, b in zip(back, r, bases)]
            states = [field.add(field.mul(a, field.power(b, m)), field.from_bytes(x)) for a, x, b in zip(states, s, bases)]
            n += m
        found = [*[table.column(k)[0].as_py() for k in keys], [field.to_bytes(s) for s in states], *([[field.to_bytes(s) for s in back]] if backward else []), n]
        return pa.table([pa.array([v], f.type) for v, f in zip(found, final)], schema=final)

    return rows.mapInArrow(fold, partial_schema).groupBy(*keys).applyInArrow(merge, schema)


def residuals(df: DataFrame, state: str, element: str, n: str, field, law: str, parameter: int = 0, zeros: str | None = None) -> DataFrame:
    """``df`` with rest (and rest_zeros for the multiset law): the state over any field (canonical bytes) without one item.

    The item is assumed to be there, last in a sequence; taking out of an empty state, or a zero factor
    that isn't counted, raises.
    """
    schema = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", rest binary, rest_zeros bigint")
    arrow, names = to_arrow_schema(schema), df.columns

    def one(s, e, n_items, z):
        if n_items < 1:
            raise ValueError("item absent")
        if law == "additive":
            return field.sub(s, e), z
        if law == "sequence":
            return field.mul(field.sub(s, e), field.inverse(parameter)), z
        f = field.add(e, parameter)
        if f == field.zero:
            if not z:
                raise ValueError("item absent")
            return s, z - 1
        return field.mul(s, field.inverse(f)), z

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = {c: batch.column(k).to_pylist() for k, c in enumerate(names)}
            counts = columns[zeros] if zeros else [0] * batch.num_rows
            found = [one(field.from_bytes(s), field.from_bytes(e), m, z) for s, e, m, z in zip(columns[state], columns[element], columns[n], counts)]
            rest = [pa.array([field.to_bytes(s) for s, _ in found], pa.binary()), pa.array([z for _, z in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).cast(arrow.field(k).type) for k in range(len(names))], *[x.cast(arrow.field(len(names) + k).type) for k, x in enumerate(rest)]], schema=arrow)

    return df.mapInArrow(run, schema)


def xor_signature(df: DataFrame, keys: list[str], element: Column, field: BinaryField) -> DataFrame:
    """The additive law over GF(2**m), natively: exclusive or of 64-bit limbs, low limb first."""
    limbs = -(-field.m // 64)
    parts = []
    for k in range(limbs):
        digits = F.concat(*[F.hex(F.substring(element, 8 * k + 8 - i, 1)) for i in range(8)])
        high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint")
        parts.append(F.bit_xor(F.shiftleft(high, 32).bitwiseOR(low)).alias(f"limb_{k}"))
    return df.groupBy(*keys).agg(*parts, F.count(F.lit(1)).alias("n"))


# --- scans ----------------------------------------------------------------------------------------


def product_scan(df: DataFrame, keys: list[str], order_by: list[str], e: Column, field: PrimeField, out: str, suffix: bool = False, exclusive: bool = False) -> DataFrame:
    """Running product of elements with zeros, from the first row on or (``suffix``) from the last."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    if suffix:
        w = w.rowsBetween(1 if exclusive else 0, Window.unboundedFollowing)
    else:
        w = w.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    logs = F.coalesce(F.sum(field.c_log(e)).over(w), F.lit(0))
    zeros = F.coalesce(F.sum(F.when(e == 0, 1).otherwise(0)).over(w), F.lit(0))
    return df.withColumn(out, evaluated(field.c_exp(logs), zeros))


def sequence_scan(df: DataFrame, keys: list[str], order_by: list[str], e: Column, field: PrimeField, base: int, out: str) -> DataFrame:
    """The Horner state after each row: one running sum of e / base ** place, times base ** place."""
    placed = positions(df.withColumn("__e", e), keys, order_by)
    w = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.sum(field.c_mul(F.col("__e"), field.c_power(check_base(base), -F.col("__at")))).over(w)
    return placed.withColumn(out, field.c_mul(F.pmod(scaled, F.lit(field.p)), field.c_power(base, F.col("__at")))).drop("__e", "__at", "__left")
