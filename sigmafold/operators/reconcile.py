"""Set reconciliation: find the few elements in which two sets differ from fixed-size sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmafold.functions.fields import FP251, PrimeField
from sigmafold.operators import laws


def points(universe: int, most: int, field: PrimeField = FP251) -> list[int]:
    """Evaluation points outside the universe 0..universe-1, one per possible difference."""
    if not 1 <= universe <= 200 or universe + 17 + most >= field.p:
        raise ValueError("the universe and the difference must leave room for points in the field")
    return [universe + 17 + i for i in range(most)]


def sketch(df: DataFrame, keys: list[str], value: Column, universe: int, most: int, field: PrimeField = FP251) -> DataFrame:
    """keys, n, and evals: the products of (point - value) over distinct values; no factor is zero, as points lie outside."""
    rows = df.select(*keys, value.alias("__v")).distinct()
    products = [laws.multiset_product(field, F.pmod(F.lit(x) - F.col("__v"), F.lit(field.p))) for x in points(universe, most, field)]
    return rows.groupBy(*keys).agg(F.array(*products).alias("evals"), F.count(F.lit(1)).alias("n"))


def _solve(rows: list[list[int]], p: int) -> list[int] | None:
    """One solution of a linear system given as rows with the right side last; None if there is none."""
    rows, width, pivots = [r[:] for r in rows], len(rows[0]) - 1, []
    at = 0
    for column in range(width):
        k = next((i for i in range(at, len(rows)) if rows[i][column] % p), None)
        if k is None:
            continue
        rows[at], rows[k] = rows[k], rows[at]
        scale = pow(rows[at][column], -1, p)
        rows[at] = [x * scale % p for x in rows[at]]
        for i, r in enumerate(rows):
            if i != at and r[column]:
                rows[i] = [(x - r[column] * y) % p for x, y in zip(r, rows[at])]
        pivots.append(column)
        at += 1
    if any(r[-1] % p for r in rows[at:]):
        return None
    out = [0] * width
    for i, column in enumerate(pivots):
        out[column] = rows[i][-1]
    return out


def reconcile(left: list[int], n_left: int, right: list[int], n_right: int, universe: int, most: int, field: PrimeField = FP251) -> tuple[set[int], set[int]] | None:
    """(only left, only right), or None if no difference of at most ``most`` explains both sketches.

    For each total difference and split that fits the counts, the ratio of the characteristic
    polynomials is interpolated; a solution counts only if its roots lie in the universe, are
    distinct, and every equation holds.
    """
    p, xs = field.p, points(universe, most, field)
    ratio = [a * pow(b, -1, p) % p for a, b in zip(left, right)]
    for total in range(most + 1):
        a, odd = divmod(total + n_left - n_right, 2)
        b = total - a
        if odd or a < 0 or b < 0:
            continue
        # P monic of degree a, Q monic of degree b, P(x) = ratio * Q(x) at every point.
        system = []
        for x, r in zip(xs, ratio):
            powers = [pow(x, k, p) for k in range(max(a, b) + 1)]
            system.append([*powers[:a], *[-r * q % p for q in powers[:b]], (r * powers[b] - powers[a]) % p])
        found = _solve(system, p) if total else [] if all(r == 1 for r in ratio) else None
        if found is None:
            continue
        roots = []
        for coefficients, degree in ((found[:a], a), (found[a:], b)):
            roots.append({v for v in range(universe) if (sum(c * pow(v, k, p) for k, c in enumerate(coefficients)) + pow(v, degree, p)) % p == 0} if degree else set())
        only_left, only_right = roots
        if len(only_left) != a or len(only_right) != b or only_left & only_right:
            continue
        good = True
        for x, r in zip(xs, ratio):
            top = bottom = 1
            for v in only_left:
                top = top * (x - v) % p
            for v in only_right:
                bottom = bottom * (x - v) % p
            good &= top == r * bottom % p
        if good:
            return only_left, only_right
    return None


def reconcile_pairs(sketches: DataFrame, universe: int, most: int) -> DataFrame:
    """pair_id, side, value of every pair of sketches (pair_id, left, n_left, right, n_right); an unexplained pair has side 'rejected'."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found = reconcile(r["left"], r["n_left"], r["right"], r["n_right"], universe, most)
                if found is None:
                    out.append((r["pair_id"], "rejected", None))
                else:
                    out += [(r["pair_id"], side, v) for side, values in zip(("left", "right"), found) for v in sorted(values)]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64()))], names=["pair_id", "side", "value"])

    return sketches.select("pair_id", "left", "n_left", "right", "n_right").mapInArrow(run, "pair_id bigint, side string, value bigint")


def symmetric_difference(df: DataFrame, item: str) -> DataFrame:
    """Items with an odd count."""
    return df.groupBy(item).agg(F.count(F.lit(1)).alias("__n")).where("__n % 2 = 1").select(item)
