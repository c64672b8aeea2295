"""Changes of signatures: deltas, journals, tracked collections, and what equality of states may claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmafold.functions.fields import PrimeField
from sigmafold.operators import laws



def additive_delta(states: DataFrame, removed: DataFrame, added: DataFrame, keys: list[str], field: PrimeField) -> DataFrame:
    """keys, state, n: states without what was removed and with what was added; removing more items than there are raises."""
    signed = states.select(*keys, "state", "n")
    signed = signed.unionByName(removed.select(*keys, (-F.col("state")).alias("state"), (-F.col("n")).alias("n"))).unionByName(added.select(*keys, "state", "n"))
    sums = signed.groupBy(*keys).agg(laws.additive(field, F.col("state")).alias("state"), F.sum("n").alias("n"))
    return sums.select(*keys, "state", F.when(F.col("n") < 0, F.raise_error(F.lit("item absent"))).otherwise(F.col("n")).alias("n"))


def appended(field: PrimeField, state: Column, n: Column, suffix: Column, suffix_n: Column, base: int) -> tuple[Column, Column]:
    """State and length of a sequence with a suffix behind it."""
    return F.pmod(field.c_mul(state, field.c_power(laws.check_base(base), suffix_n)) + suffix, F.lit(field.p)), n + suffix_n


def trimmed(field: PrimeField, state: Column, n: Column, suffix: Column, suffix_n: Column, base: int) -> tuple[Column, Column]:
    """State and length of a sequence without a suffix; a suffix that is longer raises, and so does an empty rest with a state."""
    rest = laws.sequence_trim(field, state, suffix, suffix_n, base)
    bad = (suffix_n > n) | ((suffix_n == n) & (rest != 0))
    return F.when(bad, F.raise_error(F.lit("not a suffix"))).otherwise(rest), n - suffix_n


def check_journal(journal: DataFrame, keys: list[str], revision: str = "source_revision", delta_id: str = "delta_id", context: str | None = None) -> None:
    """Raise on a gap, a reorder, a repeated delta, or (with ``context``) a change of identity within the journal of a key."""
    order = Window.partitionBy(*keys).orderBy(revision)
    gap = F.col(revision) - F.lag(revision).over(order) != 1
    bad = journal.select(*keys, revision, gap.alias("gap")).where("gap").limit(1).collect()
    if bad:
        raise ValueError(f"revision gap or reorder: {bad[0].asDict()}")
    names = [F.count(F.lit(1)) != F.count_distinct(F.col(delta_id))]
    if context:
        names.append(F.count_distinct(F.col(context)) > 1)
    wrong = journal.groupBy(*keys).agg(names[0].alias("again"), (names[1] if context else F.lit(False)).alias("drift")).where("again or drift").limit(1).collect()
    if wrong:
        raise ValueError(f"duplicate delta or identity drift: {wrong[0].asDict()}")


def running_additive(journal: DataFrame, keys: list[str], field: PrimeField, revision: str = "source_revision") -> DataFrame:
    """keys, revision (after the entry), state, n of a journal with removed, removed_n, added, added_n, from empty."""
    past = Window.partitionBy(*keys).orderBy(revision).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.col("added_n") - F.col("removed_n")).over(past)
    state = F.pmod(F.sum(F.col("added") - F.col("removed")).over(past), F.lit(field.p))
    return journal.select(*keys, (F.col(revision) + 1).alias("revision"), state.alias("state"), F.when(n < 0, F.raise_error(F.lit("item absent"))).otherwise(n).alias("n"))


def running_multiset(journal: DataFrame, keys: list[str], field: PrimeField, revision: str = "source_revision") -> DataFrame:
    """keys, revision, product, zeros, n of a journal with product, zeros and n of what was removed_ and added_."""
    past = Window.partitionBy(*keys).orderBy(revision).rowsBetween(Window.unboundedPreceding, 0)
    product = field.c_exp(F.sum(field.c_log(F.col("added_product")) - field.c_log(F.col("removed_product"))).over(past))
    zeros, n = (F.sum(F.col(f"added_{c}") - F.col(f"removed_{c}")).over(past) for c in ("zeros", "n"))
    checked = F.when((n < 0) | (zeros < 0), F.raise_error(F.lit("item absent"))).otherwise(n)
    return journal.select(*keys, (F.col(revision) + 1).alias("revision"), product.alias("product"), zeros.alias("zeros"), checked.alias("n"))


def running_sequence(journal: DataFrame, keys: list[str], field: PrimeField, base: int, revision: str = "source_revision") -> DataFrame:
    """keys, revision, state, n of a journal of appended suffixes (state, n): one running sum of each over base ** length."""
    past = Window.partitionBy(*keys).orderBy(revision).rowsBetween(Window.unboundedPreceding, 0)
    placed = journal.withColumn("__n", F.sum("n").over(past))
    scaled = F.sum(field.c_mul(F.col("state"), field.c_power(laws.check_base(base), -F.col("__n")))).over(past)
    return placed.select(*keys, (F.col(revision) + 1).alias("revision"), field.c_mul(F.pmod(scaled, F.lit(field.p)), field.c_power(base, F.col("__n"))).alias("state"), F.col("__n").alias("n"))


def tracked_multiset(changes: DataFrame, keys: list[str], item: str, sign: Column) -> DataFrame:
    """keys, item, multiplicity above zero; more removals of an item than insertions raise."""
    total = F.sum(sign)
    counts = changes.groupBy(*keys, item).agg(F.when(total < 0, F.raise_error(F.lit("item absent"))).otherwise(total).alias("multiplicity"))
    return counts.where("multiplicity <> 0")


def tracked_sequence(changes: DataFrame, keys: list[str], order_by: list[str], push: Column) -> DataFrame:
    """The rows whose push was not popped, with ``pos``; other rows pop the last one, and popping nothing raises.

    A push at some depth stays if the depth never falls below it afterwards.
    """
    line = Window.partitionBy(*keys).orderBy(*order_by)
    depth = F.sum(F.when(F.col("__push"), 1).otherwise(-1)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = changes.withColumn("__push", push).withColumn("__depth", depth)
    rows = rows.withColumn("__depth", F.when(F.col("__depth") < 0, F.raise_error(F.lit("sequence is empty"))).otherwise(F.col("__depth")))
    later = F.min("__depth").over(line.rowsBetween(1, Window.unboundedFollowing))
    left = rows.withColumn("__later", later).where(F.col("__push") & (F.col("__later").isNull() | (F.col("__later") >= F.col("__depth"))))
    return left.withColumn("pos", (F.col("__depth") - 1).cast("bigint")).drop("__push", "__depth", "__later")


# --- claims and construction ----------------------------------------------------------------------------------


def assurance(law: str, points: int = 1, tracked: bool = False) -> tuple[str, int | None]:
    """What equal states prove: (fingerprint, None), (bounded_exact, most items) or (exact_tracked, None).

    States at ``points`` different points determine up to so many encoded items; never the items'
    bytes, unless those are tracked.
    """
    if law not in laws.LAWS:
        raise ValueError(f"laws are {', '.join(laws.LAWS)}")
    if tracked:
        return "exact_tracked", None
    return ("bounded_exact", points) if law.startswith("multi_") else ("fingerprint", None)


def covers(claim: tuple[str, int | None], n: Column) -> Column:
    """Whether the claim proves equality of ``n`` encoded items."""
    kind, most = claim
    return F.lit(kind == "exact_tracked") if most is None else n <= most


class Builder:
    """Signatures of one field: a method for each law.  Small primes run natively, other fields fold (elements as binaries)."""

    def __init__(self, field):
        self.field, self.native = field, getattr(field, "native", False)

    def additive(self, df, keys, e):
        return laws.additive_signature(df, keys, e, self.field) if self.native else laws.fold_signature(df, keys, e, self.field, "additive")

    def multiset(self, df, keys, e, offset):
        return self.multi_multiset(df, keys, e, [offset])

    def multi_multiset(self, df, keys, e, offsets):
        return laws.multiset_signature(df, keys, e, self.field, offsets) if self.native else laws.fold_signature(df, keys, e, self.field, "multi_multiset", offsets)

    def sequence(self, df, keys, order_by, e, base):
        return self.multi_sequence(df, keys, order_by, e, [base])

    def multi_sequence(self, df, keys, order_by, e, bases):
        return laws.sequence_signature(df, keys, order_by, e, self.field, bases) if self.native else laws.fold_sequence(df, keys, order_by, e, self.field, bases)

    def bidirectional(self, df, keys, order_by, e, base):
        return laws.bidirectional_signature(df, keys, order_by, e, self.field, base) if self.native else laws.fold_sequence(df, keys, order_by, e, self.field, [base], backward=True)
