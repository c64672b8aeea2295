"""Encoders from bytes to field elements, and columns of their elements as canonical bytes."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmafold.functions.fields import GF2_256, BinaryField, PrimeField, framed

#: Bytes of an item, and draws of one element, at most.
MOST_BYTES = 16 << 20
MOST_ATTEMPTS = 4096


class Encoder:
    """A user's row as elements: ``lanes`` of them, made by ``encode``.  ``name`` is part of a state's identity.

    This is the hook for encoders of one's own; ``elements`` runs any of them over a column.
    """

    field: object
    lanes = 1
    most_bytes = MOST_BYTES

    @property
    def name(self) -> str:
        raise NotImplementedError

    def encode(self, data: bytes) -> list[int]:
        raise NotImplementedError

    def checked(self, data: bytes) -> list[int]:
        if len(data) > self.most_bytes:
            raise ValueError(f"{len(data)} bytes, the limit is {self.most_bytes}")
        return self.encode(data)


@dataclass(frozen=True)
class CanonicalElement(Encoder):
    """The bytes are an element already; others raise."""

    field: object

    @property
    def name(self) -> str:
        return "canonical"

    def encode(self, data):
        return [self.field.from_bytes(data)]


@dataclass(frozen=True)
class PrimeInteger(Encoder):
    """The framed bytes as a little-endian integer, modulo the prime."""

    field: PrimeField
    tag: int

    def __post_init__(self):
        if not isinstance(self.field, PrimeField):
            raise ValueError("integers need a prime field")

    @property
    def name(self) -> str:
        return f"prime-integer:{self.tag}"

    def encode(self, data):
        return [self.field.reduce(framed(data, self.tag))]


@dataclass(frozen=True)
class BinaryPolynomial(Encoder):
    """The framed bytes as a polynomial over two elements, reduced."""

    field: BinaryField
    tag: int

    def __post_init__(self):
        if not isinstance(self.field, BinaryField):
            raise ValueError("polynomials need a binary field")

    @property
    def name(self) -> str:
        return f"binary-polynomial:{self.tag}"

    def encode(self, data):
        return [self.field.reduce(framed(data, self.tag))]


@dataclass(frozen=True)
class HashLanes(Encoder):
    """Independent elements from SHA-256; bytes that are no element are drawn again."""

    field: object
    profile: bytes
    channel: int
    lanes: int = 1
    attempts: int = MOST_ATTEMPTS
    DOMAIN = b"sigmafold-hash-to-field-v1\0"

    def __post_init__(self):
        if len(self.profile) != 32 or self.lanes < 1:
            raise ValueError("a profile has 32 bytes, and there is one lane at least")

    @property
    def name(self) -> str:
        return f"hash-lanes:{self.profile.hex()}:{self.channel}:{self.lanes}"

    def _lane(self, lane: int, data: bytes) -> int:
        def number(n: int) -> bytes:
            return n.to_bytes(8, "little")

        head = self.DOMAIN + self.profile + number(self.channel) + number(lane) + number(len(data)) + data
        for attempt in range(self.attempts):
            drawn, block = b"", 0
            while len(drawn) < self.field.width:
                drawn += hashlib.sha256(head + number(attempt) + number(block)).digest()
                block += 1
            try:
                return self.field.from_bytes(drawn[: self.field.width])
            except ValueError:
                continue
        raise ValueError("no element after all attempts")

    def encode(self, data):
        return [self._lane(k, data) for k in range(self.lanes)]


@dataclass(frozen=True)
class LinearChunks(Encoder):
    """32-byte pieces, the last one first: state * x + piece; ``affine`` clears the top bit of each piece."""

    affine: bool = False
    field: BinaryField = GF2_256

    @property
    def name(self) -> str:
        return "affine-chunks" if self.affine else "linear-chunks"

    def encode(self, data):
        out = 0
        for at in reversed(range(0, len(data), 32)):
            piece = int.from_bytes(data[at : at + 32], "little")
            out = self.field.times_x(out) ^ (piece & (1 << 255) - 1 if self.affine else piece)
        return [out]


def dynamic(kind: str, field, **options) -> Encoder:
    """An encoder by name, over a field that is known at run time; a field of the wrong family raises."""
    kinds = {"canonical": CanonicalElement, "integer": PrimeInteger, "polynomial": BinaryPolynomial, "hash": HashLanes}
    if kind not in kinds:
        raise ValueError(f"encoders are {', '.join(kinds)}")
    return kinds[kind](field, **options)


def elements(df: DataFrame, column: str, encoder: Encoder, out: str) -> DataFrame:
    """``df`` with ``out``: the elements of each value of ``column`` (binary or text; null as null), as an array of canonical bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

    schema = StructType([*[f for f in df.schema if f.name != out], StructField(out, ArrayType(BinaryType()))])
    arrow = to_arrow_schema(schema)
    source = df.select(*[F.col(f"`{f.name}`") for f in schema if f.name != out], F.col(column).cast("binary").alias(out))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            # Equal values of a batch are encoded once.
            coded = batch.column(batch.num_columns - 1).dictionary_encode()
            made = [[encoder.field.to_bytes(e) for e in encoder.checked(v)] for v in coded.dictionary.to_pylist()]
            made = pa.array(made, pa.list_(pa.binary())).take(coded.indices) if made else pa.nulls(batch.num_rows, pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).cast(arrow.field(k).type) for k in range(batch.num_columns - 1)], made.cast(arrow.field(len(arrow) - 1).type)], schema=arrow)

    return source.mapInArrow(run, schema)


def c_canonical(field: PrimeField, data: Column) -> Column:
    """Little-endian bytes of one element of a field of at most 31 bits as a bigint; other bytes raise."""
    x = sum((F.conv(F.hex(F.substring(data, k + 1, 1)), 16, 10).cast("bigint") * F.lit(256**k) for k in range(field.width)), F.lit(0).cast("bigint"))
    return F.when((F.octet_length(data) != field.width) | (x >= field.p), F.raise_error(F.lit("not a canonical element"))).otherwise(x)
