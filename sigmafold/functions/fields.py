"""Finite fields: specifications, scalar arithmetic, and native column arithmetic where the field is small."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime below this has logarithm tables as literals and runs inside generated code.
TABLE_LIMIT = 4096


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 3.3e24, and are a strong test beyond."""
    if n < 2:
        return False
    small = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)
    if any(n % q == 0 for q in small):
        return n in small
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in small:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def _prime_factors(n: int) -> list[int]:
    out, q = [], 2
    while q * q <= n:
        if n % q == 0:
            out.append(q)
            while n % q == 0:
                n //= q
        q += 1
    return out + [n] * (n > 1)


@dataclass(frozen=True)
class PrimeField:
    """Integers modulo a prime; elements are ints in 0..p-1, bytes are little-endian."""

    p: int

    def __post_init__(self):
        if not is_prime(self.p):
            raise ValueError(f"{self.p} is not prime")

    @property
    def width(self) -> int:
        return (self.p.bit_length() + 7) // 8

    @property
    def zero(self) -> int:
        return 0

    @property
    def one(self) -> int:
        return 1

    def add(self, a: int, b: int) -> int:
        return (a + b) % self.p

    def sub(self, a: int, b: int) -> int:
        return (a - b) % self.p

    def neg(self, a: int) -> int:
        return -a % self.p

    def mul(self, a: int, b: int) -> int:
        return a * b % self.p

    def power(self, a: int, n: int) -> int:
        return pow(self.inverse(a), -n, self.p) if n < 0 else pow(a, n, self.p)

    def inverse(self, a: int) -> int:
        if a % self.p == 0:
            raise ZeroDivisionError("zero has no inverse")
        return pow(a, -1, self.p)

    def sqrt(self, a: int) -> int | None:
        """The smaller square root, or None (Tonelli-Shanks)."""
        a %= self.p
        if a == 0 or self.p == 2:
            return a
        if pow(a, (self.p - 1) // 2, self.p) != 1:
            return None
        q, s = self.p - 1, 0
        while q % 2 == 0:
            q, s = q // 2, s + 1
        z = next(z for z in range(2, self.p) if pow(z, (self.p - 1) // 2, self.p) == self.p - 1)
        m, c, t, r = s, pow(z, q, self.p), pow(a, q, self.p), pow(a, (q + 1) // 2, self.p)
        while t != 1:
            i, x = 0, t
            while x != 1:
                x, i = x * x % self.p, i + 1
            b = pow(c, 1 << (m - i - 1), self.p)
            m, c, t, r = i, b * b % self.p, t * b * b % self.p, r * b % self.p
        return min(r, self.p - r)

    def reduce(self, data: bytes) -> int:
        return int.from_bytes(data, "little") % self.p

    def to_bytes(self, a: int) -> bytes:
        return a.to_bytes(self.width, "little")

    def from_bytes(self, data: bytes) -> int:
        value = int.from_bytes(data, "little")
        if len(data) != self.width or value >= self.p:
            raise ValueError("not a canonical element")
        return value

    @cached_property
    def generator(self) -> int:
        """The least primitive root; for primes whose order factors by trial division."""
        factors = _prime_factors(self.p - 1)
        return next(g for g in range(1, self.p) if all(pow(g, (self.p - 1) // q, self.p) != 1 for q in factors))

    @cached_property
    def exp_table(self) -> list[int]:
        out, x = [], 1
        for _ in range(self.p - 1):
            out.append(x)
            x = x * self.generator % self.p
        return out

    @cached_property
    def log_table(self) -> list[int | None]:
        out: list[int | None] = [None] * self.p
        for k, x in enumerate(self.exp_table):
            out[x] = k
        return out

    @cached_property
    def _exp_literal(self) -> str:
        return f"array({', '.join(f'{v}L' for v in self.exp_table)})"

    @cached_property
    def _log_literal(self) -> str:
        return f"array({', '.join('CAST(NULL AS BIGINT)' if v is None else f'{v}L' for v in self.log_table)})"

    @property
    def native(self) -> bool:
        return self.p < TABLE_LIMIT

    # Column arithmetic: every operand is an element.

    def c_reduce(self, x: Column) -> Column:
        return F.pmod(x.cast("bigint"), F.lit(self.p))

    def c_mul(self, a: Column, b: Column) -> Column:
        """Exact while p * p < 2**63."""
        return F.pmod(a * b, F.lit(self.p))

    def c_log(self, x: Column) -> Column:
        """Discrete logarithm, null for zero."""
        return F.try_element_at(F.expr(self._log_literal), (x + 1).cast("int"))

    def c_exp(self, k: Column) -> Column:
        """The generator to the power ``k`` (any long)."""
        return F.element_at(F.expr(self._exp_literal), (F.pmod(k, F.lit(self.p - 1)) + 1).cast("int"))

    def c_power(self, base: int, k: Column) -> Column:
        """A fixed non-zero base to the power ``k``."""
        return self.c_exp(F.lit(self.log_table[base]).cast("bigint") * F.pmod(k, F.lit(self.p - 1)))

    def c_inverse(self, x: Column) -> Column:
        """Zero for zero."""
        return F.when(x == 0, F.lit(0).cast("bigint")).otherwise(self.c_exp(-self.c_log(x)))


@dataclass(frozen=True)
class BinaryField:
    """GF(2**m) by its reduction polynomial's exponents below m; elements are ints, bit i for x**i."""

    m: int
    tail: tuple[int, ...]

    @property
    def modulus(self) -> int:
        return (1 << self.m) | sum(1 << e for e in self.tail)

    @property
    def width(self) -> int:
        return (self.m + 7) // 8

    zero, one = 0, 1

    def add(self, a: int, b: int) -> int:
        return a ^ b

    sub = add

    def neg(self, a: int) -> int:
        return a

    def _fold(self, x: int) -> int:
        mask = (1 << self.m) - 1
        while x >> self.m:
            high, x = x >> self.m, x & mask
            for e in self.tail:
                x ^= high << e
        return x

    def mul(self, a: int, b: int) -> int:
        out = 0
        while b:
            low = b & -b
            out ^= a * low
            b ^= low
        return self._fold(out)

    def power(self, a: int, n: int) -> int:
        if n < 0:
            return self.power(self.inverse(a), -n)
        out = 1
        while n:
            if n & 1:
                out = self.mul(out, a)
            a, n = self.mul(a, a), n >> 1
        return out

    def inverse(self, a: int) -> int:
        """Extended division of polynomials."""
        if a == 0:
            raise ZeroDivisionError("zero has no inverse")
        r, s, x, y = self.modulus, a, 0, 1
        while s != 1:
            shift = r.bit_length() - s.bit_length()
            if shift < 0:
                r, s, x, y, shift = s, r, y, x, -shift
            r ^= s << shift
            x ^= y << shift
            if r.bit_length() < s.bit_length():
                r, s, x, y = s, r, y, x
        return self._fold(y)

    def frobenius(self, a: int, times: int = 1) -> int:
        for _ in range(times):
            a = self.mul(a, a)
        return a

    def trace(self, a: int) -> int:
        total, x = 0, a
        for _ in range(self.m):
            total ^= x
            x = self.mul(x, x)
        return total

    def norm(self, a: int) -> int:
        return self.power(a, (1 << self.m) - 1)

    def times_x(self, a: int) -> int:
        return self._fold(a << 1)

    def reduce(self, data: bytes) -> int:
        return self._fold(int.from_bytes(data, "little"))

    def to_bytes(self, a: int) -> bytes:
        return a.to_bytes(self.width, "little")

    def from_bytes(self, data: bytes) -> int:
        value = int.from_bytes(data, "little")
        if len(data) != self.width or value >> self.m:
            raise ValueError("not a canonical element")
        return value

    native = False


def is_irreducible(field: BinaryField) -> bool:
    """Whether the reduction polynomial has no factor (Rabin): x ** (2 ** m) = x, and no smaller field holds a root."""

    def gcd(a: int, b: int) -> int:
        while b:
            while a.bit_length() >= b.bit_length():
                a ^= b << (a.bit_length() - b.bit_length())
                if not a:
                    break
            a, b = b, a
        return a

    x = field._fold(2)
    if field.frobenius(x, field.m) != x:
        return False
    return all(gcd(field.modulus, field.frobenius(x, field.m // q) ^ x) == 1 for q in set(_prime_factors(field.m)))


def field_of(manifest: dict) -> PrimeField | BinaryField:
    """The field that a manifest describes, certified: little-endian canonical bytes of the right width, a prime or an irreducible modulus."""
    prime = "prime" in manifest
    if prime:
        found = PrimeField(int(manifest["prime"]["modulus"]))
    else:
        exponents = [int(e) for e in manifest["field"]["modulus"]["nonzero_exponents"]]
        m = int(manifest["field"]["degree"])
        if exponents != sorted(set(exponents), reverse=True) or exponents[0] != m or exponents[-1] != 0:
            raise ValueError("exponents fall from the degree to 0")
        found = BinaryField(m, tuple(exponents[1:]))
        if not is_irreducible(found):
            raise ValueError("the modulus is not irreducible")
    encoding = (manifest if prime else manifest["field"])["encoding"]
    if encoding["byte_order"] != "little" or int(encoding["canonical_bytes"]) != found.width:
        raise ValueError(f"an element has {found.width} little-endian bytes")
    return found


# The built-in fields.
F2 = PrimeField(2)
FP251 = PrimeField(251)
FP65521 = PrimeField(65521)
FP4294967291 = PrimeField(4294967291)
GOLDILOCKS = PrimeField(2**64 - 2**32 + 1)
MERSENNE127 = PrimeField(2**127 - 1)
GF2_128 = BinaryField(128, (7, 2, 1, 0))
GF2_256 = BinaryField(256, (10, 5, 2, 0))
GF2_256_ALT = BinaryField(256, (16, 3, 1, 0))


def batch_inverse(field, items: list[int]) -> tuple[list[int], list[bool]]:
    """Inverses with one inversion for all; zero stays zero and its mask is False."""
    ahead, acc = [], field.one
    for x in items:
        ahead.append(acc)
        acc = field.mul(acc, x) if x else acc
    acc = field.inverse(acc)
    out = [0] * len(items)
    for i in reversed(range(len(items))):
        if items[i]:
            out[i], acc = field.mul(acc, ahead[i]), field.mul(acc, items[i])
    return out, [bool(x) for x in items]


def horner(field, coefficients: list[int], point: int) -> int:
    """The polynomial with these coefficients, highest first, at ``point``."""
    acc = field.zero
    for c in coefficients:
        acc = field.add(field.mul(acc, point), c)
    return acc


def c_horner(field: PrimeField, coefficients: Column, point: int) -> Column:
    """The same over an array column, highest coefficient first."""
    return F.aggregate(coefficients, F.lit(0).cast("bigint"), lambda acc, c: F.pmod(acc * F.lit(point) + c, F.lit(field.p)))


def c_horner_many(field: PrimeField, coefficients: Column, points: list[int]) -> Column:
    """An array: the polynomial of an array column, highest coefficient first, at each point."""
    return F.array(*[c_horner(field, coefficients, p) for p in points])


# A mask over the rows of a batch is an array of bigints, 64 places each.


def mask_of(flags: Column) -> Column:
    """The mask of an array of booleans."""
    words = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(flags) / F.lit(64.0)).cast("int") - 1))
    word = lambda w: F.aggregate(F.slice(flags, w * 64 + 1, F.lit(64)), F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).alias("k")), lambda a, f: F.struct(F.when(f, a["x"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), a["k"]))).otherwise(a["x"]).alias("x"), (a["k"] + 1).alias("k")))["x"]
    return F.transform(words, word)


def mask_get(mask: Column, place: Column) -> Column:
    return F.call_function("shiftright", F.element_at(mask, (place / 64).cast("int") + 1), F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1


def mask_count(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda acc, w: acc + F.bit_count(w))


# --- encoders: bytes to elements -----------------------------------------------------------------


def framed(data: bytes, tag: int) -> bytes:
    return data + b"\x01" + tag.to_bytes(8, "little")


def encode_integer(field: PrimeField, data: bytes, tag: int) -> int:
    """The framed bytes as a little-endian integer, reduced."""
    return field.reduce(framed(data, tag))


encode_polynomial = encode_integer  # over a BinaryField: the framed bytes as a polynomial, reduced


def c_encode_integer(field: PrimeField, data: Column, tag: int) -> Column:
    """The same natively, for fields of at most 31 bits: Horner from the last byte of short binaries."""
    tail = encode_integer(field, b"", tag)
    digits = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint"))
    some = F.when(F.octet_length(data) > 0, F.reverse(digits)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(some, F.lit(tail).cast("bigint"), lambda acc, b: F.pmod(acc * 256 + b, F.lit(field.p)))


def encode_integers(field: PrimeField, texts, tag: int):
    """The same for an Arrow string or binary array of any lengths, in numpy (p below 2**31)."""
    import numpy as np

    if field.p >= 1 << 31:
        return [encode_integer(field, t, tag) for t in texts.cast("binary").to_pylist()]
    tail, out = encode_integer(field, b"", tag), []
    for t in texts.cast("binary").to_pylist():
        raw = np.frombuffer(t, np.uint8).astype(np.int64)
        acc = 0
        step, jump = 4096, pow(256, 4096, field.p)
        powers = np.array([pow(256, k, field.p) for k in range(256)], np.int64)
        table = np.concatenate([powers * pow(256, 256 * k, field.p) % field.p for k in range(step // 256)])
        for at in reversed(range(0, len(raw), step)):
            part = raw[at : at + step]
            acc = (acc * jump + int((part * table[: len(part)] % field.p).sum())) % field.p
        out.append((acc + tail * pow(256, len(raw), field.p)) % field.p)
    return out


def hash_to_field(field, data: bytes, domain: bytes, lanes: int, attempts: int = 4096) -> list[int]:
    """``lanes`` independent elements from SHA-256 expansion; values beyond the field are drawn again."""
    out = []
    for lane in range(lanes):
        for attempt in range(attempts):
            need, block, counter = field.width, b"", 0
            while len(block) < need:
                seed = len(domain).to_bytes(8, "little") + domain + lane.to_bytes(8, "little") + attempt.to_bytes(8, "little") + counter.to_bytes(8, "little") + data
                block += hashlib.sha256(seed).digest()
                counter += 1
            value = int.from_bytes(block[:need], "little")
            value &= (1 << (field.m if isinstance(field, BinaryField) else field.p.bit_length())) - 1
            if isinstance(field, BinaryField) or value < field.p:
                out.append(value)
                break
        else:
            raise ValueError("no element in the field after all attempts")
    return out
