"""Checksums, keyed digests and small formulas as Column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _numbers(value: Column) -> Column:
    """The digits as an array of ints, last first."""
    d = F.reverse(digits(value))
    return F.transform(F.filter(F.split(d, ""), lambda x: x != ""), lambda x: x.cast("int"))


def luhn_sum(numbers: Column, first: int = 1) -> Column:
    """Sum of digits, last first, those at odd places (counted from `first` - 1) doubled and reduced."""
    return F.aggregate(F.transform(numbers, lambda x, i: F.when((i + first) % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)), F.lit(0), lambda a, x: a + x)


def luhn(value: Column) -> Column:
    n = F.char_length(digits(value))
    return (n >= 13) & (n <= 19) & (luhn_sum(_numbers(value)) % 10 == 0)


def luhn_digit(body: Column) -> Column:
    """The digit that completes body."""
    return ((10 - luhn_sum(_numbers(body), 2) % 10) % 10).cast("string")


def _dihedral(a: int, b: int) -> int:
    """Composition in the symmetry group of the pentagon: 0-4 turns, 5-9 reflections."""
    x, y = a % 5, b % 5
    turn = (x - y if a > 4 else x + y) % 5
    return turn + 5 * ((a > 4) != (b > 4))


def _permutations() -> list[list[int]]:
    base, out = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), [list(range(10))]
    for _ in range(7):
        out.append([base[x] for x in out[-1]])
    return out


DIHEDRAL = [[_dihedral(a, b) for b in range(10)] for a in range(10)]
PERMUTED = _permutations()


def verhoeff(value: Column) -> Column:
    """Whether the value has exactly 12 digits that pass the Verhoeff check."""
    d = F.array(*[F.lit(x) for row in DIHEDRAL for x in row])
    p = F.array(*[F.lit(x) for row in PERMUTED for x in row])
    moved = F.transform(_numbers(value), lambda x, i: F.get(p, i % 8 * 10 + x))
    return (F.char_length(digits(value)) == 12) & (F.aggregate(moved, F.lit(0), lambda a, x: F.get(d, a * 10 + x)) == 0)


def ipv4(value: Column) -> Column:
    """Four numbers up to 255 without leading zeros."""
    return value.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$") & ~value.endswith(".")


def ssn(value: Column) -> Column:
    area = F.substring(value, 1, 3)
    return ~(area.isin("000", "666") | area.startswith("9") | (F.substring(value, 5, 2) == "00") | (F.substring(value, 8, 4) == "0000"))


def hmac(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as hex, from the hash alone; the key's pads are literals of the plan. Keys over 64 bytes are hashed first."""
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda v: F.lit(bytes(x ^ v for x in k))
    inner = F.sha2(F.concat(pad(0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def seed_fingerprint(seed: bytes) -> str:
    """What names a seed without telling it."""
    return hashlib.sha256(seed).hexdigest()[:16]


def formatted(value: Column) -> Column:
    """Four decimals, N/A for null."""
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%.4f", value.cast("double")))


def number(hexed: Column, start: int, n: int) -> Column:
    """n hex characters from `start` (from 0) as a number."""
    return F.conv(F.substring(hexed, start + 1, n), 16, 10).cast("long")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); 0 if either is null or the union is empty."""
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda x: F.greatest(F.lit(0), x["x2"] - x["x1"]) * F.greatest(F.lit(0), x["y2"] - x["y1"])
    inter = side("x1", "x2") * side("y1", "y2")
    union = area(a) + area(b) - inter
    return F.coalesce(F.when(union > 0, inter / union), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def f1(p: Column, r: Column) -> Column:
    return F.when((p + r) != 0, 2 * p * r / (p + r))
