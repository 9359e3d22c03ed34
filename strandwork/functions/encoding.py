"""Bases, k-mers and node keys as strings of base-4 digits.

Keys compare in the order A < C < T < G. With these as the digits 0 to 3, strings of one length sort like the packed
integers do, for any k; a 64-bit integer would go negative at k = 32 and end there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACTG"
DIGITS = "0123"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The base of each letter by bits 1 and 2 of its ASCII code.
LETTER_BASES = "".join(BASES[(ord(c) >> 1) & 3] for c in LOWER)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode(seq: Column | str) -> Column:
    """Bases, of either case, to digits. Other characters stay as they are."""
    return F.translate(_col(seq), BASES + BASES.lower(), DIGITS * 2)


def decode(digits: Column | str) -> Column:
    return F.translate(_col(digits), DIGITS, BASES)


def base_code(char: Column | str) -> Column:
    """The 3-bit code of a character: A 0, C 1, T 2, G 3, and N 7."""
    return F.call_function("shiftright", F.ascii(_col(char)), F.lit(1)).bitwiseAND(F.lit(7))


def lenient(seq: Column | str) -> Column:
    """Anything but a base counts as A."""
    return F.regexp_replace(F.upper(_col(seq)), "[^ACGT]", "A")


def strict(seq: Column | str) -> Column:
    """The sequence in upper case; an error if it has anything but bases."""
    up = F.upper(_col(seq))
    return F.when(up.rlike("[^ACGT]"), F.raise_error(F.concat(F.lit("not a base sequence: "), up)).cast("string")).otherwise(up)


def letters_to_bases(text: Column | str) -> Column:
    """A sequence from any text: its letters a to z, by their ASCII codes."""
    return F.translate(F.regexp_replace(F.lower(_col(text)), "[^a-z]", ""), LOWER, LETTER_BASES)


def prefix(kmer: Column | str, k: int) -> Column:
    return F.substring(_col(kmer), 1, k - 1)


def suffix(kmer: Column | str, k: int) -> Column:
    return F.substring(_col(kmer), 2, k - 1)


def shifted(kmer: Column | str, base: Column | str, k: int) -> Column:
    """The k-mer after one more base."""
    return F.concat(F.substring(_col(kmer), 2, k - 1), _col(base))


def base_at(kmer: Column | str, pos: Column | int) -> Column:
    return F.substring(_col(kmer), F.lit(pos + 1) if isinstance(pos, int) else pos + 1, F.lit(1))


def number(digits: Column | str) -> Column:
    """The value of up to 31 digits as a long."""
    return F.conv(_col(digits), 4, 10).cast("long")


#: Constants of the partition hash: fixed values.
HASH_A, HASH_B = 68111, 105929


def hash31(x: Column) -> Column:
    """A 31-bit hash: r = a x + b modulo 2^64 as a signed number, then its bits over 31 added to it. Exact for any
    long: the product is taken in decimals."""
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    half = F.lit("9223372036854775808").cast("decimal(20,0)")
    r = F.pmod(x.cast("decimal(20,0)") * F.lit(HASH_A).cast("decimal(6,0)") + F.lit(HASH_B).cast("decimal(6,0)"), two64)
    r = F.when(r >= half, r - two64).otherwise(r).cast("long")
    high = F.call_function("shiftright", r, F.lit(31))
    mask = F.lit((1 << 31) - 1).cast("long")
    # Only the low 31 bits of the sum count: adding those of both sides can't overflow.
    return (high.bitwiseAND(mask) + r.bitwiseAND(mask)).bitwiseAND(mask)


def hash_partition(x: Column, n: int) -> Column:
    return F.pmod(hash31(x), F.lit(n))


def range_partition(x: Column, k: int, n: int, min_size: int = 4) -> Column:
    """Which of n equal ranges of k-mer values x is in; ranges are at least min_size wide."""
    size = max(min_size, (4**k - 1) // n)
    return F.least(F.lit(n - 1), F.floor(x / F.lit(size)).cast("long"))


def top_bit(x: Column) -> Column:
    """The place of the most significant set bit, counted from 0; null for 0."""
    return F.when(x != 0, F.length(F.bin(x)) - 1)


def byte_digit(x: Column, start: int, end: int) -> Column:
    """Bytes start to end - 1 of a long, from the least, as a number."""
    return F.call_function("shiftrightunsigned", x, F.lit(8 * start)).bitwiseAND(F.lit((1 << (8 * (end - start))) - 1))
