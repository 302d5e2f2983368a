"""Hash expressions behind the sketches, all inside whole-stage codegen.

`md5` mode reads the first eight digest bytes as a little-endian unsigned number; any engine
with md5 can reproduce its cells and registers. `xxhash64` mode is the fast one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_MODES = ("md5", "xxhash64")


def check_mode(hash_mode: str) -> None:
    if hash_mode not in HASH_MODES:
        raise ValueError(f"hash_mode must be one of {HASH_MODES}, not {hash_mode!r}")


def key_hash(text: Column, hash_mode: str = "md5") -> Column:
    """What a key is hashed to: the md5 digest in hex, or a bigint.

    Kept apart from the arithmetic on it, so that a plan computes it once per row and then works
    on the column.
    """
    check_mode(hash_mode)
    return F.md5(text.cast("binary")) if hash_mode == "md5" else F.xxhash64(text)


def _hex_number(digest: Column, chars: int) -> Column:
    """The first hex digits as a (signed 64-bit) number, most significant first."""
    return F.conv(F.substring(digest, 1, chars), 16, -10).cast("bigint")


def _swap_bytes(v: Column) -> Column:
    """Reverse the eight bytes of a bigint: neighbours, then pairs, then halves."""
    for shift, mask in ((8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        keep = F.lit(mask).cast("bigint")
        v = F.shiftleft(v.bitwiseAND(keep), shift).bitwiseOR(
            F.shiftrightunsigned(v, shift).bitwiseAND(keep)
        )
    return v


def hash_number(hashed: Column, hash_mode: str = "md5") -> Column:
    """The first eight bytes of `key_hash` as a signed bigint, in digest order."""
    return _hex_number(hashed, 16) if hash_mode == "md5" else hashed


def hash_bits(number: Column, hash_mode: str = "md5") -> Column:
    """The 64 hash bits: the digest bytes are read as little-endian."""
    return _swap_bytes(number) if hash_mode == "md5" else number


def hash64(text: Column, hash_mode: str = "md5") -> Column:
    return hash_bits(hash_number(key_hash(text, hash_mode), hash_mode), hash_mode)


def digest_mod(digest: Column, modulus: int) -> Column:
    """Unsigned little-endian 64-bit md5 prefix modulo `modulus`, as a bigint."""
    if not 1 <= modulus <= 2 ** 31:
        raise ValueError("modulus must be between 1 and 2**31")
    if modulus & (modulus - 1) == 0 and modulus <= 2 ** 16:
        # only the low bits matter, and the first two digest bytes hold them
        head = _hex_number(digest, 4)
        swapped = F.shiftleft(head.bitwiseAND(F.lit(0xFF)), 8).bitwiseOR(F.shiftright(head, 8))
        return swapped.bitwiseAND(F.lit(modulus - 1))
    return bits_mod(hash_bits(hash_number(digest)), modulus)


def bits_mod(bits: Column, modulus: int) -> Column:
    """Hash bits, read as an unsigned number, modulo `modulus`."""
    high, low = F.shiftrightunsigned(bits, 32), bits.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return ((high % modulus) * F.lit(2 ** 32 % modulus) + low % modulus) % modulus


def cms_row_hash(key: Column, row: int, hash_mode: str = "md5") -> Column:
    """What `key` is hashed to for row `row` of a Count-Min table."""
    check_mode(hash_mode)
    if hash_mode == "xxhash64":
        return F.xxhash64(F.lit(row), key)
    return key_hash(F.concat(key, F.lit(f":{row}")))


def cms_slot(row_hash: Column, width: int, hash_mode: str = "md5") -> Column:
    """Column of the table that a row hash falls into."""
    if hash_mode == "xxhash64":
        return F.pmod(row_hash, F.lit(width)).cast("int")
    return digest_mod(row_hash, width).cast("int")


def cms_col(key: Column, row: int, width: int, hash_mode: str = "md5") -> Column:
    return cms_slot(cms_row_hash(key, row, hash_mode), width, hash_mode)


def hll_idx(h: Column, p: int | Column) -> Column:
    """Register number: the top p bits."""
    return F.call_function("shiftrightunsigned", h, F.lit(64) - _lit(p)).cast("int")


def hll_rest(h: Column, p: int | Column) -> Column:
    """The other 64 - p bits, moved to the top."""
    return F.call_function("shiftleft", h, _lit(p))


def spread_down(v: Column, *shifts: int) -> Column:
    """Copies set bits downwards; after shifts 1, 2, 4, 8, 16, 32 all bits below the highest are set."""
    for shift in shifts:
        v = v.bitwiseOR(F.shiftrightunsigned(v, shift))
    return v


def hll_rho(spread: Column, p: int | Column) -> Column:
    """1 + leading zeros of the rest, at most 64 - p + 1, from the spread-down rest."""
    return F.least(F.lit(65) - F.bit_count(spread), F.lit(65) - _lit(p)).cast("int")


def with_bits(df: DataFrame, text: Column, alias: str, hash_mode: str = "md5") -> DataFrame:
    """Adds the 64 hash bits of a string, step by step, so that each step is a column that the next one
    reads instead of an expression repeated in it."""
    kept = df.columns
    return (
        df.select(*kept, key_hash(text, hash_mode).alias("_digest"))
        .select(*kept, hash_number(F.col("_digest"), hash_mode).alias("_number"))
        .select(*kept, hash_bits(F.col("_number"), hash_mode).alias(alias))
    )


def unit_interval(bits: Column) -> Column:
    """Hash bits as a draw in [0, 1) with 52 bits."""
    return F.shiftrightunsigned(bits, 12) / F.lit(float(2 ** 52))


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
