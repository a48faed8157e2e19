"""Column expressions for keys, counters and stored values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the op column (fixed values).
DELETE, PUT, DELETE_RANGE, ADD = 0, 1, 2, 3


def little_endian(number: Column) -> Column:
    """A long as 8 bytes, lowest first."""
    return F.reverse(F.unhex(F.lpad(F.hex(number), 16, "0")))


def from_little_endian(value: Column) -> Column:
    """The long in 8 bytes, lowest first; any other length is an error."""
    good = F.conv(F.hex(F.reverse(value)), 16, -10).cast("long")
    return F.when(F.octet_length(value) == 8, good).otherwise(F.raise_error(F.lit("a counter must be 8 bytes long")).cast("long"))


def wrapped(total: Column) -> Column:
    """A whole DECIMAL(38,0) as a signed 64-bit number that wraps on overflow, where ANSI arithmetic would fail."""
    span, half = F.lit(str(2**64)).cast("decimal(38,0)"), F.lit(str(2**63)).cast("decimal(38,0)")
    return (F.pmod(total + half, span) - half).cast("long")


def wrapping_sum(number: Column) -> Column:
    return wrapped(F.sum(number.cast("decimal(20,0)")).cast("decimal(38,0)"))


def prefix_end(prefix: bytes) -> bytes | None:
    """The smallest key above all keys with this prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def has_prefix(key: Column, prefix: bytes) -> Column:
    """Prefix test on BINARY keys as a range, which reaches the Parquet scan."""
    end = prefix_end(prefix)
    return key >= F.lit(bytearray(prefix)) if end is None else (key >= F.lit(bytearray(prefix))) & (key < F.lit(bytearray(end)))


#: First number of a self-describing value, and the bytes of its header (fixed values).
VALUE_MAGIC, VALUE_HEADER = 0x4C524E31, 28


def value_header(value: Column) -> Column:
    """The self-describing value's big-endian header: magic (4 bytes), key_id (8), sequence (8), size (4), crc (4, unsigned), then the body."""

    def number(at: int, size: int) -> Column:
        return F.conv(F.hex(F.substring(value, at, size)), 16, -10 if size == 8 else 10).cast("long")

    return F.struct(number(1, 4).alias("magic"), number(5, 8).alias("key_id"), number(13, 8).alias("sequence"), number(21, 4).alias("size"), number(25, 4).alias("crc"), F.substring(value, VALUE_HEADER + 1, 2147483647).alias("body"))


def described_value(key_id: Column, sequence: Column, size: Column, seed: int) -> Column:
    """A self-describing value of `size` bytes (its header at least): body byte i is the lowest byte of seed + 31 key_id + 17 sequence + i; the checksum covers all but itself."""
    whole = F.greatest(size, F.lit(VALUE_HEADER)).cast("int")

    def big_endian(n: Column, digits: int) -> Column:
        return F.unhex(F.lpad(F.hex(n.cast("long")), digits, "0"))

    lead = F.concat(big_endian(F.lit(VALUE_MAGIC), 8), big_endian(key_id, 16), big_endian(sequence, 16), big_endian(whole, 8))
    body = F.transform(F.sequence(F.lit(VALUE_HEADER), whole - 1), lambda i: F.lpad(F.hex(F.pmod(F.lit(seed) + key_id * 31 + sequence * 17 + i, F.lit(256)).cast("long")), 2, "0"))
    body = F.when(whole > VALUE_HEADER, F.unhex(F.array_join(body, ""))).otherwise(F.unhex(F.lit("")))
    return F.concat(lead, big_endian(F.crc32(F.concat(lead, body)), 8), body)


def value_problem(value: Column, key_id: Column, sequence: Column) -> Column:
    """What is wrong with a self-describing value of a key at a sequence, null if nothing is."""
    h = value_header(value)
    sound = (h["magic"] == VALUE_MAGIC) & (h["size"] == F.octet_length(value)) & (h["crc"] == F.crc32(F.concat(F.substring(value, 1, VALUE_HEADER - 4), h["body"])))
    return F.when(value.isNull(), "missing value").when(F.octet_length(value) < VALUE_HEADER, "value too small").when(~sound, "checksum mismatch").when((h["key_id"] != key_id) | (h["sequence"] != sequence), "value mismatch")
