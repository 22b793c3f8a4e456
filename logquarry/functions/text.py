"""Scalar column functions over log text: tokens, headers, masks, numbers, delimiters, integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD_LENGTH = 5
WILDCARD = "<*>"

# White space of tokens; what is masked; what counts as a number; delimiters.
SPACE = r"[\p{Z}\s\x0B\x85]+"
MASKED = r"^([0-9]+|[0-9]+\.[0-9]+|[0-9]{1,3}(\.[0-9]{1,3}){3}|[0-9a-fA-F]{8,})$"
NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
FLOAT = r"^(?i)([+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|0x([0-9a-f]+\.?[0-9a-f]*|\.[0-9a-f]+)p[+-]?[0-9]+|inf(inity)?)|nan)$"
CANONICAL = r"^(0|-?[1-9][0-9]*)$"
NOT_DELIMITER = r"[^-#><_:;,\[\]\\/.()]"


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def header(toks: Column, n: int = HEAD_LENGTH) -> Column:
    """The first n tokens, or all when there are no more than that."""
    return F.slice(toks, 1, n)


def content_tokens(toks: Column, n: int = HEAD_LENGTH) -> Column:
    return F.when(F.size(toks) > n, F.slice(toks, n + 1, F.greatest(F.size(toks) - n, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def mask(token: Column) -> Column:
    return F.when(token.rlike(MASKED), F.lit(WILDCARD)).otherwise(token)


def is_numeric(value: Column) -> Column:
    return value.rlike(NUMERIC)


def is_float(value: Column) -> Column:
    """A floating-point literal within range; overflow to infinity does not count, spelt infinity does."""
    spelt = F.lower(value).rlike("inf|nan|0x")
    return value.rlike(FLOAT) & (spelt | F.coalesce(F.abs(value.try_cast("double")) < F.lit(float("inf")), F.lit(False)))


def parse_number(value: Column) -> Column:
    """The value as a double, 0 where it is no floating-point literal within range."""
    return F.when(is_float(value), F.coalesce(value.try_cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))


def format_field(value: Column, form: Column) -> Column:
    """A header field in its inferred format: whole numbers for %d, six decimals for %f, else as it is."""
    number = parse_number(value)
    return F.when(form == "%d", number.try_cast("long").cast("string")).when(form == "%f", F.format_string("%.6f", number)).otherwise(value)


def delimiters(value: Column) -> Column:
    return F.regexp_replace(value, NOT_DELIMITER, "")


def split_by(value: Column, pattern: str) -> Column:
    """Parts between occurrences of a literal pattern, empty ones kept, so that joining restores the value."""
    return F.split(value, "\\Q" + pattern + "\\E", -1)


def rejoin(parts: Column, pattern: str) -> Column:
    return F.array_join(parts, pattern)


def zigzag(n: Column) -> Column:
    return F.shiftleft(n.cast("long"), 1).bitwiseXOR(F.shiftright(n.cast("long"), 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1)))


def varint_size(n: Column) -> Column:
    """Bytes of the zigzag LEB128 form of n."""
    digits = F.when(zigzag(n) == 0, F.lit(1)).otherwise(F.length(F.bin(zigzag(n))))
    return F.floor((digits + 6) / 7).cast("int")


def _bytes(parts: Column) -> Column:
    return F.unhex(F.array_join(F.transform(parts, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def _group(n: Column, place: Column, bits: int) -> Column:
    return F.call_function("shiftrightunsigned", n, (place * bits).cast("int")).bitwiseAND(F.lit((1 << bits) - 1))


def varint(n: Column) -> Column:
    """The zigzag LEB128 form of n, as bytes."""
    z, last = zigzag(n), varint_size(n) - 1
    return _bytes(F.transform(F.sequence(F.lit(0), last), lambda i: _group(z, i, 7).bitwiseOR(F.when(i < last, 128).otherwise(0).cast("long"))))


def read_varint(raw: Column) -> Column:
    """The number of a zigzag LEB128 form."""
    at = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("long").bitwiseAND(F.lit(127))
    places = F.sequence(F.lit(1), F.octet_length(raw))
    return unzigzag(F.aggregate(places, F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.call_function("shiftleft", at(i), (i - 1) * 7))))


def fixed(n: Column, size: int) -> Column:
    """n as so many bytes, the lowest first."""
    return _bytes(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: _group(n.cast("long"), i, 8)))


def read_fixed(raw: Column, size: int) -> Column:
    parts = [F.shiftleft(F.conv(F.hex(F.substring(raw, i + 1, 1)), 16, 10).cast("long"), 8 * i) for i in range(size)]
    return sum(parts[1:], parts[0])


def short_string(value: Column) -> Column:
    """The byte length in two bytes, then the bytes; null beyond 65535 bytes."""
    return F.when(F.octet_length(value) <= 0xFFFF, F.concat(fixed(F.octet_length(value), 2), value.cast("binary")))


def read_short_string(raw: Column) -> Column:
    return F.substring(raw, F.lit(3), read_fixed(raw, 2).cast("int")).cast("string")


def wrap32(n: Column) -> Column:
    """n modulo 2**32 as a signed number."""
    return F.pmod(n + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def entropy_weight(value: Column) -> Column:
    return F.when(value <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.log2(value.cast("double") + 1)))
