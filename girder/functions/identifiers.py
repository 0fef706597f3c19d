"""128-bit identifiers as column expressions: their texts, their byte order in records, the compact form of exchange files.

A null stays null; a text of another form gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of the compact form, fixed by its standard.
COMPACT = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$"
#: Places of the bytes of a record in the text: three little-endian numbers, then bytes in order.
_MIXED = (3, 2, 1, 0, 5, 4, 7, 6, 8, 9, 10, 11, 12, 13, 14, 15)
_TEXT = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _bound(value: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` of a value that is worked out once, however often the rule names it."""
    return F.transform(F.array(value), rule)[0]


def _joined(places: Iterable[int], digits: Column, width: int) -> Column:
    """The groups of ``width`` digits at the places named."""
    return F.array_join(F.transform(F.array(*[F.lit(width * k + 1) for k in places]), lambda at: F.substring(digits, at, F.lit(width))), "")


def guid_of_hex(digits: Column) -> Column:
    """32 hexadecimal digits with hyphens, in lower case."""
    return F.regexp_replace(F.lower(digits), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def guid_text(record: Column) -> Column:
    """The text of the 16 bytes of a record."""
    return F.when(F.octet_length(record) == 16, _bound(F.hex(record), lambda digits: guid_of_hex(_joined(_MIXED, digits, 2))))


def guid_bytes(text: Column) -> Column:
    """The 16 bytes of a record of a text, in any case."""
    return _bound(F.lower(text), lambda t: F.when(t.rlike(_TEXT), F.unhex(_joined(_MIXED, F.replace(t, F.lit("-"), F.lit("")), 2))))  # the order is its own inverse


def unique_id(guid: Column, element: Column) -> Column:
    """An element's id: the identifier of the session that made it, and its number in 8 hexadecimal digits, more if it is larger."""
    number = _bound(F.lower(F.hex(element.cast("long"))), lambda d: F.when(F.length(d) < 8, F.lpad(d, 8, "0")).otherwise(d))
    return F.concat(guid, F.lit("-"), number)


def unique_id_parts(text: Column) -> tuple[Column, Column]:
    """(guid, element number) of an element's id."""
    whole = lambda t: t.rlike(_TEXT[:-1] + "-[0-9a-f]{8,16}$")
    guid = _bound(F.lower(text), lambda t: F.when(whole(t), F.substring(t, 1, 36)))
    return guid, _bound(F.lower(text), lambda t: F.when(whole(t), F.conv(F.substring(t, F.lit(38), F.length(t)), 16, 10).cast("long")))


def exchange_guid(text: Column) -> Column:
    """The identifier under which an element stands in exchange files: that of its session, the last 32 bits XOR its number."""
    guid, element = unique_id_parts(text)

    def mixed(g: Column) -> Column:
        low = F.conv(F.substring(g, 29, 8), 16, 10).cast("long").bitwiseXOR(element.bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.concat(F.substring(g, 1, 28), F.lower(F.lpad(F.hex(low), 8, "0")))

    return _bound(guid, mixed)


def compact(guid: Column) -> Column:
    """The 22 digits of base 64 of an identifier's text: the first two hold its first byte, each four more hold three bytes."""

    def digits_of(t: Column) -> Column:
        digits = F.replace(t, F.lit("-"), F.lit(""))
        digit = lambda value, shift: F.substring(F.lit(COMPACT), F.call_function("shiftright", value, shift).bitwiseAND(F.lit(63)) + 1, F.lit(1))
        group = lambda at, n, shifts: _bound(F.conv(F.substring(digits, at, n), 16, 10).cast("int"), lambda v: F.array_join(F.transform(F.array(*map(F.lit, shifts)), lambda s: digit(v, s)), ""))
        rest = F.array_join(F.transform(F.sequence(F.lit(3), F.lit(27), F.lit(6)), lambda at: group(at, F.lit(6), (18, 12, 6, 0))), "")
        return F.when(t.rlike(_TEXT), F.concat(group(F.lit(1), F.lit(2), (6, 0)), rest))

    return _bound(F.lower(guid), digits_of)


def expanded(short: Column) -> Column:
    """The identifier's text of a compact form."""

    def text_of(t: Column) -> Column:
        value = lambda at: F.call_function("locate", F.substring(t, at, F.lit(1)), F.lit(COMPACT)) - 1
        number = lambda at, n: F.aggregate(F.sequence(at, at + (n - 1)), F.lit(0), lambda acc, k: acc * 64 + value(k))
        rest = F.array_join(F.transform(F.sequence(F.lit(3), F.lit(19), F.lit(4)), lambda at: F.lpad(F.hex(number(at, 4)), 6, "0")), "")
        return F.when(t.rlike(r"^[0-3][0-9A-Za-z_$]{21}$"), guid_of_hex(F.concat(F.lpad(F.hex(number(F.lit(1), 2)), 2, "0"), rest)))

    return _bound(short, text_of)
