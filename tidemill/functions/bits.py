"""Bits of a binary value, the highest bit of each byte first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.binary import slice_bytes


def get_bit(value: Column, offset: int) -> Column:
    """0 beyond the end."""
    byte = F.conv(F.hex(value.substr(F.lit(offset // 8 + 1), F.lit(1))), 16, 10).cast("int")
    return F.when(F.octet_length(value) > offset // 8, F.shiftright(byte, 7 - offset % 8).bitwiseAND(F.lit(1))).otherwise(F.lit(0))


def set_bit(value: Column, offset: int, bit: int) -> Column:
    """value with the bit set, filled up with zero bytes."""
    at = offset // 8
    raw = F.coalesce(value, F.lit(b""))
    full = F.rpad(raw, at + 1, F.lit(b"\x00"))
    wide = F.when(F.octet_length(raw) > at, raw).otherwise(full)
    byte = F.conv(F.hex(wide.substr(F.lit(at + 1), F.lit(1))), 16, 10).cast("int")
    mask = 1 << (7 - offset % 8)
    new = byte.bitwiseOR(F.lit(mask)) if bit else byte.bitwiseAND(F.lit(255 - mask))
    return F.concat(wide.substr(F.lit(1), F.lit(at)), F.unhex(F.lpad(F.hex(new.cast("long")), 2, "0")), wide.substr(F.lit(at + 2), F.octet_length(wide)))


#: Hexadecimal digits by their number of set bits.
DIGITS = {1: "1248", 2: "3569AC", 3: "7BDE", 4: "F"}


def bit_count(value: Column, start: int = 0, end: int = -1) -> Column:
    """Set bits in a range of bytes."""
    digits = F.hex(slice_bytes(value, start, end))
    others = lambda kept: "".join(d for d in "0123456789ABCDEF" if d not in kept)
    return sum((F.length(F.translate(digits, others(kept), "")) * n for n, kept in DIGITS.items()), F.lit(0)).cast("long")


def bit_pos(value: Column, bit: int) -> Column:
    """The place of the first such bit; -1 if there is none, but the length for a 0 after all-ones; a missing value is all zeros."""
    digits = F.hex(value)
    rest = F.ltrim(digits, F.lit("0" if bit else "F"))  # from the first digit that has such a bit
    inside = F.translate(F.substring(rest, 1, 1), "123456789ABCDEF" if bit else "0123456789ABCDE", "322111100000000" if bit else "000000001111223")
    place = (F.length(digits) - F.length(rest)) * 4 + F.when(F.length(rest) > 0, inside.cast("int"))
    none = F.octet_length(value) * 8 if bit == 0 else F.lit(-1)
    return F.when(value.isNull(), F.lit(-1 if bit else 0)).otherwise(F.coalesce(place, none)).cast("long")
