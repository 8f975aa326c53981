"""Bit streams, code lengths and codewords.

``BitWriter`` and ``BitReader`` work inside Arrow functions; the ``*_bits`` and
``*_word`` functions are Catalyst expressions for whole columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits_for(v: int) -> int:
    """Binary digits of v; one for 0."""
    return max(1, v.bit_length())


class BitWriter:
    """Bits, most significant first; ``done`` closes with the number of valid bits in the last byte's low three bits."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def write(self, v: int, width: int) -> None:
        self.parts.append(bin(1 << width | v)[3:] if width else "0")

    def text(self, bits: str) -> None:
        self.parts.append(bits)

    def gamma(self, v: int) -> None:
        b = bits_for(v)
        self.parts.append("0" * b + "1" + format(v, "b"))

    def delta(self, v: int) -> None:
        self.gamma(bits_for(v))
        self.parts.append(format(v, "b"))

    def ternary(self, v: int) -> None:
        if v:
            v -= 1
            while True:
                v, digit = divmod(v, 3)
                self.parts.append(format(digit, "02b"))
                if not v:
                    break
        self.parts.append("11")

    def compressed(self, v: int, b: int = 7) -> None:
        """Groups of b bits, lowest first, each after a flag that says whether more follow."""
        while True:
            low, v = v & ((1 << b) - 1), v >> b
            self.parts.append(("1" if v else "0") + format(low, f"0{b}b"))
            if not v:
                return

    def bits(self) -> str:
        joined = "".join(self.parts)
        self.parts = [joined]
        return joined

    def done(self) -> bytes:
        bits = self.bits()
        rest = len(bits) % 8
        bits += "0" * (5 - rest) + format(rest, "03b") if rest <= 5 else "0" * (8 - rest) + format(rest, "08b")
        return int(bits, 2).to_bytes(len(bits) // 8, "big")


class Words(dict):
    """Codewords by number, made when they are first asked for."""

    def __init__(self, code: str, *options: int):
        self.code, self.options = code, options

    def __missing__(self, v: int) -> str:
        w = BitWriter()
        getattr(w, self.code)(v, *self.options)
        word = w.bits()
        if len(self) < 1 << 16:
            self[v] = word
        return word


class BitReader:
    def __init__(self, data: bytes):
        rest = data[-1] & 7 if data else 0
        total = 8 * (len(data) - (2 if rest > 5 else 1)) + rest if data else 0
        self.bits = format(int.from_bytes(data, "big"), f"0{8 * len(data)}b")[:total] if total > 0 else ""
        self.at = 0

    def eof(self) -> bool:
        return self.at >= len(self.bits)

    def bytes(self, n: int) -> bytes:
        """The next n whole bytes."""
        end = self.at + 8 * n
        out = int(self.bits[self.at : end], 2).to_bytes(n, "big") if n else b""
        self.at = end
        return out

    def read(self, width: int) -> int:
        v = int(self.bits[self.at : self.at + width], 2)
        self.at += width
        return v

    def unary(self) -> int:
        one = self.bits.index("1", self.at)
        n, self.at = one - self.at, one + 1
        return n

    def gamma(self) -> int:
        return self.read(self.unary())

    def delta(self) -> int:
        return self.read(self.gamma())

    def ternary(self) -> int:
        digits = []
        while (d := self.read(2)) != 3:
            digits.append(d)
        v = 0
        for d in reversed(digits):
            v = 3 * v + d
        return v + 1 if digits else 0

    def compressed(self, b: int = 7) -> int:
        v = shift = 0
        while True:
            more = self.read(1)
            v |= self.read(b) << shift
            shift += b
            if not more:
                return v


def vbyte(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def read_vbyte(data: bytes, at: int) -> tuple[int, int]:
    """The value and the place after it."""
    v = shift = 0
    while True:
        b = data[at]
        at += 1
        v |= (b & 127) << shift
        shift += 7
        if b < 128:
            return v, at


def width(v: Column) -> Column:
    """``bits_for`` of a non-negative column."""
    return F.length(F.bin(v.cast("bigint"))).cast("bigint")


def binary_word(v: Column, low: int, high: int) -> Column:
    return F.lpad(F.bin((v - low).cast("bigint")), bits_for(high - low), "0")


def unary_word(v: Column) -> Column:
    return F.concat(F.repeat(F.lit("0"), v.cast("int")), F.lit("1"))


def gamma_word(v: Column) -> Column:
    return F.concat(F.repeat(F.lit("0"), width(v).cast("int")), F.lit("1"), F.bin(v.cast("bigint")))


def delta_word(v: Column) -> Column:
    return F.concat(gamma_word(width(v)), F.bin(v.cast("bigint")))


def ternary_word(v: Column) -> Column:
    digits = F.reverse(F.conv((v - 1).cast("string"), 10, 3))
    coded = F.array_join(F.transform(F.split(digits, ""), lambda d: F.lpad(F.bin(d.cast("bigint")), 2, "0")), "")
    return F.when(v == 0, F.lit("11")).otherwise(F.concat(coded, F.lit("11")))


def ascii_word(v: Column) -> Column:
    return F.concat(v.cast("string"), F.lit(":"))


def gamma_bits(v: Column) -> Column:
    return 2 * width(v) + 1


def delta_bits(v: Column) -> Column:
    return gamma_bits(width(v)) + width(v)


def ternary_bits(v: Column) -> Column:
    return F.when(v == 0, F.lit(2)).otherwise(2 * F.length(F.conv((v - 1).cast("string"), 10, 3)) + 2).cast("bigint")


def vbyte_bytes(v: Column) -> Column:
    return F.ceil(width(v) / 7).cast("bigint")


def stream_bytes(bits: Column) -> Column:
    """Size of a closed bit stream."""
    return (F.floor((bits + 2) / 8) + 1).cast("bigint")
