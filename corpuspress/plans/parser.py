"""Algorithm strings such as ``bwt:rle:mtf:encode(huff)`` or ``lzss(coder=bit, window=32)``.

Positional arguments come before named ones, strings may be quoted, numbers are
unsigned, and ``a:b:c`` is short for ``chain(chain(a, b), c)``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class AlgorithmError(ValueError):
    """An algorithm string that can't be used."""


class UnknownAlgorithm(AlgorithmError):
    pass


class UnknownOption(AlgorithmError):
    pass


class UnassignedArgument(AlgorithmError):
    pass


class WrongKind(AlgorithmError):
    """An algorithm where a plain value is expected, or the other way round."""


@dataclass(frozen=True)
class Algo:
    name: str
    args: tuple = field(default=())
    named: tuple[tuple[str, object], ...] = field(default=())

    def __str__(self) -> str:
        inner = [show(a) for a in self.args] + [f"{k}={show(v)}" for k, v in self.named]
        return self.name + (f"({', '.join(inner)})" if inner else "")


def show(value: object) -> str:
    return str(value) if isinstance(value, Algo) else '"' + str(value).replace('"', "'") + '"'


_TOKEN = re.compile(r"""\s*(?:(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<number>\d+(?:\.\d+)?)|"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<sign>[(),=:]))""")


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise AlgorithmError(f"can't read {text[at:at + 20]!r}")
        kind = m.lastgroup or ""
        out.append(("string" if kind in ("double", "single", "number") else kind, m.group(kind)))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str):
        self.items, self.at = tokens(text), 0

    def peek(self, sign: str) -> bool:
        return self.at < len(self.items) and self.items[self.at] == ("sign", sign)

    def take(self, sign: str) -> None:
        if not self.peek(sign):
            raise AlgorithmError(f"{sign!r} is missing")
        self.at += 1

    def value(self) -> object:
        out = self.single()
        while self.peek(":"):
            self.at += 1
            out = Algo("chain", (out, self.single()))
        return out

    def single(self) -> object:
        if self.at >= len(self.items):
            raise AlgorithmError("the text ends too early")
        kind, text = self.items[self.at]
        self.at += 1
        if kind == "string":
            return text
        if kind != "name":
            raise AlgorithmError(f"{text!r} isn't expected here")
        args, named = [], []
        if self.peek("("):
            self.at += 1
            while not self.peek(")"):
                follow = self.items[self.at + 1] if self.at + 1 < len(self.items) else ("", "")
                if self.at < len(self.items) and self.items[self.at][0] == "name" and follow == ("sign", "="):
                    key = self.items[self.at][1]
                    self.at += 2
                    named.append((key, self.value()))
                elif named:
                    raise AlgorithmError("a positional argument follows a named one")
                else:
                    args.append(self.value())
                if not self.peek(")"):
                    self.take(",")
            self.take(")")
        return Algo(text, tuple(args), tuple(named))


def parse(text: str) -> Algo:
    p = Parser(text)
    out = p.value()
    if p.at < len(p.items):
        raise AlgorithmError(f"{p.items[p.at][1]!r} is left over")
    if not isinstance(out, Algo):
        raise WrongKind("an algorithm is expected")
    return out
