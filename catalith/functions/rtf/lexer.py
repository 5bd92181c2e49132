"""Tokens of rich text, by one regular expression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # open, close, word, symbol, byte or text
    word: str = ""
    param: int | None = None


_TOKEN = re.compile(
    r"(?P<open>\{)|(?P<close>\})"
    r"|\\'(?P<byte>(?s:.{0,2}))"
    r"|\\(?P<word>[A-Za-z]+)(?P<param>-?[0-9]*) ?"
    r"|\\(?P<symbol>(?s:.))"
    r"|(?P<text>[^{}\\\r\n]+)"
)
_HEX = re.compile(r"\s*([+-]?)([0-9A-Fa-f]+)")


def _byte(text: str) -> int | None:
    """The hexadecimal number a text begins with."""
    found = _HEX.match(text)
    if not found or text.strip().lower() == "0x":
        return None
    return int(found[1] + found[2], 16)


def tokens(text: str) -> Iterator[Token]:
    """Braces, control words with their parameter and one blank, escaped bytes, control symbols, and text. Line ends
    are no text, and a backslash at the very end is nothing."""
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if m["word"] is not None:
            yield Token("word", m["word"], int(m["param"]) if m["param"] not in ("", "-") else None)
        elif m["byte"] is not None:
            yield Token("byte", "", _byte(m["byte"]))
        else:
            yield Token(kind, m[kind] if kind in ("symbol", "text") else "")
