"""Groups, styles and hidden text: from tokens to items that each know their format."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

from .lexer import Token

# fixed values: control words and what stands for pictures in a text
_UNDERLINES = ("ul", "uld", "uldb", "ulw")
_NO_TEXT = ("fonttbl", "colortbl", "stylesheet", "info")
_SPECIAL = {"~": "\u00a0", "-": "\u00ad", "_": "\u2011"}
_GRAPHIC, _ANNOUNCED, _GRAPHIC_ENDS = "N:GRAFIK", ".Z.", ".itw;"
_GRAPHIC_PATH = re.compile(r"N:GRAFIK\\([^;]+)\.itw", re.IGNORECASE)
_RAISED_BY = 6


class Format(NamedTuple):
    bold: bool = False
    italic: bool = False
    underline: bool = False
    struck: bool = False
    raised: int = 0
    font: int = 0
    hidden: bool = False
    secret: str = ""  # the hidden text since it began
    ignored: bool = False
    in_table: bool = False
    left: int = 0
    right: int = 0
    first: int = 0
    before: int = 0
    after: int = 0


class Item(NamedTuple):
    """`kind` is text, picture, or the control word of a mark (MARKS); `value` its text, path or number."""

    kind: str
    value: Any
    format: Format


_Effect = Callable[[Format, int | None], Format]
_CHARACTERS = Format._fields[:7]
_PARAGRAPH = Format._fields[9:]


def _reset(*fields: str) -> _Effect:
    return lambda f, n: f._replace(**{x: Format._field_defaults[x] for x in fields})


def _on(field: str) -> _Effect:
    return lambda f, n: f._replace(**{field: n != 0})


def _number(field: str, sign: int = 1, usual: int = 0) -> _Effect:
    return lambda f, n: f._replace(**{field: sign * (usual if n is None else n)})


def _hide(f: Format, n: int | None) -> Format:
    return f._replace(hidden=False) if n == 0 else f._replace(hidden=True, secret="")


EFFECTS: dict[str, _Effect] = {
    "b": _on("bold"), "i": _on("italic"), "strike": _on("struck"), **dict.fromkeys(_UNDERLINES, _on("underline")), "ulnone": _reset("underline"),
    "up": _number("raised", 1, _RAISED_BY), "dn": _number("raised", -1, _RAISED_BY), "nosupersub": _reset("raised"), "f": _number("font"),
    "li": _number("left"), "ri": _number("right"), "fi": _number("first"), "sb": _number("before"), "sa": _number("after"),
    "plain": _reset(*_CHARACTERS), "pard": _reset(*_PARAGRAPH), "v": _hide, "row": _reset("in_table"),
    "intbl": lambda f, n: f._replace(in_table=True), **dict.fromkeys(_NO_TEXT, lambda f, n: f._replace(ignored=True)),
}
MARKS = {"par", "line", "tab", "trowd", "trleft", "cellx", "cell", "row"}
_NUMBERED = {"trleft", "cellx"}  # these say nothing without a number


def formatted(tokens: Iterable[Token]) -> Iterator[Item]:
    """Items of a token stream: texts, escapes (braces and backslashes), marks, and the hidden texts that end, as `secret` or
    `group secret` by what ended them."""
    now, outer, gathering = Format(), [], False
    for t in tokens:
        if t.kind == "open":
            outer.append(now)
        elif t.kind == "close":
            if not outer:
                continue
            if now.hidden and not outer[-1].hidden:
                yield Item("group secret", now.secret, now)
                gathering = False
            now = outer.pop()
        elif now.ignored:
            continue
        elif t.kind == "word":
            if t.word == "plain" and now.hidden and gathering:
                yield Item("secret", now.secret, now)
                gathering = False
            if t.word in EFFECTS:
                now = EFFECTS[t.word](now, t.param)
                gathering |= t.word == "v" and now.hidden
            if t.word in MARKS and not (t.word in _NUMBERED and t.param is None):
                yield Item(t.word, t.param, now)
        elif t.kind == "symbol":
            if t.word in _SPECIAL:
                yield Item("special", _SPECIAL[t.word], now)
            elif t.word in "{}\\":
                yield Item("escape", t.word, now)
        elif t.kind == "text" or t.param is not None:
            said = t.word if t.kind == "text" else chr(t.param & 0xFFFF)
            if now.hidden:
                now = now._replace(secret=now.secret + said)
            else:
                yield Item("text" if t.kind == "text" else "byte", said, now)


def picture(text: str) -> str | None:
    found = _GRAPHIC_PATH.search(text)
    return found[1].replace("\\", "/") + ".png" if found else None


def with_pictures(items: Iterable[Item]) -> Iterator[Item]:
    """Hidden texts become pictures, or announce that the text after them is a picture's path; other texts are texts."""
    path: list[str] | None = None
    for x in items:
        found = None
        match x.kind:
            case "secret" | "group secret":
                announced = _ANNOUNCED in x.value
                if _GRAPHIC in x.value or announced:
                    found = picture(x.value) if x.kind == "group secret" or not announced else None
                    if announced and found is None:
                        path = []
            case "text" | "byte" | "escape" if path is not None:
                path.append(x.value)
                if x.kind == "text" and _GRAPHIC_ENDS in "".join(path):
                    found, path = picture("".join(path)), None
            case "text" | "byte" | "escape" | "special":
                yield x._replace(kind="text")
            case _:
                yield x
        if found is not None:
            yield x._replace(kind="picture", value=found)
