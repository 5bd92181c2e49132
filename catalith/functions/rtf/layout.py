"""Paragraphs and tables: from formatted items to a tree of boxes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from .formatting import Format, Item

_SYMBOL_FONT = 1
_BLANK = " \t\n\r\v\f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


class Event(NamedTuple):
    """`kind`: paragraph, row, cell, cell end, row end, or content (text, picture, line, tab)."""

    kind: str
    value: Any = None
    format: Format = Format()


class RowShape(NamedTuple):
    left: int
    edges: tuple[int, ...]


@dataclass
class Box:
    """`kind`: page, table, row, cell or paragraph. A box is `left_open` if another row begins before it ends."""

    kind: str
    value: Any = None
    format: Format = Format()
    children: list[Box | Event] = field(default_factory=list)
    left_open: bool = False


def substituted(text: str, marks: dict[str, str], font: int) -> str:
    for mark, value in marks.items():
        text = text.replace(mark, value) if mark else text
    return text.replace("\u00b7", "\u2022") if font == _SYMBOL_FONT else text


def events(items: Iterable[Item], marks: dict[str, str]) -> Iterator[Event]:
    """A paragraph begins with its first text or picture. A row is announced with its edges and begins with its first
    content in the table, or where its first cell ends."""
    flowing = False
    announced: int | None = None
    edges: list[int] = []
    for x in items:
        content = x.kind in ("text", "picture")
        if announced is not None and (x.kind == "cell" or content and x.format.in_table):
            yield Event("row", RowShape(announced, tuple(edges)))
            yield Event("cell")
            announced = None
        if content and not flowing:
            yield Event("paragraph", None, x.format)
        flowing = content or flowing and x.kind not in ("par", "cell", "row")
        match x.kind:
            case "text":
                yield Event("text", substituted(x.value, marks, x.format.font), x.format)
            case "picture" | "line" | "tab":
                yield Event(*x)
            case "cell" | "row":
                yield Event(f"{x.kind} end")
            case "trowd":
                announced, edges = 0, []
            case "trleft" if announced is not None:
                announced = x.value
            case "cellx":
                edges.append(x.value)


def with_cells(found: Iterable[Event]) -> list[Event]:
    """The end of a cell begins another if content or a row is the next thing but for paragraphs. Read backwards, each
    cell's beginning learns the kinds of content up to the next end of a cell or row."""
    out: list[Event] = []
    holds: frozenset[str] = frozenset()
    upcoming = None
    for e in reversed(list(found)):
        match e.kind:
            case "cell":
                e = Event("cell", holds)
            case "cell end" | "row end":
                if e.kind == "cell end" and upcoming in ("text", "picture", "line", "tab", "row"):
                    out.append(Event("cell", holds))
                holds = frozenset()
            case "picture":
                holds |= {"picture"}
            case "text" if e.value.strip(_BLANK):
                holds |= {"text"}
        out.append(e)
        upcoming = upcoming if e.kind == "paragraph" else e.kind
    return out[::-1]


def tree(found: Iterable[Event]) -> Box:
    """Boxes in boxes: page, table, row, cell, paragraph, from the outside in; some may be absent."""
    page = Box("page")
    inside = [page]

    def open_kinds() -> list[str]:
        return [b.kind for b in inside]

    def leave(kind: str, left_open: bool = False) -> None:
        if kind in open_kinds():
            at = open_kinds().index(kind)
            for box in inside[at:]:
                box.left_open = left_open
            del inside[at:]

    def enter(kind: str, value: Any = None, format: Format = Format()) -> None:
        box = Box(kind, value, format)
        inside[-1].children.append(box)
        inside.append(box)

    for e in found:
        if e.kind not in ("text", "line", "tab"):
            leave("paragraph")
        match e.kind:
            case "paragraph":
                if not e.format.in_table:
                    leave("table")
                enter("paragraph", None, e.format)
            case "row" | "cell":
                if e.kind == "row":
                    leave("row", left_open=True)
                if "table" not in open_kinds():
                    enter("table", e.value if e.kind == "row" else None)
                if e.kind == "row" or "row" not in open_kinds():
                    enter("row", e.value if e.kind == "row" else None)
                if e.kind == "cell":
                    enter("cell", e.value)
            case "cell end" | "row end":
                leave(e.kind.removesuffix(" end"))
            case _:
                inside[-1].children.append(e)
    return page
