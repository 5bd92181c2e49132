"""A walk over the boxes of a rich text that gives its HTML."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

from .formatting import Format
from .layout import Box, RowShape

# fixed values: class names and texts of the HTML output
LINK, IMAGE, TABLE, IMAGE_CELL, TEXT_CELL = "tis-cross-ref", "tis-inline-image", "tis-layout-table", "tis-img-cell", "tis-text-cell"
ALT = "Technical illustration"
_ENTITIES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"})
_BREAKS = {"line": "<br>", "tab": "&emsp;"}
_TWIPS_A_POINT = 20

# what the walk yields: (kind, HTML or text, format); kinds are html, break, text, and end (of a paragraph)
Part = tuple[str, str, Format]


def tenths(x: float) -> str:
    """Rounded to one decimal, halves upwards, whole numbers without it."""
    n = math.floor(x * 10 + 0.5)
    return str(n // 10) if n % 10 == 0 else repr(n / 10)


def style(lengths: dict[str, int]) -> str:
    """A style attribute of lengths in points, if there are any."""
    shown = [f"{name}:{tenths(x / _TWIPS_A_POINT)}pt" for name, x in lengths.items()]
    return f' style="{";".join(shown)}"' if shown else ""


def paragraph_style(f: Format) -> str:
    lengths = {"margin-left": f.left, "margin-right": f.right, "text-indent": f.first, "margin-top": f.before, "margin-bottom": f.after}
    return style({name: x for name, x in lengths.items() if x > 0 or x and name == "text-indent"})


def table_style(shape: RowShape | None) -> str:
    if shape is None:
        return ""
    lengths = {"margin-left": shape.left, "width": shape.edges[-1] - shape.left if shape.edges else 0}
    return style({name: x for name, x in lengths.items() if x > 0})


def column_shares(shape: RowShape) -> list[str]:
    """Column widths in per cent."""
    widths = [max(0, right - left) for left, right in zip((shape.left, *shape.edges), shape.edges, strict=False)]
    total = sum(widths)
    return [tenths(math.floor(w * 1000 / total + 0.5) / 10) for w in widths] if total else []


def cell_attributes(holds: frozenset[str], share: str | None) -> str:
    kind = {frozenset({"picture"}): IMAGE_CELL, frozenset({"text"}): TEXT_CELL}.get(holds)
    return (f' class="{kind}"' if kind else "") + (f' style="width:{share}%"' if share is not None else "")


def walk(page: Box, image_base: str) -> Iterator[Part]:
    shares: Iterator[str] = iter(())  # of the columns to come; a row without a shape goes on with what is left

    def html(text: str) -> Part:
        return "html", text, Format()

    def visit(box: Box) -> Iterator[Part]:
        nonlocal shares
        end = ""
        match box.kind:
            case "table":
                yield html(f'<table class="{TABLE}"{table_style(box.value)}>\n<tbody>\n')
                end = "</tbody>\n</table>\n"
            case "row":
                if box.value is not None:
                    shares = iter(column_shares(box.value))
                yield html("<tr>")
                end = "</tr>\n"
            case "cell":
                yield html(f"<td{cell_attributes(box.value, next(shares, None))}>")
                end = "</td>"
            case "paragraph":
                yield html(f"<p{paragraph_style(box.format)}>")
        for x in box.children:
            if isinstance(x, Box):
                yield from visit(x)
            elif x.kind == "picture":
                yield html(f'<img src="{image_base}/{x.value}" alt="{ALT}" class="{IMAGE}" loading="lazy" />\n')
            elif x.kind == "text":
                yield "text", x.value, x.format
            else:
                yield "break", _BREAKS[x.kind], x.format
        if box.kind == "paragraph":
            yield "end", "</p>\n", Format()
        elif end and not box.left_open:
            yield html(end)

    return visit(page)


def _ends_link(part: Part) -> bool:
    kind, _, f = part
    return kind in ("break", "end") or kind == "text" and not f.struck


def write_html(page: Box, image_base: str) -> str:
    """Struck texts between two things that end a link are one link, numbered by first appearance.

    The tags of a plain text end where the next text or the end of its paragraph comes, those of a struck one at once.
    After a picture, text stands in no paragraph: what is open there is ended by what comes next, or not at all."""
    parts = list(walk(page, image_base))
    stretch = accumulate(map(_ends_link, parts))
    numbers: dict[int, int] = {}  # of links by the stretch they are in
    out, ends = [], ""
    for part, k in zip(parts, stretch, strict=True):
        kind, text, f = part
        if kind in ("text", "end"):
            out.append(ends)
            ends = ""
        if _ends_link(part) and k - 1 in numbers:
            out.append("</a>")
        if kind != "text":
            out.append(text)
            continue
        if f.struck and k not in numbers:
            numbers[k] = len(numbers) + 1
            out.append(f'<a class="{LINK}" data-hotspot="{numbers[k]}" href="#">')
        tags = [tag for tag, on in (("strong", f.bold), ("em", f.italic), ("u", f.underline)) if on]
        shown = text.translate(_ENTITIES)
        if f.raised and not f.struck:
            tag = "sup" if f.raised > 0 else "sub"
            shown = f"<{tag}>{shown}</{tag}>"
        out += [*(f"<{tag}>" for tag in tags), shown]
        ends = "".join(f"</{tag}>" for tag in reversed(tags))
        if f.struck:
            out.append(ends)
            ends = ""
    return "".join(out)


def link_texts(page: Box) -> list[str]:
    """The shown text of every link, in order of its number."""
    parts = list(walk(page, ""))
    found: dict[int, str] = {}
    for (kind, text, f), k in zip(parts, accumulate(map(_ends_link, parts)), strict=True):
        if kind == "text" and f.struck:
            found[k] = found.get(k, "") + text
    return list(found.values())
