"""Rich text to HTML: a lexer, formats, a tree of boxes, and a walk that gives HTML."""

from .formatting import formatted, with_pictures
from .html import link_texts, write_html
from .layout import Box, events, tree, with_cells
from .lexer import tokens


def read(text: str, placeholders: dict[str, str] | None = None) -> Box:
    """The tree of a rich text."""
    return tree(with_cells(events(with_pictures(formatted(tokens(text))), placeholders or {})))


def rtf_to_html(text: str, placeholders: dict[str, str] | None = None, image_base: str = "/api/images") -> str:
    """HTML of a rich text. If anything goes wrong, the text itself in a pre element."""
    try:
        return write_html(read(text, placeholders), image_base)
    except Exception:  # the contract of the operator: a damaged document is shown as it is
        return '<pre style="white-space:pre-wrap">' + text.replace("<", "&lt;") + "</pre>"


def rtf_links(text: str, placeholders: dict[str, str] | None = None) -> list[str]:
    """The texts of a rich text's links, the first being link 1. A damaged document has none."""
    try:
        return link_texts(read(text, placeholders))
    except Exception:  # as in `rtf_to_html`
        return []
