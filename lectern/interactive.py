"""Asks for a book's source on the terminal; runs on the driver, before any plan."""

from __future__ import annotations

from collections.abc import Callable

KINDS = {"1": "epub", "2": "markdown", "3": "generate"}
DEFAULT_TITLE, DEFAULT_AUTHOR = "Unknown title", "Unknown author"


def wizard(ask: Callable[[str], str] = input) -> dict[str, str]:
    """{input_type, path, title, author}; asks again after an unknown choice, defaults for blanks."""
    choice = ""
    while choice not in KINDS:
        choice = ask("1 EPUB, 2 Markdown folder, 3 generated book: ").strip()
    path = ask("Path: ").strip()
    if KINDS[choice] == "epub":
        return {"input_type": "epub", "path": path, "title": DEFAULT_TITLE, "author": DEFAULT_AUTHOR}
    return {"input_type": KINDS[choice], "path": path, "title": ask("Title: ").strip() or DEFAULT_TITLE, "author": ask("Author: ").strip() or DEFAULT_AUTHOR}
