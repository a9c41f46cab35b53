"""A search query's words as phrases: the query is one string, so this is done on the driver."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.text import fts_tokens

#: Characters of query syntax, which count as blanks.
SYNTAX = "*():^{}"


def words(query: str) -> list[str]:
    """The query's words: syntax characters are blanks, leading dashes are dropped."""
    out = [w.lstrip("-") for w in query.translate(str.maketrans(SYNTAX, " " * len(SYNTAX))).split()]
    return [w for w in out if w]


def expression(query: str, mode: str = "all") -> str:
    """The query in the index's own syntax: quoted phrases, all of them or (mode 'any') any; any other mode is 'all'."""
    return (" OR " if mode == "any" else " ").join('"' + w.replace('"', '""') + '"' for w in words(query))


def phrases(query: str, tokens: Callable[[str], list[str]] = fts_tokens) -> list[list[str]]:
    """Each word as a phrase of tokens; words without tokens are passed over, repeated words stay."""
    return [t for w in words(query) if (t := tokens(w))]
