"""SQL text that Spark would read otherwise than it was meant."""

from __future__ import annotations

import re

#: Strings, quoted names and comments.
QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
#: Join words of other engines, which Spark takes for an alias of the table before them: the join then is a plain one.
UNKNOWN = re.compile(r"\b(asof|positional)\s+(?:(?:left|right|full|inner|outer|semi|anti|cross)\s+)*join\b", re.I)


def guarded(text: str) -> str:
    """The text, unless it has a join that Spark doesn't know but would run as another one."""
    found = UNKNOWN.search(QUOTED.sub(" ", text))
    if found:
        raise ValueError(f"Spark SQL has no {found.group(1).upper()} JOIN; see operators.joins")
    return text
