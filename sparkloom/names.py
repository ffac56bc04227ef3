"""Names of columns that don't clash with a caller's."""

from __future__ import annotations

from collections.abc import Iterable


def unused(names: Iterable[str], columns: Iterable[str]) -> list[str]:
    """The names, with underscores behind those that (whatever their case) a column has."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
