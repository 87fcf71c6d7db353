"""Names of columns that an operator adds for itself."""

from __future__ import annotations


def unused(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as no column of that name (in any case) needs."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
