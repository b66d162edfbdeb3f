"""Column names and date patterns.

Record layouts write names with hyphens, Spark columns use underscores. Names
are normalised once, on both sides, and never guessed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from tallyline.errors import UnknownColumn


def column_name(name: str) -> str:
    """Hyphen form to underscore form."""
    return name.strip().replace("-", "_")


def find_column(columns: Iterable[str], name: str) -> str | None:
    """The one column that equals ``name`` up to hyphens, else up to case; None if absent."""
    columns = list(columns)
    wanted = column_name(name)
    exact = [c for c in columns if column_name(c) == wanted]
    if not exact:
        exact = [c for c in columns if column_name(c).lower() == wanted.lower()]
    if len(exact) > 1:
        raise UnknownColumn(f"{name!r} is ambiguous among {exact}")
    return exact[0] if exact else None


def require_column(columns: Iterable[str], name: str) -> str:
    """Like ``find_column`` but an absent name is an error."""
    columns = list(columns)
    found = find_column(columns, name)
    if found is None:
        raise UnknownColumn(f"{name!r} is not among {columns}")
    return found


def quoted(name: str) -> str:
    """A name as a Spark SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def date_pattern(pattern: str | None, default: str = "yyyyMMdd") -> str:
    """Upper-case year and day letters become Spark's; text in quotes is kept."""
    text = (pattern or "").strip()
    if not text:
        return default
    pieces = re.split(r"('[^']*')", text)
    return "".join(
        p if p.startswith("'") else p.replace("Y", "y").replace("D", "d") for p in pieces
    )


_TOKEN = re.compile(
    r"'(?:[^'\\]|\\.|'')*'"  # string
    r'|"(?:[^"\\]|\\.)*"'
    r"|`[^`]*`"
    r"|[A-Za-z_]\w*(?:-[A-Za-z0-9_]+)+"  # words joined by hyphens
)


def hyphen_safe(expression: str, columns: Iterable[str]) -> str:
    """Rewrite hyphenated column names inside a Spark SQL expression.

    ``A-B`` is the column ``A_B`` when there is one, otherwise a subtraction.
    The longest run of words that names a column wins. Spaced minus signs,
    strings and quoted names are left alone.
    """
    columns = list(columns)

    def replace(match: re.Match) -> str:
        token = match.group(0)
        if token[0] in "'\"":
            return token
        if token[0] == "`":
            found = find_column(columns, token[1:-1])
            return quoted(found) if found else token
        words = token.split("-")
        out, i = [], 0
        while i < len(words):
            for j in range(len(words), i, -1):
                found = find_column(columns, "-".join(words[i:j]))
                if found is not None or j == i + 1:
                    out.append(quoted(found) if found else words[i])
                    i = j
                    break
        return " - ".join(out)

    return _TOKEN.sub(replace, expression)
