"""Small helpers for writing the DuckDB twins: quoting, and patterns in the RE2 dialect."""

from __future__ import annotations

from .. import fixed_values as V


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern with Python's Unicode `\\s` and `\\S` spelled out for RE2."""
    return (pattern.replace(r"[^\s", "[^" + V.WS_CHARS)
            .replace(r"\S", V.NON_WS).replace(r"\s", V.WS))


def sub(text: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({text}, {q(re2(pattern))}, {q(replacement)}, 'g')"


def strip(text: str) -> str:
    return sub(text, rf"\A{V.WS}+|{V.WS}+\z")


def collapse(text: str) -> str:
    return sub(text, f"{V.WS}+", " ")


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(re2(pattern))}))"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, {q(V.NON_WS + '+')})"


def clean(text: str) -> str:
    text = sub(text, r"(?s)<!--.*?-->")
    text = sub(text, r"(?s)\{\{[%<].*?[%>]\}\}")
    text = sub(text, r"(?m)^\s*\{\{.*$")
    text = sub(text, r"\n{3,}", "\n\n")
    return strip(text)


def values(rows, columns: str) -> str:
    """A constant table as SQL text."""

    def cell(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)
        return q(str(v))

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {columns}"
