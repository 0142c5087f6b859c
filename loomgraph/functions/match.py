"""Text predicates compiled to Columns when a plan is built; none of them is a UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(column: Column) -> Column:
    """A-Z folded, everything else as it is."""
    return F.translate(column, UPPER, LOWER)


def to_like(pattern: str) -> str:
    """A pattern with a wildcard (% _ or *) is taken as it is, another one matches anywhere."""
    if pattern in ("", "*"):
        return "%"
    return pattern if any(c in pattern for c in "%_*") else f"%{pattern}%"


def like(column: Column, pattern: str) -> Column:
    """LIKE that folds ASCII case and has no escape character."""
    folded = "".join(c.lower() if c in UPPER else c for c in to_like(pattern))
    return ascii_lower(column).like(folded.replace("\\", "\\\\"))


def ends_like(column: Column, suffix: str) -> Column:
    """LIKE '%' followed by the suffix, whose own wildcards count."""
    folded = "".join(c.lower() if c in UPPER else c for c in suffix)
    return ascii_lower(column).like("%" + folded.replace("\\", "\\\\"))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _split_top(pattern: str) -> list[str]:
    parts, depth, part = [], 0, ""
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += c
    return [*parts, part]


def alternatives(pattern: str) -> list[str]:
    """The pattern without alternation: at the top level, then one parenthesised group at a time."""
    parts = _split_top(pattern)
    if len(parts) > 1:
        return [x for p in parts for x in alternatives(p)]
    start = pattern.find("(")
    depth = 0
    for i in range(start, len(pattern)) if start >= 0 else ():
        depth += (pattern[i] == "(") - (pattern[i] == ")")
        if depth == 0:
            inner = _split_top(pattern[start + 1 : i])
            return [x for p in inner for x in alternatives(pattern[:start] + p + pattern[i + 1 :])]
    return [pattern]


def regexish(column: Column, pattern: str) -> Column:
    """A small pattern language: alternation, ^whole$, and .* which otherwise is passed over."""
    found = []
    for p in alternatives(pattern):
        whole = p.startswith("^") and p.endswith("$") and len(p) >= 2
        body = p[1:-1] if whole else p
        if whole and body.startswith(".*") and body.endswith(".*") and len(body) >= 4:
            found.append(column.contains(body[2:-2]))
        elif whole and ".*" not in body:
            found.append(column == body)
        else:
            found.append(column.contains(p.replace(".*", "")))
    return any_of(found)


def glob(column: Column, pattern: str) -> Column:
    """Exact, *x*, *x, x*, or one star between a prefix and a suffix."""
    if "*" not in pattern:
        return column == pattern
    if pattern.startswith("*") and pattern.endswith("*") and len(pattern) >= 2:
        return column.contains(pattern[1:-1])
    head, _, tail = pattern.partition("*")
    return column.startswith(head) & column.endswith(tail) & (F.char_length(column) >= len(head) + len(tail))


def query_like(column: Column, pattern: str) -> Column:
    """LIKE of the query language: case-sensitive, % counts at the ends alone, _ is literal."""
    head, tail = pattern.startswith("%"), pattern.endswith("%") and len(pattern) > 1
    body = pattern[1 if head else 0 : -1 if tail else None]
    if head and tail:
        return column.contains(body)
    return column.endswith(body) if head else column.startswith(body) if tail else column == body


def integer(column: Column) -> Column:
    """The value as a 64-bit integer, or null: no blanks, fractions or overflow."""
    return F.when(column.rlike(r"^[+-]?[0-9]+$"), column.try_cast("bigint"))


def compare(column: Column, op: str, literal: str) -> Column:
    """A comparison of the query language on a field's text form; what does not parse is false."""
    text = column.cast("string")
    if op == "=":
        return text == literal
    if op == "!=":
        return text != literal
    if op == "CONTAINS":
        return text.contains(literal)
    if op == "=~":
        return regexish(text, literal)
    if op == "LIKE":
        return query_like(text, literal)
    try:
        bound = int(literal)
    except ValueError:
        return F.lit(False)
    number = integer(text)
    made = {">": number > bound, ">=": number >= bound, "<": number < bound, "<=": number <= bound}[op]
    return F.coalesce(made, F.lit(False))
