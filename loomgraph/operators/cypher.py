"""A small graph query language, compiled to one DataFrame plan.

    MATCH (a:Label)[-[r:TYPE]->(b:Label)] [WHERE cond] RETURN item, ... [ORDER BY key, ...] [LIMIT n]

AND binds tighter than OR; there are no parentheses in conditions. Every returned cell is a string,
and so are order keys; a missing field is the empty string.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import match

TOKEN = re.compile(r"""\s*(?:(?P<text>"[^"]*"|'[^']*')|(?P<op>=~|>=|<=|!=|<>|->|[=<>(),.:\[\]*-])|(?P<word>[^\s"'=<>!(),.:\[\]*-]+))""")
NODE_FIELDS = ["id", "label", "name", "qualified_name", "file_path", "start_line", "end_line"]
OPS = {"=", "!=", ">", ">=", "<", "<=", "=~"}
DEFAULT_LIMIT = 200


class QueryError(ValueError):
    """The query is not of the language."""


@dataclass
class Pattern:
    source: str = ""
    source_label: str = ""
    edge: str | None = None
    edge_type: str = ""
    target: str = ""
    target_label: str = ""


@dataclass
class Item:
    ref: tuple[str, str] | None
    alias: str
    count: bool = False
    distinct: bool = False


@dataclass
class Query:
    pattern: Pattern
    where: list[list[tuple[tuple[str, str], str, str]]] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    order: list[tuple[tuple[str, str], bool]] = field(default_factory=list)
    limit: int | None = None


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        text, at = text.strip().rstrip(";").rstrip(), 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryError("invalid query")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def word(self, *names: str) -> str | None:
        """Takes the next token if it is one of these words or signs."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1].upper() in names:
            self.at += 1
            return self.tokens[self.at - 1][1].upper()
        return None

    def need(self, name: str) -> None:
        if not self.word(name):
            raise QueryError("unsupported query")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise QueryError("invalid query")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def maybe(self) -> str:
        return self.name() if self.at < len(self.tokens) and self.tokens[self.at][0] == "word" else ""

    def end(self, closing: str) -> tuple[str, str]:
        """[var][:label] up to the closing sign."""
        var, label = self.maybe(), ""
        if self.word(":"):
            label = self.name()
        if self.word("*"):
            raise QueryError("variable-length paths not supported")
        self.need(closing)
        return var, label

    def ref(self) -> tuple[str, str]:
        var = self.name()
        return (var, self.name()) if self.word(".") else ("", var)

    def parse(self) -> Query:
        self.need("MATCH")
        self.need("(")
        pattern = Pattern(*self.end(")"))
        if self.word("-"):
            self.need("[")
            pattern.edge, pattern.edge_type = self.end("]")
            self.need("->")
            self.need("(")
            pattern.target, pattern.target_label = self.end(")")
        query = Query(pattern)
        if self.word("WHERE"):
            query.where = [[self.predicate()]]
            while joint := self.word("AND", "OR"):
                query.where[-1].append(self.predicate()) if joint == "AND" else query.where.append([self.predicate()])
        self.need("RETURN")
        query.items = [self.item()]
        while self.word(","):
            query.items.append(self.item())
        if self.word("ORDER"):
            self.need("BY")
            query.order = [self.key()]
            while self.word(","):
                query.order.append(self.key())
        if self.word("LIMIT"):
            query.limit = int(self.name())
        if self.at < len(self.tokens):
            raise QueryError("unsupported query")
        return query

    def predicate(self) -> tuple[tuple[str, str], str, str]:
        ref = self.ref()
        op = self.word(*OPS, "CONTAINS", "LIKE")
        if not op or self.at >= len(self.tokens):
            raise QueryError("invalid query")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "op" and text == "-" and self.at < len(self.tokens):
            text += self.name()
        return ref, op, text[1:-1] if kind == "text" else text

    def item(self) -> Item:
        if self.word("COUNT"):
            self.need("(")
            while not self.word(")"):
                self.at += 1
                if self.at >= len(self.tokens):
                    raise QueryError("invalid query")
            made = Item(None, "count", count=True)
        else:
            distinct = bool(self.word("DISTINCT"))
            ref = self.ref()
            made = Item(ref, f"{ref[0]}.{ref[1]}" if ref[0] else ref[1], distinct=distinct)
        if self.word("AS"):
            made.alias = self.name()
        return made

    def key(self) -> tuple[tuple[str, str], bool]:
        ref = self.ref()
        return ref, self.word("ASC", "DESC") == "DESC"


def run(text: str, nodes: DataFrame, edges: DataFrame, max_rows: int | None = None, unlimited: bool = False) -> DataFrame:
    """The query's rows as strings. Filters, projections and joins are left to the optimiser.

    Without a LIMIT the rows are max_rows or DEFAULT_LIMIT at most, or all of them if unlimited.
    """
    query = Parser(text).parse()
    p = query.pattern
    if p.edge is None:
        rows = nodes.where(F.col("label") == p.source_label) if p.source_label else nodes
        sides = {p.source: "a"}
        rows = rows.select(F.struct(*nodes.columns).alias("a"))
        default = []
    else:
        near = nodes.where(F.col("label") == p.source_label) if p.source_label else nodes
        far = nodes.where(F.col("label") == p.target_label) if p.target_label else nodes
        used = edges.where(F.col("type") == p.edge_type) if p.edge_type else edges
        rows = near.select(F.struct(*nodes.columns).alias("a")).join(used.select(F.struct(*edges.columns).alias("r")), F.col("a.id") == F.col("r.source_id")).join(far.select(F.struct(*nodes.columns).alias("b")), F.col("b.id") == F.col("r.target_id"))
        sides = {p.source: "a", p.edge: "r", p.target: "b"}
        default = [F.col("a.name"), F.col("r.id")]
    sides.pop("", None)

    def column(ref: tuple[str, str]) -> Column:
        var, name = ref
        if var and var not in sides:
            raise QueryError("query execution failed")
        side = sides[var] if var else "a"
        plain = ["id", "type"] if side == "r" else NODE_FIELDS
        if name == "properties":
            return F.coalesce(F.to_json(F.col(f"{side}.properties")), F.lit("{}"))
        found = F.col(f"{side}.{name}") if name in plain else F.try_element_at(F.col(f"{side}.properties"), F.lit(name))
        return F.coalesce(found.cast("string"), F.lit(""))

    if query.where:
        rows = rows.where(match.any_of([match.all_of([match.compare(column(r), op, x) for r, op, x in both]) for both in query.where]))
    items = query.items
    if len(items) == 1 and items[0].count:
        return rows.agg(F.count(F.lit(1)).cast("string").alias(items[0].alias))
    columns: list[Column] = []
    for item in items:
        if item.count:
            columns.append(column(("", "count")).alias(item.alias))
        elif not item.ref[0] and item.ref[1] in sides and sides[item.ref[1]] != "r":
            columns += [column((item.ref[1], f)).alias(f"{item.ref[1]}.{f}" if len(items) > 1 else f) for f in NODE_FIELDS[:5]]
        else:
            columns.append(column(item.ref).alias(item.alias))
    ordered = []
    for ref, down in query.order:
        key = column((ref[1], "name")) if not ref[0] and ref[1] in sides else column(ref)
        ordered.append(key.desc() if down else key.asc())
    limit = query.limit if query.limit is not None else None if unlimited else max_rows or DEFAULT_LIMIT
    most = lambda df: df if limit is None else df.limit(limit)
    if items[0].distinct:
        keys = [F.expr(f"`_k{i}`").desc() if down else F.expr(f"`_k{i}`").asc() for i, (_, down) in enumerate(query.order)]
        shown = rows.select(*columns, *[column(ref).alias(f"_k{i}") for i, (ref, _) in enumerate(query.order)]).distinct()
        names = [c for c in shown.columns if not c.startswith("_k")]
        once = shown.groupBy(*[F.col(f"`{n}`") for n in names]).agg(*[(F.max if down else F.min)(f"_k{i}").alias(f"_k{i}") for i, (_, down) in enumerate(query.order)]) if keys else shown
        return most(once.orderBy(*keys, *[F.col(f"`{n}`") for n in names])).select(*[F.col(f"`{n}`") for n in names])
    first = [*ordered, *default] if p.edge is not None else [*ordered, *([] if ordered else [columns[0]]), F.col("a.id")]
    return most(rows.orderBy(*first)).select(*columns)
