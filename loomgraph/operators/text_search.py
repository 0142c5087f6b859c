"""Full-text search (BM25), line search with symbol attribution, and snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import match, rules
from loomgraph.operators.checkpoint import cut

WORDS = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def query_terms(pattern: str) -> list[list[str]] | None:
    """Terms of a search as phrases; the last token of each is a prefix. Null if nothing can be looked up."""
    found = [t.lower() for t in re.findall(r"[A-Za-z0-9_]+", pattern) if len(t) >= 2]
    return [x for x in ([p for p in t.split("_") if p] for t in found) if x] or None


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos and token of every token."""
    return docs.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def phrase_counts(found: DataFrame, phrase: list[str], key: str = "doc_id") -> DataFrame:
    """key and f: how often each document has the phrase, whose last token is a prefix."""
    *whole, last = phrase
    at = None
    for i, word in enumerate([*whole, last]):
        hit = F.col("token").startswith(word) if i == len(whole) else F.col("token") == word
        here = found.where(hit).select(key, (F.col("pos") - i).alias("begin"))
        at = here if at is None else at.join(here, [key, "begin"])
    return at.groupBy(key).agg(F.count(F.lit(1)).alias("f"))


def _begins(prefix: str):
    return lambda t: t.startswith(prefix)


def bm25(docs: DataFrame, terms: list[list[str]], key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and rank (negative; smaller is better) of the documents that have all terms.

    Tokens are counted in place for single-word terms, so the corpus is not exploded for them; phrases
    go through postings of the documents alone.
    """
    names = [f"_f{i}" for i in range(len(terms))]
    single = {f: p[0] for f, p in zip(names, terms) if len(p) == 1}
    counts = [F.size(F.filter("_tokens", _begins(p))).alias(f) for f, p in single.items()]
    sized = docs.select(key, tokens(F.col(text)).alias("_tokens")).select(key, F.size("_tokens").alias("_size"), *counts)
    for f, phrase in zip(names, terms):
        if f not in single:
            sized = sized.join(phrase_counts(postings(docs, key, text), phrase, key).withColumnRenamed("f", f), key, "left").fillna(0, [f])
    sized = cut(sized)  # a few numbers a document: the texts are read once
    stats = sized.agg(F.count(F.lit(1)).alias("_n"), F.avg("_size").alias("_avg"), *[F.sum(F.when(F.col(f) > 0, 1).otherwise(0)).alias(f"_df{f}") for f in names])
    scored = sized.where(match.all_of([F.col(f) > 0 for f in names])).crossJoin(F.broadcast(stats))  # a single row
    rank = F.lit(0.0)
    for f in names:
        n = F.col(f"_df{f}")
        idf = F.greatest(F.log((F.col("_n") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        rank = rank - idf * F.col(f) * (k1 + 1) / (F.col(f) + k1 * (1 - b + b * F.col("_size") / F.col("_avg")))
    return scored.select(key, rank.alias("rank"))


def search_nodes(ranked: DataFrame, nodes: DataFrame, key: str = "file_path") -> DataFrame:
    """The nodes of the ranked documents, better kinds of symbols first."""
    hidden = ["File", "Folder", "Module", "Section", "Variable", "Project"]
    return nodes.where(~F.col("label").isin(hidden)).join(ranked, key).withColumn("rank", F.col("rank") - rules.bm25_boost(F.col("label")))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 1) and content of every line."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("_i", "content")).select(key, (F.col("_i") + 1).alias("line"), "content")


def grep(docs: DataFrame, pattern: str, regex: bool = False, path_filter: str = "", file_pattern: str = "", key: str = "file_path", text: str = "text") -> DataFrame:
    """key, line and content of the lines that match."""
    if path_filter:
        docs = docs.where(match.regexish(F.col(key), path_filter))
    if file_pattern:
        docs = docs.where(match.glob(F.col(key), file_pattern))
    hit = match.regexish(F.col("content"), pattern) if regex else F.col("content").contains(pattern)
    return lines(docs, key, text).where(hit)


def attributed(hits: DataFrame, symbols: DataFrame, key: str = "file_path") -> DataFrame:
    """Each hit with the smallest symbol span that holds its line, else the file's module, else none."""
    spans = symbols.where("label not in ('Module', 'File', 'Folder', 'Project')").select(F.col(key).alias("_key"), F.col("id").alias("symbol_id"), "name", "label", "start_line", "end_line")
    inside = (F.col(key) == F.col("_key")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    place = F.row_number().over(Window.partitionBy(key, "line").orderBy(F.asc_nulls_last(F.col("end_line") - F.col("start_line")), F.desc("name"), "symbol_id"))
    found = hits.join(spans, inside, "left").withColumn("_place", place).where("_place = 1").drop("_place", "_key")
    modules = symbols.where("label = 'Module'").groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct("id", "name"), "id").alias("_m"))
    whole = found.join(modules, F.col(key) == F.col("_key"), "left")
    own = F.col("symbol_id").isNull()
    return whole.withColumn("label", F.when(own & F.col("_m").isNotNull(), "Module").otherwise(F.col("label"))).withColumn("name", F.when(own, F.col("_m.name")).otherwise(F.col("name"))).withColumn("symbol_id", F.coalesce("symbol_id", "_m.id")).drop("_m", "_key")


def by_symbol(attributed_hits: DataFrame, key: str = "file_path") -> DataFrame:
    """One row a symbol (or line without one) with its match lines."""
    alone = F.when(F.col("symbol_id").isNull(), F.col("line"))
    return attributed_hits.groupBy(key, "symbol_id", alone.alias("alone")).agg(F.first("name").alias("name"), F.first("label").alias("label"), F.first("start_line").alias("start_line"), F.first("end_line").alias("end_line"), F.array_sort(F.collect_set("line")).alias("match_lines"))


def folded(hits: DataFrame, key: str = "file_path") -> DataFrame:
    """Without hits all of whose lines lie in the span of a better-ranked hit of the same file."""
    inner = hits.withColumn("_rank", rules.grep_rank(F.coalesce("label", F.lit(""))))
    outer = inner.select(F.col(key).alias("_key"), F.col("symbol_id").alias("_id"), F.col("_rank").alias("_better"), F.col("start_line").alias("_from"), F.col("end_line").alias("_to"))
    lies = (F.col(key) == F.col("_key")) & (F.col("_better") < F.col("_rank")) & (F.array_min("match_lines") >= F.col("_from")) & (F.array_max("match_lines") <= F.col("_to"))
    return inner.join(outer, lies, "left_anti").drop("_rank")


def ranked(hits: DataFrame, limit: int, key: str = "file_path") -> DataFrame:
    """Ranked before it is cut."""
    return hits.orderBy(rules.grep_rank(F.coalesce("label", F.lit(""))), key, F.coalesce("start_line", F.lit(0)), "name", F.array_min("match_lines")).limit(limit)


def slice_lines(text: Column, start: Column, end: Column, context: int = 0) -> Column:
    """Lines start..end (from 1) with some around them."""
    all_lines = F.split(text, "\n", -1)
    first = F.greatest(start - context, F.lit(1))
    last = F.least(end + context, F.size(all_lines))
    return F.array_join(F.slice(all_lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def sections(text: Column) -> Column:
    """The heading lines of a markdown text."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.startswith("#"))


def snippet(nodes: DataFrame, wanted: str, limit: int = 10) -> DataFrame:
    """The symbol of an exact qualified name, else of a suffix if one alone has it, else suggestions."""
    exact = nodes.where(F.col("qualified_name") == wanted).withColumn("match_method", F.lit("exact"))
    suffix = nodes.where(match.ends_like(F.col("qualified_name"), wanted) & (F.col("qualified_name") != wanted)).withColumn("match_method", F.lit("suffix"))
    both = exact.unionByName(suffix)
    sums = both.agg(F.count_if(F.col("match_method") == "exact").alias("_exact"), F.count(F.lit(1)).alias("_all"))
    counted = both.crossJoin(F.broadcast(sums))  # a single row
    chosen = counted.where((F.col("_exact") == 0) | (F.col("match_method") == "exact"))
    return chosen.withColumn("match_method", F.when((F.col("_exact") == 0) & (F.col("_all") > 1), "ambiguous").otherwise(F.col("match_method"))).drop("_exact", "_all").orderBy("qualified_name", "id").limit(limit)


def by_stem(nodes: DataFrame, wanted: str) -> DataFrame:
    """The one symbol of `path.name` whose file is called so but for its extension; none where several are."""
    stem, _, name = wanted.rpartition(".")
    bare = F.regexp_replace("file_path", r"\.[^./]*$", "")
    near = (bare == stem) | bare.endswith(f"/{stem}") | (F.translate(bare, "/", ".") == stem) | F.translate(bare, "/", ".").endswith(f".{stem}")
    found = nodes.where((F.col("name") == name) & near & F.lit(bool(stem and name)))
    alone = found.agg(F.count(F.lit(1)).alias("_n"))
    return found.crossJoin(F.broadcast(alone)).where("_n = 1").drop("_n").withColumn("match_method", F.lit("suffix"))  # a single row


def hit_counts(hits: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """One row: total_lines, total (symbols), dedup_ratio (the share of lines that symbols save) and has_more."""
    lines_ = hits.agg(F.count(F.lit(1)).alias("total_lines"))
    symbols = found.agg(F.count(F.lit(1)).alias("total"))
    ratio = F.when(F.col("total_lines") > 0, 1 - F.col("total") / F.col("total_lines")).otherwise(0.0)
    return lines_.crossJoin(symbols).select("total_lines", "total", ratio.alias("dedup_ratio"), (F.col("total") > limit).alias("has_more"))  # two single rows


def candidates(docs: DataFrame, terms: list[list[str]], limit: int, key: str = "file_path") -> DataFrame:
    """The keys of the documents that rank best for a search: eight for each row asked for, 32 at least."""
    return bm25(docs, terms, key).orderBy("rank", key).limit(max(8 * limit, 32)).select(key)
