"""Lines that many documents share, found by hashes and DataFrame functions alone.

Lines become rows of their key's hashes, document and position. They are range-partitioned by hash
and salt with a secondary sort by document (descending) and position, so each partition streams its
runs of equal hashes: the run's first row is the occurrence that stays, and the rank of its last
document is the number of documents. A hash that many documents hold is dealt out over salts, and
only one summary a run meets those of its other salts. What goes is returned to its document as a
compressed keep bitmap (the numbers of kept lines between dropped ones); no text takes part until
`without_repeats` applies the bitmaps.

Defined cases: a null or empty text is one empty line; a very long text gives a row for each of its lines;
of equal lines of the last document all stay; rows equal in doc_id and text are one document and lose
the same lines, rows of one doc_id with other texts are further documents; a null doc_id is below all
others; an empty table gives no rows; further columns, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm import common

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lines(column: str = "text") -> Column:
    return F.split(text(column), "\n", -1)


def key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def hashed_lines(docs: DataFrame, min_chars: int, salts: int) -> DataFrame:
    """h1, h2, salt, doc_id, text_hash and pos of every line whose key is long enough.

    The salt comes from the document, so the occurrences within a document stay together.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text()).alias("text_hash"), F.posexplode(lines()).alias("pos", "line"))
    keyed = rows.select("doc_id", "text_hash", "pos", key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    salt = F.pmod(F.hash("doc_id", "text_hash"), F.lit(salts))
    return keyed.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), salt.alias("salt"), "doc_id", "text_hash", "pos")


def bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, salts: int = 32) -> DataFrame:
    """doc_id, text_hash and gaps (kept lines before each dropped one) of the documents that lose lines.

    A hash that many documents hold is dealt out over `salts` runs, or as many as there are shuffle
    partitions, and every occurrence meets the summary of its own run.
    """
    salts = max(salts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = common.cut(hashed_lines(docs, min_chars, salts), splits=4)
    run_key = ["h1", "h2", "salt"]
    order = [F.desc_nulls_last("doc_id"), "text_hash"]
    ranged = found.repartitionByRange(*run_key).sortWithinPartitions(*run_key, *order, "pos")
    run = Window.partitionBy(*run_key).orderBy(*order)
    # both run along the sorted rows: nothing of a run is held back
    streamed = ranged.select(*run_key, F.first("doc_id").over(run).alias("first_doc"), F.dense_rank().over(run).alias("documents"))
    runs = streamed.groupBy(*run_key).agg(F.max("documents").alias("documents"), F.max("first_doc").alias("first_doc"))
    line = Window.partitionBy("h1", "h2")
    summed = runs.select(*run_key, F.sum("documents").over(line).alias("documents"), F.max("first_doc").over(line).alias("stays"))
    shared = summed.where(F.col("documents") >= min_docs).select(*run_key, "stays")
    # where no document has an id, none is the largest, and nothing goes
    goes = F.coalesce(F.col("doc_id") < F.col("stays"), F.col("stays").isNotNull())
    dropped = found.join(shared, run_key).where(goes)
    at = dropped.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    gaps = F.transform("at", lambda p, i: p - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("at"), i - 1) + 1))
    return at.select("doc_id", "text_hash", gaps.alias("gaps"))


def without_repeats(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, salts: int = 32) -> DataFrame:
    """docs with the remaining text, and the columns n_lines, n_dropped and gaps (replaced if there)."""
    marks = bitmaps(docs, min_chars, min_docs, salts)
    rows = docs.select(common.whole(docs).alias("row"), F.col("doc_id").cast("long").alias("own"), F.xxhash64(text()).alias("own_hash"))
    joined = rows.join(marks, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    flags = F.flatten(F.transform("gaps", lambda g: F.array_append(F.array_repeat(F.lit(True), g), F.lit(False))))
    left = F.array_join(F.zip_with(lines("row.text"), flags, lambda line, keep: F.when(F.coalesce(keep, F.lit(True)), line)), "\n")
    made = {
        "text": F.when(F.col("gaps").isNull(), text("row.text")).otherwise(left),
        "n_lines": F.size(lines("row.text")).cast("long"),
        "n_dropped": F.coalesce(F.size("gaps"), F.lit(0)).cast("long"),
        "gaps": F.col("gaps"),
    }
    return common.unpacked(joined, docs.columns, made)


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS stays FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, coalesce(doc_id < stays, FALSE) AS goes FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
