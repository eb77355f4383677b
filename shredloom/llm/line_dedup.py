"""Cross-site line deduplication by distinct-site spread.

Each line's spread is the number of different ``source`` values among the documents that have it. HyperLogLog
sketches of the sources are merged by aggregation, one for each line hash; where an estimate lies so near the
threshold that its error could decide, the exact distinct count does. A line that reaches the threshold stays
in the document with the smallest id that has it, and is cut from every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shredloom.llm.text import unused
from shredloom.session import materialize

MIN_SITES = 3
LG_K = 12


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    # 128 bits: at 10^12 different lines a shared key is still improbable
    return F.struct(F.xxhash64(_bare(line)).alias("a"), F.xxhash64(_bare(line), F.lit(1)).alias("b"))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> tuple[DataFrame, DataFrame]:
    """(lines by document, lines of at least ``min_sites`` sites with the id of the document that keeps each).

    Null sources are no site; documents without an id count for the spread but keep no line.
    """
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: _bare(x) != ""), _key))
    lines = materialize(
        docs.select(F.col("doc_id").alias("__doc"), F.xxhash64("source").alias("__site"), F.col("source").isNull().alias("__none"), F.explode(keys).alias("__key"))
        .select("__doc", F.when(~F.col("__none"), F.col("__site")).alias("__site"), "__key.a", "__key.b"),
        "lines",
    )
    known = lines.groupBy("a", "b").agg(F.hll_sketch_agg("__site", lg_k).alias("__sketch"), F.min("__doc").alias("__first"))
    known = known.select("a", "b", "__first", F.hll_sketch_estimate("__sketch").alias("__sites"))
    error = 4 * 1.04 / 2 ** (lg_k / 2)
    # half a site more, as estimates are rounded
    low, high = min_sites * (1 - error) - 0.5, min_sites * (1 + error) + 0.5
    known = materialize(known.where(F.col("__sites") >= low), "spread")
    near = known.where(F.col("__sites") <= high).select("a", "b")
    exact = lines.join(near, ["a", "b"]).groupBy("a", "b").agg(F.count_distinct("__site").alias("__exact"))
    sure = known.where(F.col("__sites") > high).select("a", "b", "__first")
    proved = known.join(exact.where(F.col("__exact") >= min_sites), ["a", "b"]).select("a", "b", "__first")
    return lines, sure.unionByName(proved)


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with wide-spread lines cut from all but the first document; same columns, ``n_chars`` kept true.

    Lines are compared without spaces, tabs and carriage returns around them; blank lines never count and stay. A null
    text stays null, an empty one empty, and one of any length is taken whole. A document without id stays as it is.
    Rows that repeat an id count as one document: all of them keep the line, or none. With ``drop_emptied``, documents that
    had text and lost all of it go. An empty table stays empty. Other columns pass, whatever their names.
    """
    doc, gone, new = (unused(docs.columns, name) for name in ("doc", "cut", "text"))
    lines, wide = spread_lines(docs, min_sites, lg_k)
    cut = (
        lines.join(wide, ["a", "b"]).where("__doc is not null and __doc <> __first")
        .groupBy(F.col("__doc").alias(doc)).agg(F.collect_set(F.struct("a", "b")).alias(gone))
    )
    joined = docs.join(cut, F.col("doc_id") == F.col(doc), "left")
    kept = F.filter(_lines(F.col("text")), lambda x: ~F.array_contains(F.col(gone), _key(x)) | (_bare(x) == ""))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    joined = joined.withColumn(new, text)
    if drop_emptied:
        joined = joined.where(F.col(gone).isNull() | (_bare(F.translate(new, "\n", "")) != ""))
    out = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


_BARE = "trim(line, chr(32) || chr(9) || chr(13))"
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), wide AS (
  SELECT {_BARE} AS line, min(doc_id) AS first FROM lines WHERE {_BARE} <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), kept AS (
  SELECT l.doc_id, l.line, l.pos FROM lines l LEFT JOIN wide w ON {_BARE.replace('line', 'l.line')} = w.line
  WHERE w.line IS NULL OR w.first = l.doc_id
), texts AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM kept GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN texts t USING (doc_id)
"""
