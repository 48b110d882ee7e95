"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines (spaces around a line don't count) is hashed to 128 bits. A window found at more
than one place of the corpus is kept where it comes first, by document id and then line, and the lines that its later
occurrences cover are removed; overlapping covers merge.

Scale: the windows are aggregated on their hash with a partial aggregate, so that a window in a third of all documents
is one row per task; the repeated ones are written to the shared folder and joined back with an exchange on both
sides, which lets adaptive execution split a hot hash. Nothing is gathered beyond one document's own lines.

Defined results: a null text stays null and has no lines; a text of fewer than three lines, and a window of blank lines only,
is left alone; rows of the same id and text are one document, and all its copies keep the same lines; a null id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import materialize

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """h (binary), doc_id, th (hash of the text) and pos of every window; pos counts from 0."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    df = df.select("doc_id", F.xxhash64("text").alias("th"), F.transform(_lines(F.col("text")), lambda x: F.trim(x)).alias("lines"))
    df = df.filter(F.size("lines") >= size)
    at = lambda i: F.array_join(F.slice("lines", i + 1, size), "\n")
    df = df.select("doc_id", "th", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lines") - size), at)).alias("pos", "w"))
    return df.filter(F.length(F.replace("w", F.lit("\n"), F.lit(""))) > 0).select(F.unhex(F.md5("w")).alias("h"), "doc_id", "th", "pos")


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """`docs` with the text's repeated lines removed, and n_lines and n_removed (long); columns of these names are replaced."""
    place = F.struct("doc_id", "th", "pos")
    groups = windows(docs, text_col, id_col, size).groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeats = materialize(groups.filter(~F.col("first").eqNullSafe(F.col("last"))).select(F.col("h").alias("__h"), "first"), "repeats")
    later = windows(docs, text_col, id_col, size).join(repeats.hint("merge"), F.col("h") == F.col("__h")).filter(~place.eqNullSafe(F.col("first")))
    starts = later.groupBy(F.col("doc_id").alias("__lx_id"), F.col("th").alias("__lx_th")).agg(F.sort_array(F.collect_set("pos")).alias("__lx_starts"))
    starts = materialize(starts, "starts")
    # a merge at every size: neither table has a bound that would let it be broadcast
    joined = docs.join(starts.hint("merge"), docs[id_col].eqNullSafe(F.col("__lx_id")) & (F.xxhash64(docs[text_col]) == F.col("__lx_th")), "left")

    lines, n = _lines(F.col(text_col)), F.size(_lines(F.col(text_col)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("kept"))

    def step(acc: Column, start: Column) -> Column:
        gap = F.array(F.struct(acc["at"].alias("start"), start.alias("end")))
        kept = F.when(start > acc["at"], F.concat(acc["kept"], gap)).otherwise(acc["kept"])
        return F.struct(F.greatest(acc["at"], start + size).alias("at"), kept.alias("kept"))

    tail = lambda acc: F.when(acc["at"] < n, F.concat(acc["kept"], F.array(F.struct(acc["at"].alias("start"), n.alias("end"))))).otherwise(acc["kept"])
    kept = F.aggregate("__lx_starts", zero, step, tail)
    joined = joined.withColumn("__lx_kept", kept)
    left = F.flatten(F.transform("__lx_kept", lambda s: F.slice(lines, s["start"] + 1, s["end"] - s["start"])))
    n_left = F.aggregate("__lx_kept", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    out = joined.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long"))
    out = out.withColumn("n_removed", F.when(F.col("__lx_kept").isNull(), 0).otherwise(n - n_left).cast("long"))
    out = out.withColumn(text_col, F.when(F.col("__lx_kept").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")))
    return out.drop("__lx_id", "__lx_th", "__lx_starts", "__lx_kept")


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(range(0, len(lines) - 2)) AS pos, lines FROM (SELECT DISTINCT doc_id, lines FROM l) WHERE len(lines) >= 3),
h AS (SELECT doc_id, pos, trim(lines[pos + 1], ' ') || chr(10) || trim(lines[pos + 2], ' ') || chr(10) || trim(lines[pos + 3], ' ') AS w FROM w),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM h WHERE length(replace(w, chr(10), '')) > 0),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM r WHERE k > 1),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string([x FOR x, i IN string_split(text, chr(10)) IF NOT list_contains(gone, i - 1)], chr(10)) END AS text
FROM documents d LEFT JOIN g USING (doc_id)
"""
