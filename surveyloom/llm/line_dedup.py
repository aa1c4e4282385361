"""Removing passages of lines that stood in an earlier document.

Lines with a word are taken three at a time, overlapping.  Of a window that occurs more than
once in the corpus, the first occurrence (by id, then text hash, then place) stays, and the lines
of every later one are removed; covered places of a text are merged before any line goes.  Lines
without a word are neither compared nor removed.

* A null text has no lines and stays null.  Null ids come last in the order of occurrences.
* Rows with equal id and text are one occurrence and are treated alike.
* A text with fewer than three such lines is left alone.  Other columns are kept as they are.
* An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.llm.common import attach_counted, settle

WINDOW = 3
WORD = "[^\\x20\\x09-\\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _places(lines: Column) -> Column:
    """Places of the lines with a word."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: lines[i].rlike(WORD))


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text hash, lines with a word, nth window, hash of its three lines)."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), _lines(F.col(text_col)).alias("l"))
    rows = rows.withColumn("l", F.filter("l", lambda x: x.rlike(WORD))).where(F.size("l") >= WINDOW)
    line = F.col("l")
    hashes = F.transform(F.sequence(F.lit(0), F.size("l") - WINDOW), lambda k: F.unhex(F.md5(F.concat_ws("\n", *[line[k + o] for o in range(WINDOW)]))))
    return rows.select("id", "text_hash", F.size("l").alias("n_words"), F.posexplode(hashes).alias("k", "hash"))


def repeated_windows(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, ks, emptied): the window numbers of later occurrences, a row per text that has any,
    and whether they cover every line with a word."""
    found = settle(windows(docs, id_col, text_col), folder, "windows")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "k")
    first = found.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = settle(first, folder, "repeated")
    later = attach_counted(found, first, ["hash"], "n", how="inner", spread_by=["id", "text_hash", "k"]).where(F.col("first") != place)
    later = later.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("k")).alias("ks"), F.max("n_words").alias("n_words"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ks", lambda k: F.array(*[k + o for o in range(WINDOW)])))))
    return settle(later.select("id", "text_hash", "ks", (covered == F.col("n_words")).alias("emptied")), folder, "later")


def dedup_lines(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_lines, n_removed, emptied): each row of ``docs`` as a struct, and its text without repeated passages."""
    later = repeated_windows(docs, folder, id_col, text_col).toDF("later_id", "later_hash", "ks", "emptied")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("later_id")) & (F.col("hash") == F.col("later_hash"))
    # Merged at every size: a list that is small now and sent to the documents would not be so on more of them.
    rows = rows.join(later.hint("merge"), same, "left").withColumn("l", _lines(F.col("text")))
    rows = rows.withColumn("p", F.when(F.col("ks").isNotNull(), _places(F.col("l"))))
    place, line = F.col("p"), F.col("l")
    covered = F.array_distinct(F.flatten(F.transform("ks", lambda k: F.array(*[place[k + o] for o in range(WINDOW)]))))
    rows = rows.withColumn("covered", covered)
    left = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), "covered")
    text = F.when(F.col("ks").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: line[i]), "\n"))
    n_lines = F.when(line.isNull(), 0).otherwise(F.size(line)).cast("long")
    n_removed = F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long")
    return rows.select("row", text.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"), F.coalesce("emptied", F.lit(False)).alias("emptied"))


def keep_first_passages(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with repeated passages removed; rows that lost lines and have no word left go.

    ``chars_col`` names a column to hold the new length in characters.
    """
    # A filter on the new text would be moved below it, and compute it again inside its own loops.
    made = dedup_lines(docs, folder, id_col, text_col).where(~F.col("emptied"))
    changed = F.col("n_removed") > 0
    new = {text_col: F.col("text")}
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        new[chars_col] = F.when(changed, F.length("text").cast(kind)).otherwise(F.col(f"row.`{chars_col}`"))
    return made.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), w AS (
  SELECT doc_id, text, place, line, row_number() OVER (PARTITION BY doc_id, text ORDER BY place) AS k
  FROM (SELECT DISTINCT doc_id, text, unnest(range(1, len(l) + 1)) AS place, unnest(l) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), g AS (
  SELECT doc_id, text, k, md5(line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o) AS hash FROM w
  WINDOW o AS (PARTITION BY doc_id, text ORDER BY k)
), r AS (
  SELECT doc_id, text, k FROM g WHERE hash IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id, k) > 1
), c AS (
  SELECT DISTINCT w.doc_id, w.text, w.place FROM r JOIN w ON w.doc_id = r.doc_id AND w.text = r.text AND w.k BETWEEN r.k AND r.k + 2
), n AS (
  SELECT doc_id, text, list(place) AS gone FROM c GROUP BY ALL
)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  md5(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: l[i]), chr(10))) AS kept_md5
FROM d LEFT JOIN n ON d.doc_id = n.doc_id AND d.text = n.text
"""
