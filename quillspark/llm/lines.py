"""Line dedup by overlapping three-line windows, on DataFrame functions only.

What counts as a line is what `cut` leaves: by default a line ends at a line feed and, within it, behind
each clause end ([.,;?] and a blank), so a passage that was set into another line is met too; with
cut=LINE_FEEDS only line feeds end lines. Every three consecutive lines make a window, told
by a hash of the lines without outer blanks; windows of fewer than `min_chars` characters don't count.
A window that occurred before, in a document of a smaller id or above in the same one, covers its
three lines; the lines covered by any such window go, all others stay as they were, joined in order.
The first occurrence of a text therefore always stays.

Null texts stay null; empty texts and texts of fewer than three lines never change. Documents of null
id come last and don't count as earlier than each other; rows that share an id don't count as
earlier than each other either. Very long texts are handled whole. Every row and every other column
stays as it was, repeated rows included, whatever the columns' names. Texts of one id are told apart by
64 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.store import fixed, fresh, hot_join, table

MIN_CHARS = 40
LINE_FEEDS = r"(?<=\n)"
CUT = r"(?<=\n)|(?<=[.,;?] )"


def window_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int, cut: str = CUT) -> DataFrame:
    """(_h, _id, _k, _pos, _again): each window; _again where the same text had it above."""
    d = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_k"), F.split(text_col, cut).alias("_lines")).filter(F.size("_lines") >= 3)
    d = fixed(d, "_own", F.transform("_lines", lambda x: F.struct(F.xxhash64(F.trim(x)).alias("h"), F.length(x).alias("n")))).drop("_lines")

    def window(i):
        a, b, c = (F.get("_own", i + k) for k in range(3))
        return F.struct(F.when(a["n"] + b["n"] + c["n"] >= min_chars, F.xxhash64(a["h"], b["h"], c["h"])).alias("h"), i.alias("pos"))

    w = F.filter(F.transform(F.sequence(F.lit(0), F.size("_own") - 3), window), lambda x: x["h"].isNotNull())
    # a repeated window follows its first in the order of (hash, position)
    d = fixed(d, "_w", F.sort_array(w)).drop("_own")
    d = d.select("_id", "_k", F.posexplode("_w").alias("_j", "_x"), "_w")
    return d.select(F.col("_x.h").alias("_h"), "_id", "_k", F.col("_x.pos").alias("_pos"), ((F.col("_j") > 0) & (F.get("_w", F.col("_j") - 1)["h"] == F.col("_x.h"))).alias("_again"))


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, cut: str = CUT) -> DataFrame:
    """(_id, _k, _gone): for each text with lines to remove, their positions."""
    w = table(window_rows(docs, id_col, text_col, min_chars, cut), "line-windows")
    seen = w.filter(~F.col("_again")).groupBy("_h").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.max(F.col("_id").isNull()).alias("_null"), F.count("*").alias("_n"))
    seen = seen.filter((F.col("_first") < F.col("_last")) | (F.col("_null") & F.col("_first").isNotNull())).select("_h", "_first", "_n")
    seen = table(seen, "line-repeats")
    # a window may be in a third of all texts: the rows of such aren't shuffled
    later = hot_join(w.filter(~F.col("_again")), seen, "_h", "_n").filter((F.col("_id") > F.col("_first")) | F.col("_id").isNull())
    gone = later.select("_id", "_k", "_pos").unionAll(w.filter("_again").select("_id", "_k", "_pos"))
    gone = gone.groupBy("_id", "_k").agg(F.collect_set("_pos").alias("_gone"))
    return gone.withColumn("_gone", F.array_distinct(F.flatten(F.transform("_gone", lambda p: F.array(p, p + 1, p + 2)))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, cut: str = CUT) -> DataFrame:
    """docs with the text deduplicated, and the columns n_lines and n_removed (with leading underscores where docs has such names)."""
    gone, gid, key, n_lines, n_removed = fresh(docs.columns, "_gone", "_gid", "_gk", "n_lines", "n_removed")
    found = table(covered(docs, id_col, text_col, min_chars, cut), "lines-gone").select(F.col("_id").alias(gid), F.col("_k").alias(key), F.col("_gone").alias(gone))
    on = F.col(id_col).eqNullSafe(F.col(gid)) & (F.xxhash64(F.col(text_col)) == F.col(key))
    # what is covered grows with the corpus, so it is never broadcast
    out = docs.join(found.hint("merge"), on, "left")
    lines = F.split(text_col, cut)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)
    count = F.coalesce(F.size(lines), F.lit(0)) if cut != CUT else F.when(F.col(text_col).isNull(), 0).otherwise(F.length(text_col) - F.length(F.regexp_replace(text_col, r"\n|(?<=[.,;?]) ", "")) + 1)
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], count.cast("long").alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_removed))


#: The rows of the op7 query, for DuckDB.
ORACLE_SQL = r"""
WITH u AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.,;?] |\n)', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents),
e AS (SELECT doc_id, unnest(range(len(l))) AS p, unnest(l) AS x FROM u),
w AS (SELECT doc_id, p, x, trim(x, ' ') || chr(2) || lead(trim(x, ' ')) OVER o || chr(2) || lead(trim(x, ' '), 2) OVER o AS k,
             length(x) + lead(length(x)) OVER o + lead(length(x), 2) OVER o AS n
        FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
c AS (SELECT doc_id, p, k, min(doc_id) OVER (PARTITION BY k) AS d, row_number() OVER (PARTITION BY k, doc_id ORDER BY p) AS r FROM w WHERE k IS NOT NULL AND n >= 40),
g AS (SELECT DISTINCT doc_id, p + s AS p FROM c, (VALUES (0), (1), (2)) AS t(s) WHERE doc_id > d OR r > 1)
SELECT u.doc_id, CASE WHEN u.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(len(u.l), 0)::BIGINT AS n_lines, coalesce(z.n, 0)::BIGINT AS n_removed
  FROM u
  LEFT JOIN (SELECT e.doc_id, string_agg(e.x, '' ORDER BY e.p) AS text FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY 1) k ON k.doc_id = u.doc_id
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY 1) z ON z.doc_id = u.doc_id
"""
