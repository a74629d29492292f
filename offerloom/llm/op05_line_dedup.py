"""Line dedup: three-line windows that occur before are found by hash, and the lines they cover go. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_names


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text that repeats some: __id, __text_hash, __gone (positions of lines covered by later occurrences).

    A window is three lines in a row, unless all are blank; it is known by 96 bits of hashes. Its first occurrence
    is the one of the smallest id (nulls first), then of the smallest text hash, then position. Windows are summed
    up before they are dealt by hash, and a hot window's occurrences meet one row only, so that Spark can split them.
    """
    lines = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text_hash"), F.split(F.col(text_col), "\n").alias("l"))
    hashed = lines.where(F.size("l") >= 3).select("__id", "__text_hash", F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"), (F.trim(x) != "").alias("full"))).alias("l"))
    window = F.transform(
        F.sequence(F.lit(1), F.size("l") - 2),
        lambda i: F.struct(
            F.xxhash64(F.get("l", i - 1)["a"], F.get("l", i)["a"], F.get("l", i + 1)["a"]).alias("a"),
            F.hash(F.get("l", i - 1)["b"], F.get("l", i)["b"], F.get("l", i + 1)["b"]).alias("b"),
            (F.get("l", i - 1)["full"] | F.get("l", i)["full"] | F.get("l", i + 1)["full"]).alias("full"),
        ),
    )
    windows = hashed.select("__id", "__text_hash", F.posexplode(window).alias("pos", "w")).where("w.full").select("__id", "__text_hash", "pos", "w.a", "w.b")
    place = F.struct("__id", "__text_hash", "pos")
    first = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    later = windows.join(first, ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    gone = F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.array(p, p + 1, p + 2))))
    return later.groupBy("__id", "__text_hash").agg(gone.alias("__gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text cut, and n_lines and n_removed; columns of these two names are replaced, all others stay.

    Lines are what "\\n" separates. Every line that lies in a later occurrence of a window goes; a text all of whose
    lines go becomes empty. Null texts stay null and have 0 lines. Texts of fewer than three lines stay. Rows that
    agree in id and text are one document and get the same. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    key, of, text_of, where = free_names(kept, "row_hash", "gone_id", "gone_hash", "gone_lines")
    rows = docs.select(*kept).withColumn(key, F.xxhash64(text_col))
    found = repeated_lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    gone = found.select(F.col("__id").alias(of), F.col("__text_hash").alias(text_of), F.col("__gone").alias(where))
    joined = rows.join(gone, rows[id_col].eqNullSafe(gone[of]) & (rows[key] == gone[text_of]), "left")
    lines = F.split(F.col(text_col), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(where))
    cut = F.when(F.col(where).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return joined.select(
        *[F.col(c) if c != text_col else cut.alias(text_col) for c in kept],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.coalesce(F.size(where), F.lit(0)).alias("n_removed"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


ORACLE_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS pos FROM l WHERE len(ls) >= 3),
t AS (SELECT doc_id, pos, ls[pos] AS a, ls[pos + 1] AS b, ls[pos + 2] AS c FROM w),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM t WHERE trim(a) <> '' OR trim(b) <> '' OR trim(c) <> ''),
g AS (SELECT DISTINCT doc_id, pos + k AS line FROM r, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1),
u AS (SELECT doc_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS x FROM l WHERE text IS NOT NULL),
k AS (SELECT u.doc_id, count(*) AS n_lines, count(g.line) AS n_removed, coalesce(string_agg(u.x, chr(10) ORDER BY u.line) FILTER (WHERE g.line IS NULL), '') AS text
      FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.line = g.line GROUP BY u.doc_id)
SELECT l.doc_id, CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed, k.text AS text
FROM l LEFT JOIN k ON l.doc_id = k.doc_id
"""
