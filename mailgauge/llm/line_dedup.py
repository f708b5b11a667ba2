"""Operator 9: drop lines that many documents share, natively."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm.common import BLANKS, NO_ID, ascii_lower, cut, table


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``n_lines``, ``n_dropped`` and ``kept_text``.

    Explodes the normalised lines, hashes them to 128 bits, counts distinct documents per hash, drops
    the lines over the threshold except in the largest document id that holds them, and puts the rest
    together by position. Only hashes, ids and positions are shuffled for the counting; both steps of the
    distinct count combine on the map side, so a line that most documents share costs one row a task.

    Null or empty text: one empty line, nothing dropped. Null ids count as one document below all others.
    Rows of one id count as one document; identical rows get identical results. All columns pass through, whatever
    their names, but for ones of the three added names, which are replaced. An empty table gives an empty result.
    """
    made = ("n_lines", "n_dropped", "kept_text")
    names = [c for c in docs.columns if c not in made]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__all"), F.col(f"`{id_col}`").alias("__doc"), F.col(f"`{text_col}`").alias("__text"))
    id_col, text_col = "__doc", "__text"
    ident, text = F.coalesce(F.col(id_col), F.lit(NO_ID)), F.coalesce(F.col(text_col), F.lit(""))
    row = F.xxhash64(text)
    line = F.posexplode(F.split(text, "\n", -1)).alias("__pos", "__line")
    lines = docs.select(ident.alias("__id"), row.alias("__row"), line)
    key = ascii_lower(F.btrim("__line", F.lit(BLANKS)))
    lines = lines.select("__id", "__row", "__pos", key.alias("__key")).where(F.length("__key") >= min_chars)
    hashed = lines.select("__id", "__row", "__pos", F.xxhash64("__key").alias("__h"), F.xxhash64(F.lit(9), "__key").alias("__g"))
    shared = (
        hashed.groupBy("__h", "__g", "__id").agg(F.lit(1).alias("__one"))
        .groupBy("__h", "__g").agg(F.count("*").alias("__n"), F.max("__id").alias("__last"))
        .where(F.col("__n") >= min_docs)
    )
    # Computed once: the join then meets both sides' own shuffles, whose hot partitions Spark splits.
    # In few files: of all lines only few are shared by so many.
    shared = cut(shared.repartition(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)))
    gone = hashed.join(shared, ["__h", "__g"]).where("__id <> __last").groupBy("__id", "__row").agg(F.collect_set("__pos").alias("__gone"))
    out = docs.withColumns({"__id": ident, "__row": row}).join(gone, ["__id", "__row"], "left")
    out = out.withColumns({"__lines": F.split(text, "\n", -1)})
    out = out.withColumns({"__kept": F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("__gone", F.array().cast("array<int>")))})
    return out.withColumns({
        "n_lines": F.size("__lines").cast("long"),
        "n_dropped": (F.size("__lines") - F.size("__kept")).cast("long"),
        "kept_text": F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(F.transform("__kept", lambda p: F.get("__lines", p)), "\n")),
    }).select("__all.*", *made)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), shared AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), j AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.last AS gone
  FROM k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
