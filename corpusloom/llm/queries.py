"""Queries of the corpus preparation operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import boilerplate, bpe, mixture, near_duplicates, repeated_lines, shared_spans, splitting
from corpusloom.runtime import spread
from corpusloom.runtime import table as read_table

#: White space for a regular expression engine whose \s is ASCII only.
WS = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f"
ROW = ["shard_id", "document_id"]


def table(spark, d, name):
    return spread(read_table(spark, d, name))



def _mix(spark, d):
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def both_texts(spark, d):
    """The records of the two tables of page texts under one key."""
    a = table(spark, d, "nexus_documents").select(F.lit("nexus_documents").alias("tab_name"), F.concat_ws("/", "shard_id", "document_id").alias("rec_key"), F.col("body").alias("text"), repeated_lines.site_of(F.col("url"), F.col("source")).alias("site"))
    return a.unionByName(table(spark, d, "documents_in").select(F.lit("documents_in").alias("tab_name"), F.col("input_id").cast("string").alias("rec_key"), "text", repeated_lines.site_of(F.col("url"), F.col("source")).alias("site")))


KEY = ["tab_name", "rec_key"]

def _near(spark, d, ordered=False):
    """Runs of three words, similarity 0.6, as this project states the problem."""
    return near_duplicates.NearDuplicates(table(spark, d, "nexus_documents"), ROW, "body", k=3, threshold=0.6, ordered=ordered)


def _coverage(spark, d):
    """Of every document, how many of its characters stand in others too."""
    docs = table(spark, d, "documents")
    spans = shared_spans.shared_spans(docs).groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"), F.count("*").alias("stretches"))
    return docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")).join(spans, "doc_id", "left").na.fill(0, ["shared_chars", "stretches"])


QUERIES = {
    "p1_found": lambda spark, d: repeated_lines.repeated_lines(table(spark, d, "nexus_documents"), ROW),
    "p1_clean": lambda spark, d: repeated_lines.without_repeated_lines(table(spark, d, "nexus_documents"), ROW),
    "p1_sequences": lambda spark, d: repeated_lines.repeated_lines(table(spark, d, "nexus_documents"), ROW, sequence_rows=4),
    "p2_found": lambda spark, d: boilerplate.furniture_lines(both_texts(spark, d), KEY, "text", "site"),
    "p2_content": lambda spark, d: boilerplate.main_content(both_texts(spark, d), KEY, "text", "site"),
    "p3_found": lambda spark, d: splitting.collapsed_lengths(both_texts(spark, d), KEY, "text").where(F.col("n_chars") > splitting.LIMIT).select(*KEY),
    "p3_lengths": lambda spark, d: splitting.collapsed_lengths(both_texts(spark, d), KEY, "text"),
    "p3_pieces": lambda spark, d: splitting.split_pieces(both_texts(spark, d), KEY, "text"),
    "p3_ranged": lambda spark, d: splitting.split_pieces(both_texts(spark, d), KEY, "text", range_bytes=8192),
    "p5_found": lambda spark, d: _near(spark, d).pairs("document_id"),
    "p5_groups": lambda spark, d: _near(spark, d).groups("document_id"),
    "p5_edits": lambda spark, d: _near(spark, d, ordered=True).groups("document_id"),
    "p6_ids": lambda spark, d: bpe.encode_corpus(table(spark, d, "documents")),
    "p7_found": lambda spark, d: mixture.short_sources(_mix(spark, d)),
    "p7_shares": lambda spark, d: _mix(spark, d).shares,
    "p7_uses": lambda spark, d: _mix(spark, d).uses,
    "p8_found": lambda spark, d: shared_spans.shared_spans(table(spark, d, "documents")),
    "p8_coverage": _coverage,
}

_LINES = f"""n AS (SELECT shard_id, document_id, body,
    CASE WHEN length(url) > 0 THEN regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '')
         ELSE regexp_replace(regexp_replace(lower(source), '^trusted-docs:', ''), '^www\\.', '') END AS site FROM nexus_documents),
  x AS (SELECT shard_id, document_id, site, string_split(body, chr(10)) AS a FROM n),
  l AS (SELECT shard_id, document_id, site, unnest(a) AS line, generate_subscripts(a, 1) AS line_no FROM x),
  k AS (SELECT *, lower(regexp_replace(line, '[{WS}0-9]+', '', 'g')) AS id FROM l),
  f AS (SELECT site, id FROM k WHERE id <> '' AND site IS NOT NULL GROUP BY site, id HAVING count(DISTINCT (shard_id, document_id)) >= 8)"""

_BOTH = """(SELECT 'nexus_documents' AS tab_name, shard_id || '/' || document_id AS rec_key, body AS text FROM nexus_documents
    UNION ALL SELECT 'documents_in', input_id::VARCHAR, text FROM documents_in)"""
_LENGTHS = f"SELECT tab_name, rec_key, coalesce(length(regexp_replace(regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g'), '[{WS}]+', ' ', 'g')), 0) AS n_chars FROM {_BOTH}"

_NEAR = """w AS (SELECT DISTINCT document_id, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+') AS a FROM nexus_documents),
  g AS (SELECT DISTINCT document_id, a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] AS s FROM (SELECT *, unnest(range(1, len(a) - 1)) AS i FROM w WHERE len(a) >= 3)),
  n AS (SELECT document_id, count(*) AS n FROM g GROUP BY 1),
  b AS (SELECT x.document_id AS a, y.document_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.document_id < y.document_id GROUP BY 1, 2)"""

_WINDOWS = """w AS (SELECT doc_id, unnest(range(0, length(text) - 199)) AS p, text FROM documents WHERE length(text) >= 200),
  h AS (SELECT doc_id, p, hash(substring(text, p + 1, 200)) AS h FROM w),
  s AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
  c AS (SELECT DISTINCT doc_id, p FROM h SEMI JOIN s USING (h)),
  f AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM c),
  r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM f),
  spans AS (SELECT doc_id, min(p) AS start_char, max(p) + 200 AS end_char FROM r GROUP BY doc_id, run)"""

ORACLE = {
    "p5_found": f"WITH {_NEAR} SELECT b.a AS document_id_a, b.b AS document_id_b FROM b JOIN n x ON x.document_id = b.a JOIN n y ON y.document_id = b.b WHERE b.c >= 0.6 * (x.n + y.n - b.c)",
    "p8_found": f"WITH {_WINDOWS} SELECT * FROM spans",
    "p8_coverage": f"""WITH {_WINDOWS}, t AS (SELECT doc_id, sum(end_char - start_char)::BIGINT AS shared_chars, count(*) AS stretches FROM spans GROUP BY 1)
        SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(stretches, 0) AS stretches FROM documents LEFT JOIN t USING (doc_id)""",
    "p3_found": f"SELECT tab_name, rec_key FROM ({_LENGTHS}) WHERE n_chars > 1800",
    "p3_lengths": _LENGTHS,
    "p1_found": f"WITH {_LINES} SELECT shard_id, document_id, line_no FROM k JOIN f USING (site, id)",
    "p1_sequences": f"""WITH {_LINES}, q AS (SELECT a.site, a.shard_id, a.document_id, a.id AS x, b.id AS y, a.line_no AS i, b.line_no AS j FROM (SELECT * FROM k WHERE id <> '' AND site IS NOT NULL) a
          JOIN (SELECT * FROM k WHERE id <> '') b ON a.shard_id = b.shard_id AND a.document_id = b.document_id AND a.line_no < b.line_no),
        o AS (SELECT site, x, y FROM q GROUP BY ALL HAVING count(DISTINCT (shard_id, document_id)) >= 4), s AS (SELECT q.* FROM q SEMI JOIN o USING (site, x, y))
        SELECT shard_id, document_id, line_no FROM k JOIN f USING (site, id) UNION SELECT shard_id, document_id, i FROM s UNION SELECT shard_id, document_id, j FROM s""",
    "p1_clean": f"""WITH {_LINES}, m AS (SELECT k.*, f.id IS NULL AS keep FROM k LEFT JOIN f USING (site, id))
        SELECT shard_id, document_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE keep), '') AS body FROM m GROUP BY ALL""",
}
