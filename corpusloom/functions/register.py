"""SQL functions for users of ``spark.sql``: rules as native SQL functions, chunking and extraction as table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corpusloom.functions import text
from corpusloom.functions.dialect import SPARK


def register(spark: SparkSession) -> None:
    """``tokenize``, ``content_hash``, ``canonicalize_url``, ``url_domain``, ``query_profile``, ``make_snippet``; ``chunk_text`` and ``extract_page_documents`` for LATERAL."""
    functions = {
        "tokenize(t STRING) RETURNS ARRAY<STRING>": text.tokens(SPARK, "t"),
        "content_hash(t STRING) RETURNS STRING": text.content_hash(SPARK, "t"),
        "canonicalize_url(t STRING) RETURNS STRING": text.canonical_url(SPARK, "t"),
        "url_domain(t STRING) RETURNS STRING": text.domain_of(SPARK, "t"),
        "query_profile(t STRING) RETURNS STRING": text.query_profile(SPARK, "t"),
        "make_snippet(t STRING, q STRING) RETURNS STRING": text.snippet(SPARK, "t", "q"),
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @udtf(returnType="chunk_no int, chunk string")
    class ChunkText:
        def eval(self, t: str):
            from corpusloom.operators.pages import chunks

            yield from enumerate(chunks(t))

    @udtf(returnType="title string, text string, url string, source string")
    class ExtractPageDocuments:
        def eval(self, html: str, url: str, default_title: str):
            from corpusloom.operators.pages import page_documents

            for d in page_documents(html, url or "", default_title or ""):
                yield d["title"], d["text"], d["url"], d["source"]

    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("extract_page_documents", ExtractPageDocuments)
