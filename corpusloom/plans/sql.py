"""Running a statement of both dialects over the tables of a folder."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions.dialect import DUCK, SPARK, Spark
from corpusloom.runtime import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings trusted_sources eval_cases documents_in nexus_documents index_events mix_targets".split()
Statement = Callable[[Spark], str]


def run(spark: SparkSession, sf_dir: str, statement: Statement, **frames: DataFrame) -> DataFrame:
    """The statement as a lazy DataFrame; only the tables it names are read, columns and filters are pushed down."""
    sql = statement(SPARK)
    for t in TABLES:
        if t not in frames and re.search(rf"\b{t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def both(statements: dict[str, Statement]) -> tuple[dict, dict[str, str]]:
    """Queries and checking SQL of statements that need nothing but tables."""
    queries = {k: (lambda spark, d, s=s: run(spark, d, s)) for k, s in statements.items()}
    return queries, {k: s(DUCK) for k, s in statements.items()}
