"""Sources and sinks of files: document arrays, source registry, labelled cases and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import materialise, numbered

DOCUMENT = "title string, text string, url string, source string"
REGISTRY = "name string, seed string, domain string, category string, tier string, max_pages int, max_depth int, seeds array<string>"
CASE = "id string, category string, query string, expected_decision array<string>, preferred_domains array<string>, acceptable_domains array<string>, must_cite boolean, notes string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents of a JSON array and the rejected ones; a missing file has none.

    Rejected are titles that are empty or over 300 characters and texts under 20.
    """
    df = spark.read.schema(DOCUMENT).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], DOCUMENT)
    ok = F.coalesce(F.length("title").between(1, 300) & (F.length("text") >= 20), F.lit(False))
    return df.where(ok).withColumn("source", F.coalesce("source", F.lit("manual"))), df.where(~ok)


def registry(spark: SparkSession, path: str, tier: str | None = None, name: str | None = None) -> DataFrame:
    """Registered sites of a tier or with a part of a name; seeds default to the seed, page limits are kept in 1..100."""
    df = spark.read.schema(REGISTRY).json(path, multiLine=True)
    if tier:
        df = df.where(F.lower(F.trim("tier")) == tier.lower())
    if name:
        df = df.where(F.contains(F.lower("name"), F.lit(name.lower())))
    return df.withColumn("seeds", F.coalesce("seeds", F.array("seed"))).withColumn("max_pages", F.greatest(F.lit(1), F.least(F.lit(100), "max_pages")))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases of a file of JSON lines; blank lines are skipped, a malformed one fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", CASE, {"mode": "FAILFAST"}).alias("c")).select("c.*")


def report(results: DataFrame, summary: DataFrame, path: str, title: str, rows: int = 1000) -> None:
    """Full results as JSON lines, written by all tasks, and a Markdown table of a summary, whose first ``rows`` rows it has (it says so where there are more)."""
    results.write.mode("overwrite").json(f"{path}/results")
    got = [r.asDict() for r in summary.limit(rows + 1).collect()]
    more, rows = len(got) > rows, got[:rows]
    head = list(rows[0]) if rows else summary.columns
    table = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(r[c]) for c in head) + " |" for r in rows), *(["", f"The summary goes on beyond {len(rows)} rows."] if more else [])]
    spark = results.sparkSession
    spark.createDataFrame([("\n".join(table),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")


def exposition(metrics: DataFrame) -> str:
    """Text form of metrics (name, labels map, value); the table is small, one row per series."""
    out = []
    for r in metrics.orderBy("name").collect():
        labels = ",".join(f'{k}="{v}"' for k, v in sorted((r["labels"] or {}).items()))
        out.append(f"{r['name']}{{{labels}}} {r['value']}" if labels else f"{r['name']} {r['value']}")
    return "\n".join(out) + "\n"


def generated(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` documents drawn from ``docs`` with a numbered suffix, for load tests."""
    spark = docs.sparkSession
    pool = materialise(numbered(docs.select("doc_id", "title", "text"), [], ["doc_id"], "i"), "pool")
    size = pool.count()
    picks = spark.range(n).select(F.col("id").alias("n"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, size))).alias("i"))
    return picks.join(pool, "i").select("n", F.concat("title", F.lit(" "), F.col("n")).alias("title"), F.concat("text", F.lit(" "), F.col("n")).alias("text"))

