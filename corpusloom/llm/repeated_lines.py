"""Lines that one site repeats: distributed PrefixSpan over line identifiers, then deletion.

Level 1 counts, per site, the distinct rows of each line identifier.  Rows are then reduced to their
sequences of frequent identifiers, and equal sequences of a site are one row with a weight.  A pattern grows
by one identifier a level: its projected rows hold where its leftmost match ends, every identifier that
follows there, gaps allowed, is a way to grow, and those with enough rows are the next level's patterns.  All
counting is by partial aggregation, so neither a hot site nor a hot line meets one task.

Growth ends at the least length that a sequence must have: every part of a frequent sequence is at least as
frequent, so what longer ones cover, those cover too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialise, small_side

#: Lines of a row from which it isn't grown where each goes by itself: growth can't add to it, and its steps are as many as its pairs of lines.
LONG = 1000


def site_of(url: Column, source: Column) -> Column:
    """Host of the url in lower case, without user, port and leading ``www.``; else the source's name."""
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    bare = F.regexp_replace(F.lower(F.when(host != "", host).otherwise(F.regexp_extract(url, r"^([^/?#:]*)", 1))), r"^www\.", "")
    name = F.regexp_replace(F.regexp_replace(F.lower(source), r"^trusted-docs:", ""), r"^www\.", "")
    return F.when(F.length(url) > 0, bare).otherwise(name)


def line_identifier(line: Column) -> Column:
    """96-bit identifier of a line without white space, digits and letter case; null when nothing is left."""
    rest = F.lower(F.regexp_replace(line, r"(?U)[\s\x1c-\x1f0-9]+", ""))
    return F.when(rest != "", F.struct(F.xxhash64(rest).alias("h"), F.hash(rest).alias("g")))


def repeated_lines(df: DataFrame, keys: list[str], body: str = "body", *, min_rows: int = 8, sequence_rows: int | None = None, length: int = 2) -> DataFrame:
    """``keys`` and ``line_no`` (from 1) of every line that its site repeats excessively.

    A single line is excessive in ``min_rows`` rows of its site, a sequence of ``length`` or more lines, others
    between them or not, in ``sequence_rows`` (default ``min_rows``); every occurrence of an excessive sequence goes.  Lines count once a row.  A null body
    has no lines; a row without url and source has no site and keeps all lines; blank lines are
    neither counted nor removed.  ``keys`` must tell rows apart.
    """
    sequence_rows, length = sequence_rows or min_rows, max(2, length)
    lines = F.transform(F.split(body, "\n", -1), lambda x, i: F.struct((i + 1).cast("int").alias("line_no"), line_identifier(x).alias("id")))
    rows = df.select(*keys, site_of(F.col("url"), F.col("source")).alias("site"), F.filter(lines, lambda x: x["id"].isNotNull()).alias("lines")).where("site IS NOT NULL AND size(lines) > 0")
    rows = materialise(rows, "lines")

    once = rows.select("site", F.explode(F.array_distinct(F.transform("lines", lambda x: x["id"]))).alias("id"))
    items = materialise(once.groupBy("site", "id").agg(F.count("*").alias("support")).where(F.col("support") >= min(min_rows, sequence_rows)), "frequent-lines")
    n = items.count()
    each = rows.select(*keys, "site", F.explode("lines").alias("x")).select(*keys, "site", "x.*")
    hits = each.join(small_side(items, n, 80), ["site", "id"])
    reduced = hits.groupBy("site", *keys).agg(F.sort_array(F.collect_list(F.struct("line_no", F.xxhash64("id").alias("item"), "support"))).alias("seq"))
    reduced = materialise(reduced, "reduced-lines")
    found = reduced.select(*keys, F.explode(F.filter("seq", lambda x: x["support"] >= min_rows)["line_no"]).alias("line_no"))
    growing = reduced.where((F.size("seq") < LONG) | F.exists("seq", lambda x: x["support"] < min_rows))
    return found.unionByName(_sequences(growing, keys, sequence_rows, length)).distinct()


def _sequences(reduced: DataFrame, keys: list[str], least: int, length: int) -> DataFrame:
    """``keys`` and ``line_no`` of the occurrences of all sequences of ``length`` items that ``least`` rows of a site have."""
    rows = reduced.select("site", *keys, F.transform("seq", lambda x: x["item"]).alias("items"), F.transform("seq", lambda x: x["line_no"]).alias("line_nos"))
    whole = rows.groupBy("site", "items").agg(F.count("*").alias("weight")).withColumn("sid", F.monotonically_increasing_id())
    whole = materialise(whole, "sequences")
    # The pattern so far, and where its leftmost match ends (0: nowhere yet).
    grown = whole.select("site", "sid", "weight", "items", F.array().cast("array<bigint>").alias("pattern"), F.lit(0).alias("at"))
    for level in range(1, length + 1):
        rest = F.slice("items", F.col("at") + 1, F.size("items"))
        steps = grown.select("*", F.explode(F.array_distinct(rest)).alias("item"))
        ends = (F.col("at") + F.array_position(rest, F.col("item"))).cast("int").alias("at")
        steps = steps.select("site", "sid", "weight", F.concat("pattern", F.array("item")).alias("pattern"), *(("items", ends) if level < length else ()))
        steps = materialise(steps, f"projected-{level}")
        often = materialise(steps.groupBy("site", "pattern").agg(F.sum("weight").alias("support")).where(F.col("support") >= least).select("site", "pattern"), f"patterns-{level}")
        n = often.count()
        grown = steps.join(small_side(often, n, 40 + 8 * level), ["site", "pattern"], "left_semi")
        if not n:
            break
    patterns = grown.groupBy("sid").agg(F.collect_list("pattern").alias("patterns"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [occurrences(seq, wanted) for seq, wanted in zip(b.column("items").to_pylist(), b.column("patterns").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("site"), b.column("items"), pa.array(at, pa.list_(pa.int32()))], ["site", "items", "places"])

    places = whole.join(patterns, "sid").select("site", "items", "patterns").mapInArrow(mark, "site string, items array<long>, places array<int>")
    found = rows.join(places, ["site", "items"])
    return found.select(*keys, F.explode(F.transform("places", lambda i: F.col("line_nos")[i])).alias("line_no"))


def occurrences(seq: list[int], patterns: list[list[int]]) -> list[int]:
    """Places of ``seq`` that take part in an occurrence of a pattern: behind the leftmost match of what comes before, and ahead of the rightmost of what follows."""
    places: dict[int, list[int]] = {}
    for i, x in enumerate(seq):
        places.setdefault(x, []).append(i)
    out: set[int] = set()
    for p in patterns:
        first, last, at = [], [], -1
        for x in p:
            at = next((i for i in places.get(x, ()) if i > at), len(seq))
            first.append(at)
        at = len(seq)
        for x in reversed(p):
            at = next((i for i in reversed(places.get(x, ())) if i < at), -1)
            last.append(at)
        for x, lo, hi in zip(p, first, reversed(last)):
            out.update(i for i in places.get(x, ()) if lo <= i <= hi)
    return sorted(out)


def without_repeated_lines(df: DataFrame, keys: list[str], body: str = "body", **kw) -> DataFrame:
    """``keys`` and the body without the lines its site repeats; all other lines unchanged and in order."""
    gone = repeated_lines(df, keys, body, **kw).groupBy(*keys).agg(F.collect_list("line_no").alias("__gone"))
    kept = F.filter(F.split(body, "\n", -1), lambda x, i: ~F.array_contains("__gone", (i + 1).cast("int")))
    return df.select(*keys, body).join(gone, keys, "left").select(*keys, F.when(F.col("__gone").isNull(), F.col(body)).otherwise(F.array_join(kept, "\n")).alias(body))
