"""Web pages as a Python data source, and pluggable embedding and answer providers.

Nothing here runs unless it is asked for: ``spark.dataSource.register(WebPages)`` and then
``spark.read.format("web_pages").option("urls", "...").load()``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.operators.pages import public_address


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls, self.agent, self.seconds = options.get("urls", "").split(), options.get("agent", "corpusloom"), float(options.get("timeout", 12))

    def partitions(self) -> list[InputPartition]:
        return [_Urls(self.urls[i : i + 20]) for i in range(0, len(self.urls), 20)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import socket
        from urllib.parse import urlsplit
        from urllib.request import Request, urlopen

        for url in partition.urls:
            host = urlsplit(url).hostname or ""
            try:
                if not public_address(host) or not all(public_address(a[4][0]) for a in socket.getaddrinfo(host, None)):
                    yield url, url, None, None, None
                    continue
                with urlopen(Request(url, headers={"User-Agent": self.agent}), timeout=self.seconds) as r:
                    yield url, r.geturl(), r.status, r.headers.get("Content-Type"), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
            except OSError:
                yield url, url, None, None, None


class WebPages(DataSource):
    """One row per url: url, final_url, status, content_type, html; nulls where the fetch failed or the host isn't public."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return "url string, final_url string, status int, content_type string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def embedded(df: DataFrame, key: str, text: str, provider: Callable[[list[str]], np.ndarray], max_chars: int = 8000) -> DataFrame:
    """``key`` and ``vector`` of every text by a provider of batches; vectors are divided by their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(provider([(t or "")[:max_chars] for t in b.column(text).to_pylist()]), np.float32).reshape(b.num_rows, -1)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.where(n == 0, 1, n)
            offsets = np.arange(0, v.size + 1, max(1, v.shape[1]), dtype=np.int32)[: len(v) + 1]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.ravel()))], [key, "vector"])

    d = df.select(key, text)
    return d.mapInArrow(run, f"`{key}` {d.schema[key].dataType.simpleString()}, vector array<float>")


def answered(prompts: DataFrame, provider: Callable[[str], str] | None, fallback: str = "answer") -> DataFrame:
    """``qid, answer, model``: the provider's answer, or the extractive one where there is no provider or it fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    rows.append((r["qid"], provider(r["prompt"]), "provider"))
                except Exception:  # noqa: BLE001 - any failure of the provider means the extractive answer
                    rows.append((r["qid"], r[fallback], "extractive-fallback"))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.string()) for i in range(3)], ["qid", "answer", "model"])

    if provider is None:
        from pyspark.sql import functions as F

        return prompts.select("qid", F.col(fallback).alias("answer"), F.lit("extractive-grounded").alias("model"))
    return prompts.select("qid", "prompt", fallback).mapInArrow(run, "qid string, answer string, model string")
