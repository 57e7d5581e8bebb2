"""Search providers as a data source: spark.read.format("search_answers").

A provider answers a query with hits in order. Here a provider is a file of recorded answers, its name the file's
name without .json: {"queries": {query: [hit, ...]}, "results": [hit, ...]}, hits with title, url, publisher,
publishedAt and snippet. ``results`` answers queries that aren't recorded. Filters on provider and query
are pushed: files of other providers aren't opened, answers to other queries aren't made into rows.

Options: path (a folder that executors open too), queries (a JSON list of what is asked; without it every
recorded query), limit (hits for each answer, 10).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from newsdesk.functions.urls import canonical, publisher
from newsdesk.sources.files import page_files

ANSWER = "provider string, query string, position int, title string, url string, publisher string, published_at string, snippet string, error string"
_FIELDS = {"title": "title", "url": "url", "publisher": "publisher", "published_at": "publishedAt", "snippet": "snippet"}
_ROWS = 4096


def normalised(query: str) -> str:
    """A query as providers get it: white space collapsed."""
    return re.sub(r"\s+", " ", query).strip()


class _File(InputPartition):
    def __init__(self, path: str, provider: str) -> None:
        super().__init__(path)
        self.path, self.provider = path, provider


class AnswerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("search_answers needs the option path")
        self.path, self.limit = options["path"], int(options.get("limit", "10"))
        asked = json.loads(options["queries"]) if "queries" in options else None
        self.asked = None if asked is None else list(dict.fromkeys(q for q in map(normalised, asked) if q))
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and IN on provider and query are answered here, whatever else there is by Spark."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute not in (("provider",), ("query",)):
                yield f
                continue
            name = f.attribute[0]
            self.only[name] = self.only[name] & wanted if name in self.only else wanted

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, folder = page_files(self.path)
        found = []
        for info in files.get_file_info(fs.FileSelector(folder)):
            provider = info.base_name.removesuffix(".json")
            if info.is_file and info.base_name.endswith(".json") and not provider.startswith((".", "_")) and provider in self.only.get("provider", {provider}):
                found.append(_File(info.path, provider))
        return sorted(found, key=lambda p: p.provider)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("provider", pa.string()), ("query", pa.string()), ("position", pa.int32()), *[(c, pa.string()) for c in _FIELDS], ("error", pa.string())])
        if not isinstance(partition, _File):
            return
        rows: list[dict[str, Any]] = []
        for row in self._hits(partition):
            rows.append(row)
            if len(rows) == _ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _hits(self, partition: _File) -> Iterator[dict[str, Any]]:
        files, _ = page_files(self.path)
        try:
            with files.open_input_stream(partition.path) as stream:
                held = json.loads(stream.read())
            recorded, others = held.get("queries") or {}, held.get("results") or []
        except (ValueError, AttributeError) as failed:  # one provider's broken file is data
            if "query" not in self.only:
                yield {"provider": partition.provider, "error": f"unreadable: {failed}"[:500]}
            return
        by_query = {normalised(q): hits for q, hits in reversed(recorded.items())}
        for query in self.asked if self.asked is not None else reversed(by_query):
            if query not in self.only.get("query", {query}):
                continue
            for position, hit in enumerate((by_query.get(query) or others)[: self.limit]):
                yield {"provider": partition.provider, "query": query, "position": position} | {c: _text(hit, k) for c, k in _FIELDS.items()}


def _text(hit: Any, key: str) -> str | None:
    value = hit.get(key) if isinstance(hit, dict) else None
    return None if value is None else str(value)


class SearchAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "search_answers"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema) -> DataSourceReader:
        return AnswerReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchAnswers)


def search_web(answers: DataFrame) -> DataFrame:
    """Answers of the format as discovery rows: provider, query, url (canonical, the first of each), title, publisher
    (of the url where none is given), published_at, snippet, rank. Hits without a web address go, and
    ranks keep their gaps. A provider's unreadable file gives no hit."""
    url = F.when(F.col("url").rlike(r"^\s*(?i:https?)://[^/?#\s]"), canonical(F.trim("url")))
    rows = answers.withColumn("url", F.explode(F.array(url))).where(F.col("url").isNotNull())
    first = rows.groupBy("provider", "query", "url").agg(F.min_by(F.struct("title", "publisher", "published_at", "snippet", "position"), "position").alias("h"))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return first.select(
        "provider", "query", "url", F.coalesce(F.trim("h.title"), F.lit("")).alias("title"), F.coalesce(some(F.col("h.publisher")), publisher(F.col("url"))).alias("publisher"),
        some(F.col("h.published_at")).alias("published_at"), F.trim(F.regexp_replace(F.coalesce("h.snippet", F.lit("")), r"\s+", " ")).alias("snippet"),
        (F.col("h.position") + 1).alias("rank"),
    )
