"""Ranked lexical search: MaxScore over inverted lists of each shard of documents.

Postings of the queries' terms are made once from whole texts and kept, in parts of documents. Each task turns its
part into blocks of inverted lists with the largest weight of each list. For a query, the lists that together can't
lift a document over the k-th score held so far are non-essential: documents come from the other
lists alone, and a non-essential list is probed, the strongest first, only for those that it could still lift so far.
Each task keeps the k best of each query; these are merged in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsdesk.llm.common import cut, remove, scratch, stored

#: Bytes that are part of a term, A to Z in lower case; all others are spaces. Every byte of a code point above 127
#: is above 127, so bytes tell terms apart as code points do.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isdigit() else b | 32 if chr(b).isalpha() else 32 for b in range(256))
_SLICE_BYTES = 1 << 20
#: Documents of a block of inverted lists.
_BLOCK = 4096
_NO_ID = 2**63 - 1


def term_counts(text: bytes, counted: dict[bytes, int] | None = None) -> tuple[int, Counter]:
    """How many terms UTF-8 text has, and how often each of ``counted`` (all if None) occurs. About a megabyte at a
    time, cut between terms."""
    text, at, n, found = text.translate(_TERM_BYTES), 0, 0, Counter()
    while at < len(text):
        end = text.find(b" ", at + _SLICE_BYTES)
        terms = text[at : end if end >= 0 else len(text)].split()
        n += len(terms)
        some = Counter(terms)
        for t in some.keys() if counted is None else some.keys() & counted.keys():
            found[t] += some[t]
        at = end if end >= 0 else len(text)
    return n, found


def _query_terms(queries: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term): the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms = [], []
            for k, t in enumerate(batch.column("text").cast(pa.large_binary())):
                own = list(term_counts(t.as_buffer().to_pybytes())[1])
                at += [k] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(at, pa.int64())), pa.array(terms, pa.binary())], ["item", "term"])

    kind = T.StructType([T.StructField("item", queries.schema[item_col].dataType), T.StructField("term", T.BinaryType())])
    texts = queries.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, kind).distinct()


def _postings(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, counts): each document's length and its postings of ``terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends, numbers, counts = [], [0], [], []
            for t in batch.column("text").cast(pa.large_binary()):
                length, found = term_counts(t.as_buffer().to_pybytes(), terms)
                n.append(length)
                numbers += [terms[x] for x in found]
                counts += found.values()
                ends.append(len(numbers))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((numbers, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "id long, n long, terms array<int>, counts array<long>")


def weight(n_docs: int, df: int) -> int:
    """A term's weight, from how many documents have terms and how many hold this one."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Inverted lists of some documents: for each term that occurs, documents and their parts of the score."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = ids
        docs = np.repeat(np.arange(len(ids)), np.diff(ends))
        # Whole numbers of any size, so the product of a length and a count of documents can't overflow.
        m = np.array([50 + 50 * n * n_docs // n_terms for n in lengths.tolist()], np.int64) if n_terms else np.zeros(len(ids), np.int64)
        parts = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[docs]))
        order = np.argsort(terms, kind="stable")
        self.docs, self.parts, terms = docs[order], parts[order], terms[order]
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        self.bounds = np.append(starts, len(terms))
        self.most = np.maximum.reduceat(self.parts, starts) if len(starts) else np.empty(0, np.int64)
        self.at = np.full(len(weights), -1, np.int64)
        self.at[terms[starts]] = np.arange(len(starts))
        self.sums = np.zeros(len(ids), np.int64)

    def best(self, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of those that reach ``least`` (1 or more) for the terms of ``query``."""
        lists = self.at[query]
        lists = lists[lists >= 0]
        lists = lists[np.argsort(self.most[lists], kind="stable")]
        reach = np.cumsum(self.most[lists])
        essential = int(np.searchsorted(reach, least))  # the lists before can't reach it together
        none = np.empty(0, np.int64)
        if essential == len(lists):
            return none, none
        self.sums[:] = 0
        for k in lists[essential:]:
            a, b = self.bounds[k], self.bounds[k + 1]
            self.sums[self.docs[a:b]] += self.parts[a:b]
        found = np.flatnonzero(self.sums)
        scores = self.sums[found]
        for j in range(essential - 1, -1, -1):
            may = scores + reach[j] >= least
            found, scores = found[may], scores[may]
            if not len(found):
                return none, none
            a, b = self.bounds[lists[j]], self.bounds[lists[j] + 1]
            at = np.minimum(np.searchsorted(self.docs[a:b], found), b - a - 1) + a
            scores = scores + np.where(self.docs[at] == found, self.parts[at], 0)
        reached = scores >= least
        return found[reached], scores[reached]


def _ranked(postings: DataFrame, items: pa.Array, item_type: T.DataType, item_terms: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, score): for each task the ``k`` best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {q: (np.empty(0, np.int64), np.empty(0, np.int64)) for q in range(len(item_terms))}  # scores, ids
        for batch in batches:
            for lo in range(0, len(batch), _BLOCK):
                part = batch.slice(lo, _BLOCK)
                lists = part.column("terms")
                ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
                ids = part.column("id").fill_null(_NO_ID).to_numpy()
                block = Block(ids, part.column("n").to_numpy(), ends, lists.flatten().to_numpy(), part.column("counts").flatten().to_numpy(), weights, n_docs, n_terms)
                for q, terms in enumerate(item_terms):
                    scores, ids = held[q]
                    docs, more = block.best(terms, int(scores[-1]) if len(scores) == k else 1)
                    if len(docs):
                        scores, ids = np.concatenate([scores, more]), np.concatenate([ids, block.ids[docs]])
                        order = np.lexsort((ids, -scores))[:k]
                        held[q] = (scores[order], ids[order])
        at = np.repeat(np.arange(len(item_terms)), [len(s) for s, _ in held.values()])
        ids = np.concatenate([np.empty(0, np.int64), *[i for _, i in held.values()]])
        scores = np.concatenate([np.empty(0, np.int64), *[s for s, _ in held.values()]])
        yield pa.RecordBatch.from_arrays([items.take(pa.array(at, pa.int64())), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], ["item", "id", "score"])

    kind = T.StructType([T.StructField("item", item_type), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
    return postings.mapInArrow(run, kind)


def _top(rows: DataFrame, k: int, *, lots: int = 64) -> DataFrame:
    """(item, rank, id, score): the k best of each item. First the best of each of ``lots`` parts of an item's rows,
    so that the last task of an item gets k * lots rows at most, however many tasks there were."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    lot = F.pmod(F.xxhash64("id", F.spark_partition_id()), F.lit(lots))
    some = rows.withColumn("lot", lot).withColumn("rank", F.row_number().over(Window.partitionBy("item", "lot").orderBy(*order))).where(F.col("rank") <= k)
    return some.drop("lot").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item", "rank", "id", "score")


def search(
    docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = 500_000
) -> DataFrame:
    """(item, rank, id, score): for each item of ``queries`` the ``k`` documents with the highest scores above 0.

    Terms are runs of ASCII letters and digits and of code points above 127, only A to Z in lower case. N counts the documents
    with a term, L all terms of all documents, n those of one, df the documents that hold a term, tf how
    often one holds it. With w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 50 + 50nN div L, a
    document's score is the sum of w * (10^9 tf div (1000 tf + 20m)) over the item's distinct terms, in whole numbers.
    Equal scores go by id. Every document's whole text counts, and none is left out of the search.

    Null and empty texts have no terms: such items have no rows, such documents are never found and count in nothing.
    Rows that share a document's id are documents of their own, each found for itself. Ids of documents are
    integers; a null id comes after all others of an equal score. Rows that share an item's id (or have none) are one
    item with the terms of all. Columns beside these are not looked at. Empty tables give no rows.

    Queries go in blocks of at most ``block_terms`` terms, or of one item if that has more: their terms, weights
    and nothing else are sent to the tasks, and each block reads the documents once. Memory of a task: a block of
    4,096 documents' postings and k rows for each item of a block of queries.
    """
    spark = docs.sparkSession
    at = scratch(spark, "lexical")
    terms = stored(_query_terms(queries, item_col, item_text), at)
    item_type, blocks = queries.schema[item_col].dataType, 1
    while True:  # twice as many blocks until each is small or a single item
        block = F.pmod(F.xxhash64("item"), F.lit(blocks))
        sizes = terms.groupBy("item").agg(F.count("*").alias("n")).groupBy(block.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("items"))
        if blocks >= 1 << 40 or sizes.where((F.col("n") > block_terms) & (F.col("items") > 1)).isEmpty():
            break
        blocks *= 2
    used = [r["b"] for r in terms.select(block.alias("b")).distinct().collect()]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = None
    for b in sorted(used):
        mine = terms.where(block == b).groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")).toArrow().combine_chunks()
        lists = mine.column("terms").combine_chunks()
        numbers = {t: n for n, t in enumerate(sorted(set(lists.flatten().to_pylist())))}
        item_terms = [np.array([numbers[t] for t in x], np.int64) for x in lists.to_pylist()]
        postings = stored(_postings(texts, numbers), at)
        # The totals don't depend on the block; they come with the first postings that are made.
        n_docs, n_terms = postings.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.full(len(numbers), weight(n_docs, 0), np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow().to_pylist():
            weights[r["t"]] = weight(n_docs, r["df"])
        items = mine.column("item").combine_chunks()
        here = stored(_top(_ranked(postings, items, item_type, item_terms, weights, n_docs, n_terms, k), k), at)
        found = here if found is None else found.unionByName(here)
    if found is None:
        found = spark.createDataFrame([], T.StructType([T.StructField("item", item_type), T.StructField("rank", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())]))
    found = cut(found.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    remove(spark, at)
    return found
