"""Packing of documents into sequences by cutting-stock column generation.

A document's ids are cut at multiples of the sequence length; what is left over is an item. The
items' length histogram is all that a linear program needs: its columns are patterns (how many items
of each length class fill one sequence), found one by one by a knapsack dynamic program over the dual
prices. Rounded pattern counts are then given to the documents, ranked within their class, in Spark.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.llm.common import cut

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class ChunkTokenizer:
    """Byte-level BPE by the tokenizers library, on text cut where no token can cross.

    The vocabulary's pattern starts a new token at each space after something else than white space,
    at each line feed between other characters, and at a comma or full stop after a letter or digit.
    Ids of chunks up to there are remembered in two generations, so those in use stay. A generation ends when its
    entries take HELD_BYTES or so; chunks of more than LONG characters are not remembered, nor are parts of them.
    Texts that hold a special token's string go to the library whole, and so do all texts if the
    file has another pattern, a normaliser or anything else that such cuts would change.
    """

    #: Bytes of a generation, of an entry beside its text and ids, and the longest text that is remembered.
    HELD_BYTES, ENTRY_BYTES, LONG = 64_000_000, 200, 256

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.whole = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        before, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        #: Whether texts may be cut: the byte-level pattern on texts as they are, and merges without chance.
        self.apart = plain and made.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")
        #: Merges one token of the pattern, of which it takes the bytes as characters.
        self.merged = self.library.model.tokenize
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = iter(range(256, 512))
        self.shown = "".join(chr(b if b in own else next(other)) for b in range(256))
        self.library.no_truncation()
        self.library.no_padding()
        self.spaces = re.compile(r"\s ")
        #: What ``spaces`` finds in ASCII.
        self.two_spaces = [chr(c) + " " for c in range(128) if chr(c).isspace()]
        #: Words and numbers that are one token of the pattern: letters that have been such in all versions of Unicode.
        self.plain = re.compile(" ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+)").fullmatch
        self.stops = {c: _packed(self.library.encode(c, add_special_tokens=False).ids) for c in ",."}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _keep(self, text: str, ids: bytes) -> bytes:
        if len(text) <= self.LONG:
            self.known[text] = ids
            self.held += self.ENTRY_BYTES + 4 * len(text) + len(ids)
            if self.held > self.HELD_BYTES:
                self.old, self.known, self.held = self.known, {}, 0
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.apart or any(x in text for x in self.whole):
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        if "\0" in text or (any(x in text for x in self.two_spaces) if text.isascii() else self.spaces.search(text)):
            chunks = re.split(r"(?<=\S)(?= )", text)
        else:
            chunks = text.replace(" ", "\0 ").split("\0")
        found = list(map(self.known.get, chunks))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            made = self._learned({chunks[k] for k in new})
            for k in new:
                found[k] = made[chunks[k]]
        return b"".join(found)

    def _learned(self, unseen: set[str]) -> dict[str, bytes]:
        """The ids of chunks that aren't in this generation."""
        made: dict[str, bytes] = {}
        cut_up = {}
        known, old, plain = self.known.get, self.old.get, self.plain
        for c in unseen:
            if (ids := old(c)) is not None:
                made[c] = self._keep(c, ids)
            elif plain(c):
                made[c] = self._keep(c, self._merged(c))
            elif c[-1:] in self.stops and plain(word := c[:-1]):
                ids = known(word) or old(word) or self._keep(word, self._merged(word))
                made[c] = self._keep(c, ids + self.stops[c[-1]])
            else:
                cut_up[c] = self._parts(c)
        parts: dict[str, bytes] = {}
        wanted = []
        for p in {p for of in cut_up.values() for p in of}:
            if (ids := known(p) or old(p)) is not None:
                parts[p] = ids
            elif plain(p):
                parts[p] = self._keep(p, self._merged(p))
            else:
                wanted.append(p)
        if wanted:
            for p, ids in zip(wanted, self.library.encode_batch_fast(wanted, add_special_tokens=False), strict=True):
                parts[p] = self._keep(p, _packed(ids.ids))
        for c, of in cut_up.items():
            made[c] = parts[c] if len(of) == 1 else self._keep(c, b"".join([parts[p] for p in of]))
        return made

    def _merged(self, text: str) -> bytes:
        """The ids of a text that is one token of the pattern, from the merges alone."""
        shown = text.replace(" ", "\u0120") if text.isascii() else text.encode().decode("latin-1").translate(self.shown)
        return _packed([t.id for t in self.merged(shown)])

    @staticmethod
    def _parts(chunk: str) -> list[str]:
        """A chunk cut at line feeds between other characters and before a last comma or full stop."""
        if "\n" not in chunk:
            return [chunk[:-1], chunk[-1]] if chunk[-1:] in (",", ".") and chunk[-2:-1].isalnum() else [chunk]
        lines = chunk.split("\n")
        if len(lines) > 1 and not all(x and not x[0].isspace() and not x[-1].isspace() for x in [lines[0][-1:], *lines[1:]]):
            return [chunk]
        parts: list[str] = []
        for k, line in enumerate(lines):
            if k:
                parts.append("\n")
            if len(line) > 1 and line[-1] in ",." and line[-2].isalnum():
                parts += [line[:-1], line[-1]]
            else:
                parts.append(line)
        return parts


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer for a file."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document cut at multiples of ``length``."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            of: list[int] = []
            out: list[tuple[int, int, int, int]] = []
            for i, text in enumerate(batch.column("text")):
                ids = tok.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for at in range(0, n, length):
                    part = ids[4 * at : 4 * (at + length)]
                    of.append(i)
                    out.append((at, len(part) // 4, zlib.crc32(part), n))
            numbers = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(of, pa.int64())), *[pa.array(numbers[:, k]) for k in range(4)]],
                ["id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {PIECES}")


@dataclass(frozen=True)
class Plan:
    """Patterns by row (how many items of class 1, 2, ...) and how many sequences use each."""

    patterns: np.ndarray
    counts: np.ndarray


def class_sizes(length: int, exact: int, unit: int) -> np.ndarray:
    """The lengths that the plan tells apart: each up to ``exact``, then every ``unit``-th, ``length`` the last."""
    exact = min(exact, length)
    steps = -(-(length - exact) // unit)
    return np.concatenate([np.arange(1, exact + 1), np.minimum(exact + unit * np.arange(1, steps + 1), length)])


def _price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The pattern worth most: an unbounded knapsack over classes of rising sizes, class by class. Capacities that
    differ by multiples of a class's size are a column, along which taking one more each time is a running maximum."""
    able = np.flatnonzero(values > np.concatenate([[0.0], np.maximum.accumulate(values)[:-1]]))  # no smaller class is worth as much
    best = [np.zeros(capacity + 1)]
    for c in able:
        size = int(sizes[c])
        rows = capacity // size + 1
        held = np.full(rows * size, -np.inf)
        held[: capacity + 1] = best[-1][: rows * size]
        more = np.arange(rows)[:, None] * values[c]
        held = np.maximum.accumulate(held.reshape(rows, size) - more, axis=0) + more
        best.append(held.ravel()[: capacity + 1])
    pattern, w = np.zeros(len(values), int), capacity
    for c, before, after in zip(able[::-1], best[-2::-1], best[:0:-1], strict=True):
        while w >= sizes[c] and after[w] > before[w] + 1e-12:
            pattern[c] += 1
            w -= int(sizes[c])
    return pattern


def columns(demand: np.ndarray, sizes: np.ndarray | None = None, gap: float = 0.002, max_steps: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and fractional counts that meet ``demand`` (of classes of ``sizes``, 1, 2, ... by default; the largest
    fills a sequence) with as few sequences as a linear program allows, up to ``gap`` by Farley's bound."""
    size = len(demand)
    sizes = np.arange(1, size + 1) if sizes is None else sizes
    capacity = int(sizes[-1]) if size else 0
    need = np.flatnonzero(demand)
    if not len(need):
        return np.zeros((0, size), int), np.zeros(0)
    b = demand[need].astype(float)
    basis = np.zeros((len(need), size), int)  # a row for each column of the basis
    basis[np.arange(len(need)), need] = capacity // sizes[need]
    cost = np.ones(len(need))
    inverse = np.diag(1 / basis[np.arange(len(need)), need].astype(float))
    x = inverse.diagonal() * b
    for step in range(max_steps):
        if step and step % 500 == 0:  # rounding errors of the updates
            inverse = np.linalg.inv(basis[:, need].T.astype(float))
            x = np.maximum((inverse * b).sum(axis=1), 0)
        y = inverse[cost > 0].sum(axis=0)  # sums, as the library's threads cost more than such small products
        low = int(y.argmin())
        new = np.zeros(size, int)
        if y[low] < -1e-9:
            new[need[low]], price = -1, 0.0  # a surplus
        else:
            values = np.zeros(size)
            values[need] = y
            new, price = _price(values, sizes, capacity), 1.0
            worth = float((new[need] * y).sum())
            if worth <= 1 + 1e-9 or x[cost > 0].sum() * (1 - gap) <= (y * b).sum() / worth:
                break
        direction = (inverse * new[need]).sum(axis=1)
        able = direction > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, direction, 1), np.inf)
        out = int(ratio.argmin())
        move = max(0.0, float(ratio[out]))
        x = np.maximum(x - move * direction, 0)
        x[out] = move
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
        basis[out], cost[out] = new, price
    used = cost > 0
    return basis[used], x[used]


def plan(demand: np.ndarray, sizes: np.ndarray | None = None) -> Plan:
    """Whole pattern counts that hold ``demand`` exactly: the linear program's counts rounded down,
    and the items left filled largest first, each such pattern repeated as often as it can be."""
    sizes = np.arange(1, len(demand) + 1) if sizes is None else sizes
    patterns, x = columns(demand, sizes)
    left = demand.astype(int).copy()
    kept: list[np.ndarray] = []
    counts: list[int] = []

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        if times > 0 and pattern.any():
            kept.append(pattern)
            counts.append(times)
            left = left - times * pattern

    for p, n in zip(patterns, x, strict=True):
        on = p > 0
        use(p, min([int(n + 1e-6), *(left[on] // p[on]).tolist()]) if on.any() else 0)
    while left.any():
        pattern, space = np.zeros_like(left), int(sizes[-1])
        while (fits := np.flatnonzero(((left - pattern) > 0) & (sizes <= space))).size:
            c = int(fits[-1])
            n = min(space // int(sizes[c]), int(left[c] - pattern[c]))
            pattern[c] += n
            space -= n * int(sizes[c])
        on = pattern > 0
        use(pattern, int((left[on] // pattern[on]).min()))
    return Plan(np.array(kept, int).reshape(-1, len(demand)), np.array(counts, int))


def pack(
    docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", exact: int = 64, unit: int = 8, slice_rows: int = 20_000
) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text and ``end_id``; null is an empty text, whose one id is
    ``end_id``. Documents are cut at multiples of ``length`` only. Item lengths up to ``exact`` are planned as they
    are, longer ones rounded up by ``unit``, which costs under ``unit`` ids of padding an item. Repeated
    rows, ids that repeat and null ids are documents of their own. An empty table gives no rows.

    The driver holds the histogram (exact + length / unit numbers) and the patterns, whatever the size of ``docs``.
    """
    sizes = class_sizes(length, exact, unit)
    # Rows may be equal in all columns; the number tells them apart.
    cuts = cut(pieces(docs, path, length, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    kind = F.when(F.col("length") <= exact, F.col("length")).otherwise(exact + F.ceil((F.col("length") - exact) / unit))
    items = cuts.withColumn("class", kind.cast("int"))
    histogram = np.zeros(len(sizes), int)
    for row in items.groupBy("class").count().collect():
        histogram[row["class"] - 1] = row["count"]
    made = plan(histogram, sizes)
    base = np.concatenate([[0], np.cumsum(made.counts)])
    # For each class: the ranks from which on a pattern takes its items.
    begins: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for c in np.flatnonzero(histogram):
        users = np.flatnonzero(made.patterns[:, c])
        each = made.patterns[users, c]
        begins[int(c) + 1] = (np.concatenate([[0], np.cumsum(each * made.counts[users])])[:-1], each, base[users])

    @F.pandas_udf("long")
    def sequence(kind: pd.Series, rank: pd.Series) -> pd.Series:
        found = np.empty(len(kind), np.int64)
        kinds, ranks = kind.to_numpy(), rank.to_numpy()
        for c in np.unique(kinds):
            rows = kinds == c
            starts, each, first = begins[int(c)]
            r = ranks[rows]
            k = np.searchsorted(starts, r, side="right") - 1
            found[rows] = first[k] + (r - starts[k]) // each[k]
        return pd.Series(found)

    # A class may hold a third of all items: it is ranked in slices, each moved up by those before it.
    slices = max(1, -(-int(histogram.sum()) // slice_rows))
    sliced = items.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))
    counts = sliced.groupBy("class", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("class", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("class", "slice").orderBy("id", "start", "ids_crc32", "row")
    placed = (
        sliced.withColumn("at", F.row_number().over(own) - 1)
        .join(starts, ["class", "slice"])
        .withColumn("sequence_id", sequence("class", F.col("at") + F.col("first")))
    )
    along = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start", "ids_crc32", "row")
    offset = F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset")
    )
