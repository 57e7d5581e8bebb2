"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Labelled examples are the index, document frequencies come from all documents. Every text is searched
with all its words; terms that tell toxic examples from others weigh more. A text's score is a vote of
its nearest examples, weighted by distance and calibrated on folds whose labels chose neither the
terms nor the examples that vote; the nearest ones are its evidence.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.common import cut, give_back

BLOCK = 64
#: Length of the part of a vector that holds all words; telling terms come to it by count and idf.
REST = 10.0
#: Lengths of the word beginnings that may be telling terms beside whole words: they catch inflected forms.
BEGINNINGS = tuple(range(3, 11))
FOLDS = 3
#: Term numbers, rising, and weights or counts.
Vector = tuple[np.ndarray, np.ndarray]
_WORD = re.compile(r"[^\W_]+")
#: What parts the words of an ASCII text, as spaces.
_PARTS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})
#: The same for texts of Latin-1, by bytes.
_LATIN_PARTS = bytes(c if chr(c).isalnum() else 32 for c in range(256))
#: Scripts that don't part words by spaces: their runs count as pairs of letters.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿⺀-꓏豈-﫿]")


def _found(text: str) -> list[str]:
    text = text.lower()
    if text.isascii():
        return text.translate(_PARTS).split()
    try:
        return text.encode("latin-1").translate(_LATIN_PARTS).decode("latin-1").split()
    except UnicodeEncodeError:
        pass
    found = _WORD.findall(text)
    if _UNSPACED.search(text):
        pairs = [w[i : i + 2] for w in found if _UNSPACED.search(w) for i in range(len(w) - 1)]
        found += [p for p in pairs if len(p) == 2]
    return found


def words_of(text: str) -> dict[str, int]:
    """The lower-cased words of a text and how often each occurs."""
    return Counter(_found(text))


def all_words(text: str) -> set[str]:
    """The lower-cased words of a text."""
    return set(_found(text))


class Terms:
    """Numbers of terms: the words of ``words``, then the telling terms (``+`` after one: a word's beginning)."""

    def __init__(self, words: list[str], telling: list[str]):
        self.n_words, self.n = len(words), len(words) + len(telling)
        self.words = {w: k for k, w in enumerate(words)}
        self.whole = {w: len(words) + k for k, w in enumerate(telling) if not w.endswith("+")}
        self.starts = {w[:-1]: len(words) + k for k, w in enumerate(telling) if w.endswith("+")}
        #: For the first three letters of telling terms the lengths to look up; 0: the whole word.
        self.heads: dict[str, list[int]] = {}
        for size, w in [(0, w) for w in self.whole] + [(len(w), w) for w in self.starts]:
            if size not in (sizes := self.heads.setdefault(w[:3], [])):
                sizes.append(size)

        #: The telling terms of the numbered words that hold any.
        self.by_word: dict[int, list[int]] = {}
        for w, k in self._telling(words):
            self.by_word.setdefault(self.words[w], []).append(k)
        self.tells = frozenset(self.by_word)

    def _telling(self, words: Iterable[str]) -> list[tuple[str, int]]:
        """The words that hold telling terms, once for each, and the terms' numbers."""
        heads, found = self.heads, []
        for w in [w for w in words if w[:3] in heads]:
            for size in heads[w[:3]]:
                number = self.starts.get(w[:size]) if 0 < size < len(w) else None if size else self.whole.get(w)
                if number is not None:
                    found.append((w, number))
        return found

    def numbers(self, found: dict[str, int]) -> Vector:
        """The terms' numbers, rising, and the counts of those that a text holds, from its words and their counts."""
        words = np.fromiter(map(self.words.get, found, itertools.repeat(-1)), np.int64, len(found))
        n = np.fromiter(found.values(), np.int64, len(found))
        other = words < 0
        telling: dict[int, int] = {}
        for w, k in self._telling(itertools.compress(found, other.tolist())):
            telling[k] = telling.get(k, 0) + found[w]
        known = np.flatnonzero(~other)
        known = known[np.argsort(words[known])]
        words, n = words[known], n[known]
        for word in self.tells.intersection(words.tolist()):
            times = int(n[np.searchsorted(words, word)])
            for k in self.by_word[word]:
                telling[k] = telling.get(k, 0) + times
        more = sorted(telling)
        return np.append(words, np.array(more, np.int64)), np.append(n, np.array([telling[k] for k in more], np.int64))

    def held(self, words: set[str]) -> set[int]:
        """The numbers of the terms that a text with these words holds."""
        numbers = set(map(self.words.get, words, itertools.repeat(-1)))
        numbers.discard(-1)
        for word in self.tells & numbers:
            numbers.update(self.by_word[word])
        numbers.update(k for _, k in self._telling(words.difference(self.words)))
        return numbers

    def count(self, found: dict[str, int]) -> dict[int, int]:
        return dict(zip(*(x.tolist() for x in self.numbers(found)), strict=True))


class Index:
    """Examples' unit vectors as inverted lists. Terms that a sixteenth of the examples hold have dense
    postings, a weight for every example. The lists of terms in more examples than there are blocks of
    BLOCK examples know their largest weight and their first posting in each block, which takes less
    room than the postings. Shorter lists are read whole."""

    def __init__(self, vectors: list[Vector], ids: list[int], labels: list[int], n_terms: int):
        # Examples with the same heaviest term stand together, which keeps most bounds low.
        heaviest = [int(t[w.argmax()]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (heaviest[i], ids[i]))
        self.ids, self.labels = [ids[i] for i in order], np.array([labels[i] for i in order], np.int64)
        self.n_blocks = -(-len(order) // BLOCK)
        terms = np.concatenate([vectors[i][0] for i in order]).astype(np.int64) if order else np.empty(0, np.int64)
        weights = np.concatenate([vectors[i][1] for i in order]) if order else np.empty(0)
        places = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        by = np.argsort(terms, kind="stable")
        terms, self.weights, self.places = terms[by], weights[by], places[by]
        del by, weights, places
        many = np.bincount(terms, minlength=n_terms)
        common = np.flatnonzero(many > max(8, len(order) / 16))
        self.row = np.full(n_terms, -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n_blocks * BLOCK))
        here = self.row[terms] >= 0
        self.dense[self.row[terms[here]], self.places[here]] = self.weights[here]
        terms, self.weights, self.places = terms[~here], self.weights[~here], self.places[~here]
        self.start = np.searchsorted(terms, np.arange(n_terms + 1))
        long = np.flatnonzero((many > self.n_blocks) & (self.row < 0))
        self.long = np.full(n_terms, -1)
        self.long[long] = np.arange(len(long))
        blocks, here = self.places // BLOCK, self.long[terms] >= 0
        self.most = np.zeros((len(long), self.n_blocks))
        np.maximum.at(self.most, (self.long[terms[here]], blocks[here]), self.weights[here])
        step = self.n_blocks + 1
        self.cells = np.searchsorted(terms * step + blocks, long[:, None] * step + np.arange(step))

    def nearest(self, queries: list[Vector], k: int) -> list[list[tuple[float, int]]]:
        """For each query the k examples of largest cosine over 0, as (cosine, place), ties to the earlier place."""
        common, long = np.zeros((len(queries), len(self.dense))), np.zeros((len(queries), len(self.most)))
        for i, (terms, weights) in enumerate(queries):
            for rows, of in ((common, self.row[terms]), (long, self.long[terms])):
                rows[i, of[of >= 0]] = weights[of >= 0]
        return [self._search(q, *known, k) for q, *known in zip(queries, common @ self.dense, long @ self.most, strict=True)]

    def _search(self, query: Vector, base: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[float, int]]:
        """``base``: what common terms add to each example; ``bounds``: the most that long lists can add in
        each block. Short lists are added to ``base`` first. Blocks whose largest sum and bound cannot reach
        the k-th sum stay closed: no long list is read there."""
        terms, weights = query
        short, long = (self.row[terms] < 0) & (self.long[terms] < 0), self.long[terms] >= 0
        postings, by = _spread(self.start[terms[short]], self.start[terms[short] + 1], weights[short])
        scores = base + np.bincount(self.places[postings], by * self.weights[postings], len(base))
        least = np.partition(scores, -k)[-k] if k <= len(scores) else 0.0
        opened = np.flatnonzero(bounds + scores.reshape(-1, BLOCK).max(axis=1, initial=0) >= least - 1e-12)
        if len(opened) and long.any():
            # Neighbouring blocks are read as one.
            apart = np.flatnonzero(np.diff(opened) > 1)
            starts, stops = opened[np.append(0, apart + 1)], opened[np.append(apart, -1)] + 1
            lists = self.long[terms[long], None]
            postings, by = _spread(self.cells[lists, starts], self.cells[lists, stops], weights[long, None])
            scores += np.bincount(self.places[postings], by * self.weights[postings], len(base))
        near = np.flatnonzero((scores > 0) & (scores >= least))
        if len(near) > k:
            near = near[scores[near] >= np.partition(scores[near], -k)[-k]]
        near = near[np.lexsort((near, -scores[near]))[:k]]
        return [(float(scores[i]), int(i)) for i in near]


def _spread(starts: np.ndarray, stops: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and the value of the range that each is from."""
    sizes = (stops - starts).ravel()
    skips = starts.ravel() - np.cumsum(sizes) + sizes
    if values.shape != starts.shape:
        values = np.broadcast_to(values, starts.shape)
    values = values.ravel()
    numbers = np.repeat(skips, sizes)
    numbers += np.arange(len(numbers))
    return numbers, np.repeat(values, sizes)


@dataclass
class Model:
    terms: Terms
    idf: np.ndarray
    index: Index
    k: int
    prior: float
    #: Raw votes and what share of examples with such a vote is toxic, both rising.
    knots: tuple[list[float], list[float]] = ((), ())
    #: The idf of a word that no example holds, as if one document held it.
    unseen: float = 1.0

    def score(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        """A score from 0 to 1 and the ids of the nearest examples that back it, nearest first."""
        queries = []
        for found in map(words_of, texts):
            terms, n = self.terms.numbers(found)
            # The squared length of the words without a number: that of all less that of the others.
            every = ((1 + np.log(np.fromiter(found.values(), float, len(found)))) ** 2).sum()
            other = self.unseen**2 * max(0.0, float(every - ((1 + np.log(n[terms < self.terms.n_words])) ** 2).sum()))
            queries.append(vector((terms, n), self.idf, self.terms.n_words, other=other if other > 1e-9 else 0.0))
        votes, shares = self.knots
        out = []
        for near in self.index.nearest(queries, self.k):
            found = vote(near, self.index.labels, self.prior)
            at = int(np.searchsorted(votes, found, side="right")) - 1
            share = shares[max(at, 0)] if votes and near else self.prior
            out.append((min(1.0, max(0.0, float(share))), [self.index.ids[a] for _, a in near[:3]]))
        return out


def vector(counted: Vector, idf: np.ndarray, n_words: int, without: np.ndarray | None = None, other: float = 0.0) -> Vector:
    """The unit vector of a text's terms (numbers, rising, and counts): words by (1 + ln count) * idf, scaled
    to the length REST, then telling terms by count * idf, those marked in ``without`` left out. ``other`` is the
    squared length of the words without a number: they lengthen the vector, and match nothing."""
    terms, n = counted
    if not len(terms):
        return terms, np.empty(0)
    words = terms < n_words
    weights = np.where(words, 1 + np.log(n), n) * idf[terms]
    if without is not None:
        weights[without[terms]] = 0
    if words.any():
        scale = REST / np.sqrt((weights[words] ** 2).sum() + other)
        weights[words] *= scale
        other *= scale**2
    weights /= max(1e-300, np.sqrt((weights**2).sum() + other))
    return terms[weights > 0], weights[weights > 0]


def vote(near: list[tuple[float, int]], labels: np.ndarray, prior: float) -> float:
    """Examples count by 1 / (0.1 + distance); the base rate counts as one far example."""
    weights = np.array([1 / (0.1 + 1 - min(1.0, s)) for s, _ in near])
    return float((weights[labels[[a for _, a in near]] == 1].sum() + prior) / (weights.sum() + 1)) if near else prior


def rising(votes: list[tuple[float, int]], prior: float) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: the share of toxic examples as a function that never falls."""
    pools: list[list[float]] = []  # [lowest vote, toxic, all]
    for at, label in sorted(votes):
        pools.append([at, label, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, toxic, n = pools.pop()
            pools[-1][1] += toxic
            pools[-1][2] += n
    return [p[0] for p in pools], [(p[1] + prior) / (p[2] + 1) for p in pools]


def _telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, n_candidates: int) -> np.ndarray:
    """Which terms are in at least 3 toxic examples, at least four times as frequent among toxic as among
    clean ones, and by chi-square unlike enough to be no chance find among as many terms."""
    n, rest = n_toxic + n_clean, toxic + clean
    chi = n * (toxic * (n_clean - clean) - clean * (n_toxic - toxic)) ** 2.0 / np.maximum(1e-9, float(n_toxic) * n_clean * rest * (n - rest))
    return (toxic >= 3) & (toxic * n_clean >= 4 * clean * n_toxic) & (chi >= 2 * np.log(max(2.0, n_candidates)))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = 6000, k: int = 11
) -> Model:
    """A model from at most ``max_examples`` labelled rows (1: toxic, 0: not), those with the smallest
    hashes of the id, and from the document frequencies of its terms in all of ``docs``.

    Terms are all words of the examples, and telling terms, which come in addition. Words that no example holds
    have no posting; they count in a text's length as if one document held them. Calibration: three folds by hash of the id; each fold's examples are judged by the others'
    examples with terms that the others' labels chose. Null ids, labels and other labels are left out, of
    repeated ids the toxic label counts and every text is an example; a null text is empty. Without
    examples of both kinds (an empty table has none) every text gets the base rate. Ids are integers. Texts of any
    length are taken whole. The driver holds the distinct words of at most ``max_examples`` texts with
    their counts, no texts; the dense postings take 8 bytes for each example and term that a sixteenth
    of the examples hold (48 MB for 1,000 such terms) and go out with the model.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    chosen = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).groupBy("id").agg(F.max("label").alias("label"))
    picked = [(r["id"], r["label"]) for r in chosen.orderBy(F.xxhash64("id"), "id").limit(max_examples).collect()]
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    # At most max_examples ids, so they may be broadcast at any size of the tables.
    wanted = F.broadcast(spark.createDataFrame(picked, "of long, label int"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("id")), F.lit(FOLDS)).cast("int").alias("fold")
    sample = docs.select(F.col(id_col).cast("long").alias("id"), text).join(wanted, F.col("id") == F.col("of")).select("id", "label", fold, "text")
    shape = "id long, label int, fold int"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(x.as_py()) for x in batch.column("text")]
            arrays = [pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "fold")), *arrays], ["id", "label", "fold", "words", "counts"])

    sample = cut(sample.mapInArrow(listed, f"{shape}, words array<string>, counts array<long>"))
    cells = [(f, label) for f in range(FOLDS) for label in (0, 1)]
    starts = [F.transform(F.filter("words", lambda w: F.char_length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("+"))) for n in BEGINNINGS]  # noqa: B023
    terms = sample.select("label", "fold", F.explode(F.array_distinct(F.concat("words", *starts))).alias("term"))
    counts = cut(terms.groupBy("term").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("toxic"), *[F.count_if((F.col("fold") == f) & (F.col("label") == x)).alias(f"n{f}{x}") for f, x in cells]))
    # Beginnings that toxic examples hardly have cannot be telling in any fold.
    found = counts.where(~F.col("term").endswith("+") | (F.col("toxic") >= 3))
    n_candidates = counts.count()
    held = found.select("term", *[f"n{f}{x}" for f, x in cells]).orderBy("term").toArrow()
    terms_found = held.column("term").to_pylist()
    grid = np.stack([c.to_numpy() for c in held.columns[1:]], axis=1).astype(np.int32).reshape(len(held), FOLDS, 2)
    del held
    there = {(r["fold"], r["label"]): r["count"] for r in sample.groupBy("fold", "label").count().collect()}
    n_toxic, n_clean = (sum(there.get((f, x), 0) for f in range(FOLDS)) for x in (1, 0))
    prior = (n_toxic + 0.5) / (n_toxic + n_clean + 1) if n_toxic + n_clean else 0.0

    def telling(without: int | None) -> np.ndarray:
        left = [f for f in range(FOLDS) if f != without]
        return _telling(grid[:, left, 1].sum(axis=1), grid[:, left, 0].sum(axis=1), sum(there.get((f, 1), 0) for f in left), sum(there.get((f, 0), 0) for f in left), n_candidates)

    marks = {f: telling(f) for f in (None, *range(FOLDS))}
    any_fold = np.flatnonzero(np.any([*marks.values()], axis=0))
    names = Terms([t for t in terms_found if not t.endswith("+")], [terms_found[i] for i in any_fold])
    if not (n_toxic and n_clean):
        return Model(Terms([], []), np.empty(0), Index([], [], [], 0), k, prior)
    shared = spark.sparkContext.broadcast(names)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(shared.value.n + 1, np.int64), 0
        for batch in batches:
            held: list[int] = []
            for x in batch.column(0):
                held += shared.value.held(all_words(x.as_py()))
            seen[:-1] += np.bincount(np.array(held, np.int64), minlength=len(seen) - 1)
            n += len(batch)
        seen[-1] = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "n"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.count(dict(zip(w.as_py(), n.as_py(), strict=True))) for w, n in zip(batch.column("words"), batch.column("counts"), strict=True)]
            arrays = [pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "fold")), *arrays], ["id", "label", "fold", "terms", "counts"])

    df = np.zeros(names.n + 1)
    found = docs.select(text).mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    taken = sample.mapInArrow(numbered, f"{shape}, terms array<int>, counts array<int>").toArrow()
    examples = []
    for row in range(len(taken)):
        key, label, fold_, *two = (taken.column(c)[row] for c in range(5))
        numbers, n = (x.values.to_numpy() for x in two)
        by = np.argsort(numbers)
        examples.append((key.as_py(), label.as_py(), fold_.as_py(), (numbers[by], n[by])))
    del taken, found, numbers, n, two
    examples.sort(key=lambda e: (e[0], e[1], e[3][0].tobytes(), e[3][1].tobytes()))

    def indexed(without: int | None) -> tuple[Index, np.ndarray]:
        idle = np.zeros(names.n, bool)
        idle[names.n_words :] = ~marks[without][any_fold]
        kept = [e for e in examples if e[2] != without]
        return Index([vector(e[3], idf, names.n_words, idle) for e in kept], [e[0] for e in kept], [e[1] for e in kept], names.n), idle

    votes: list[tuple[float, int]] = []
    for f in range(FOLDS):
        index, idle = indexed(f)
        own = [e for e in examples if e[2] == f]
        for at in range(0, len(own), BLOCK):
            asks = [vector(e[3], idf, names.n_words, idle) for e in own[at : at + BLOCK]]
            votes += [(vote(near, index.labels, prior), e[1]) for near, e in zip(index.nearest(asks, k), own[at : at + BLOCK], strict=True) if near]
        # One fold's index at a time.
        del index
        give_back()
    # What only a fold's labels chose is no term of the model.
    move = np.concatenate([np.ones(names.n_words, bool), marks[None][any_fold]])
    back = np.cumsum(move) - 1
    last = Terms(list(names.words), [terms_found[i] for i in any_fold if marks[None][i]])
    ids, kinds = [e[0] for e in examples], [e[1] for e in examples]
    final = [vector((back[t[move[t]]], n[move[t]]), idf[move], last.n_words) for *_, (t, n) in examples]
    examples.clear()
    index = Index(final, ids, kinds, last.n)
    shared.destroy()
    del final, names, shared, terms_found, grid
    give_back()
    return Model(last, idf[move], index, k, prior, rising(votes, prior), float(np.log((1 + df[-1]) / 2) + 1))


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with the struct ``out_col``: score (0 to 1), predicted (1 if the score is at least
    0.5) and evidence (ids of the nearest examples, at most 3). A null text is empty; a text without a
    word of the model gets the base rate and no evidence. Repeated rows are scored alike, texts of any length
    whole; ids are not looked at. A column named ``out_col`` is replaced. An empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.list_(pa.int64()))])

    @F.arrow_udf("score double, predicted int, evidence array<long>")
    def judged(texts: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(texts), BLOCK):
            found += shared.value.score(texts[at : at + BLOCK].to_pylist())
        return pa.array([{"score": s, "predicted": int(s >= 0.5), "evidence": e} for s, e in found], kind)

    return docs.withColumn(out_col, judged(F.coalesce(F.col(text_col), F.lit(""))))
