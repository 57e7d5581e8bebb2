"""Articles told twice: by equal text, by the best recent gist, by all gists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsdesk.functions.text import tokens
from newsdesk.operators.portal import placed
from newsdesk.operators.ranking import first_by, in_blocks
from newsdesk.shared import kept

#: The most frequent tokens, which have ranks.
_RANKED = 1 << 16
#: Places on which the hashes of all other tokens fall where tokens meet.
_PLACES = 1 << 18
#: Bands of set sizes for each doubling of the size.
_BANDS = 4
#: Of their rarest tokens, similar sets must have so many in common, or a quarter of what they share where that is less.
_ENOUGH = 8
#: Matches of tokens that a task holds at once.
_AT_ONCE = 1 << 18


def _hashed(gist: Column) -> Column:
    """The token set as 64-bit hashes: two words of one pair share one about once in 10^13 pairs."""
    return F.array_distinct(F.transform(tokens(gist), lambda w: F.xxhash64(w)))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists one after another, and where each list begins and the last ends."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy()
    return values, np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).astype(np.int64)


def _best_of_previous(t: pa.Table, pool: int, window: int, least: float) -> pa.Table:
    """(id, grp, match_id, score) of a block's own rows that have a match among the ``pool`` rows before them."""
    t = t.sort_by("place")
    values, ends = _lists(t.column("tokens"))
    codes = np.unique(values, return_inverse=True)[1]
    size, mark = np.diff(ends), np.zeros(len(codes) + 1, np.int64)
    us, home = t.column("us").to_numpy(), t.column("_home").to_numpy()
    grp = t.column("grp").combine_chunks().dictionary_encode().indices.to_numpy()
    rows, matches, scores = [], [], []
    for i in np.flatnonzero(home):
        lo = max(0, i - pool)
        own = codes[ends[i] : ends[i + 1]]
        mark[own] = 1
        sums = np.concatenate([[0], np.cumsum(mark[codes[ends[lo] : ends[i]]])])
        mark[own] = 0
        at = ends[lo : i + 1] - ends[lo]
        common = sums[at[1:]] - sums[at[:-1]]
        some = (size[lo:i] > 0) & (size[i] > 0)
        score = np.where(some, common / np.maximum(1, size[lo:i] + size[i] - common), 0.0)
        score[(grp[lo:i] != grp[i]) | (us[lo:i] <= us[i] - window) | (score < least)] = -1
        if len(score) and score.max() >= 0:
            best = len(score) - 1 - int(np.argmax(score[::-1]))  # the last of equal ones is the newest
            rows.append(i)
            matches.append(lo + best)
            scores.append(float(score[best]))
    at = pa.array(rows, pa.int64())
    return pa.table({"id": t.column("id").take(at), "grp": t.column("grp").take(at), "match_id": t.column("id").take(pa.array(matches, pa.int64())), "score": pa.array(scores, pa.float64())})


def best_recent(articles: DataFrame, id_col: str, url: Column, group: str, ts: Column, gist: Column, hours: int = 48, pool: int = 20, least: float = 0.5, block: int = 1000) -> DataFrame:
    """For each article the best of the ``pool`` articles of its group published before it, but
    not more than ``hours`` before, whose gist's Jaccard similarity is at least ``least``; ties go to the
    newer one. Rows of its own url are no candidates and take no place in the pool: a url has one row, the
    newest (D1). Articles without a match, a group or a time are left out. Equal times go by id; ids are unique.

    Ids, groups and times alone are sorted and numbered. Token sets come once to each block of ``block`` places,
    with the ``pool`` places before it, however many of them fall into one group or one moment.
    """
    rows = articles.select(F.col(id_col).alias("id"), url.alias("url"), F.col(group).alias("grp"), F.unix_micros(ts).alias("us"))
    rows = rows.where("grp IS NOT NULL AND us IS NOT NULL")
    newest = rows.where("url IS NOT NULL").groupBy("url").agg(F.max(F.struct("us", "id", "grp")).alias("last")).select("last.*")
    rows = rows.where("url IS NULL").select("id", "grp", "us").unionByName(newest.select("id", "grp", "us"))
    numbered = placed(rows, [F.col("grp"), F.col("us"), F.col("id")], "place")
    sets = articles.select(F.col(id_col).alias("id"), _hashed(gist).alias("tokens"))
    near = in_blocks(numbered.join(sets, "id"), "place", pool, block)
    window, kinds = hours * 3_600_000_000, {f.name: f.dataType for f in near.schema}
    out = T.StructType([T.StructField("id", kinds["id"]), T.StructField("grp", kinds["grp"]), T.StructField("match_id", kinds["id"]), T.StructField("score", T.DoubleType())])
    best = near.select("id", "grp", "us", "place", "tokens", "_block", "_home").groupBy("_block").applyInArrow(lambda t: _best_of_previous(t, pool, window, least), out)
    return best.select(F.col("id").alias(id_col), F.col("grp").alias(group), "match_id", "score")


def _indexed(sets: DataFrame, least: float) -> DataFrame:
    """(grp, id, size, pos, token): the tokens by which a join on tokens would meet similar sets, the rarest first. Of n
    tokens these are the first n - ceil(least * n) + 1. ``candidates`` are counted against the pairs of such a join."""
    each = sets.select("grp", "id", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    often = each.groupBy("grp", "token").agg(F.count("*").alias("n"))
    # A token of one set joins nothing, but counts in the order.
    ordered = each.join(often, ["grp", "token"]).groupBy("grp", "id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("rare"))
    first = F.col("size") - F.ceil(F.col("size") * least - 1e-9).cast("int") + 1
    prefix = ordered.select("grp", "id", "size", F.posexplode(F.slice("rare", F.lit(1), first)).alias("pos", "x")).where("x.n > 1")
    return prefix.select("grp", "id", "size", "pos", F.col("x.token").alias("token"))


def _coded(sets: DataFrame) -> DataFrame:
    """(grp, id, rare, common): a set's tokens, the rarest first. The most frequent tokens of the table, 65,536 at
    most, are written as their ranks, of two bytes each, in falling order, all others as they are, in rising order. Which
    tokens have a rank decides how short the lists are and in which order tokens meet, and nothing else."""
    counted = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    counted = kept(counted.withColumn("level", F.floor(F.log2("n") * 16).cast("int")))
    levels = sorted(counted.groupBy("level").count().collect(), reverse=True)
    most = sum(n <= _RANKED for n in np.cumsum([r["count"] for r in levels]))  # levels that fit
    ranked = counted.where(F.col("level") >= (levels[most - 1]["level"] if most else math.inf)).select("token", "n").toArrow()
    ranked = ranked.column("token").to_numpy()[np.lexsort((ranked.column("token").to_numpy(), -ranked.column("n").to_numpy()))]
    order = np.argsort(ranked)
    shared = sets.sparkSession.sparkContext.broadcast((ranked[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = shared.value
        for batch in batches:
            values, ends = _lists(batch.column("tokens"))
            size = np.diff(ends)
            owner = np.repeat(np.arange(len(size)), size)
            at = np.searchsorted(known, values)
            has = np.zeros(len(values), bool)
            inside = np.flatnonzero(at < len(known))
            has[inside] = known[at[inside]] == values[inside]
            common = np.sort(owner[has] * _RANKED + (_RANKED - 1 - ranks[at[has]]))
            common = (_RANKED - 1 - common % _RANKED).astype(np.uint16).view(np.int16)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[of], minlength=len(size)))]), pa.int32()), pa.array(x)) for of, x in ((~has, values[~has]), (has, common))]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("id"), *lists], ["grp", "id", "rare", "common"])

    kinds = {f.name: f.dataType for f in sets.schema}
    out = T.StructType([T.StructField("grp", kinds["grp"]), T.StructField("id", kinds["id"]), T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("common", T.ArrayType(T.ShortType()))])
    return sets.select("grp", "id", F.sort_array("tokens").alias("tokens")).mapInArrow(run, out)


def _marks(tokens: list[np.ndarray], many: list[np.ndarray]) -> np.ndarray:
    """For each set the parities of how many of its tokens fall on each of 4 to 8 places a token of the mean set, at least
    256, in words of 64 places. Every kind of tokens has its values one after another, and how many are each set's."""
    width = 1 << max(8, (4 * sum(map(len, tokens)) // len(many[0]) - 1).bit_length())
    odd, ends, step = np.zeros((len(many[0]), width // 8), np.uint8), [np.concatenate([[0], np.cumsum(n)]) for n in many], max(1, _AT_ONCE // width)
    for k in range(0, len(odd), step):
        rows = min(step, len(odd) - k)
        at = [np.repeat(np.arange(rows) * width, n[k : k + rows]) + (x[e[k] : e[k + rows]] & width - 1) for x, n, e in zip(tokens, many, ends, strict=True)]
        odd[k : k + rows] = np.packbits((np.bincount(np.concatenate(at), minlength=rows * width) & 1).astype(np.uint8)).reshape(rows, -1)
    return odd.view(np.int64).ravel()


def _packed(t: pa.Table) -> pa.Table:
    """The sets of one block as one row: their ids, and arrays of 64 bits a value, but of 16 for ranks."""
    (rare, of_rare), (common, of_common) = _lists(t.column("rare")), _lists(t.column("common"))
    ids, many = t.column("id").combine_chunks(), [np.diff(of_rare), np.diff(of_common)]
    parts = {"n_rare": many[0], "n_common": many[1], "rare": rare, "common": common, "mark": _marks([rare, common.astype(np.int64)], many)}
    one = {c: pa.array([x.tobytes()], pa.binary()) for c, x in parts.items()}
    return pa.table({c: t.column(c).slice(0, 1) for c in ("grp", "band", "block", "large")} | {"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)} | one)


class _Block:
    """A packed block: its sets' tokens as lists, and as places, the rarest first. Tokens without a rank share places."""

    def __init__(self, batch: pa.RecordBatch, row: int, end: str) -> None:
        of = lambda c, kind=np.int64: np.frombuffer(batch.column(f"{c}_{end}")[row].as_buffer(), kind)
        n_rare, n_common, self.ids = of("n_rare"), of("n_common"), batch.column(f"ids_{end}")[row].values
        self.rare, self.common, self.mark = of("rare"), of("common", np.uint16), of("mark", np.uint64)
        self.of_rare, self.of_common = (np.concatenate([[0], np.cumsum(n)]) for n in (n_rare, n_common))
        self.size, self.ends = n_rare + n_common, self.of_rare + self.of_common
        self.places = np.empty(self.ends[-1], np.int32)
        self.places[np.arange(len(self.rare)) + np.repeat(self.of_common[:-1], n_rare)] = _RANKED + (self.rare >> 40 & _PLACES - 1)
        self.places[np.arange(len(self.common)) + np.repeat(self.of_rare[1:], n_common)] = self.common

    def heads(self, other: np.ndarray, least: float, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rarest tokens of each set, and its number in the block. A set of ``other`` sizes that is similar
        has ``enough`` of them at least among its own: of an overlap of o, only o - enough can come later."""
        common = _overlap(self.size, np.maximum(other.min(), self.size * least), least)
        first = np.where(self.size * least <= other.max() + 1e-6, np.clip(self.size - common + enough, 0, self.size), 0)
        return self.places[_spans(self.ends[:-1], first)], np.repeat(np.arange(len(first), dtype=np.int32), first)

    def marks(self, words: int) -> np.ndarray:
        """The marks, folded to ``words`` words: a half on the other leaves the parities of half as many places."""
        out = self.mark.reshape(len(self.size), -1)
        while out.shape[1] > words:
            out = out[:, : out.shape[1] // 2] ^ out[:, out.shape[1] // 2 :]
        return out


def _overlap(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Tokens that sets of a and of b tokens have in common at least if they are similar."""
    return np.ceil((a + b) * (least / (1 + least)) - 1e-6).astype(np.int64)


def _spans(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each, one after another: places in lists, which have less than 2^31."""
    return np.repeat((starts - np.cumsum(many) + many).astype(np.int32), many) + np.arange(many.sum(), dtype=np.int32)


def _met(low: _Block, high: _Block, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of sets of two blocks that have so many of their rarest tokens in common, and whose marks differ in so few
    bits, that they may be similar, sorted by those of ``high``. Two sets differ in at least as many tokens as their marks in bits."""
    enough = int(np.clip(_overlap(low.size.min(), high.size.min(), least) // 4, 1, _ENOUGH))
    (codes, owner), (wanted, row) = low.heads(high.size, least, enough), high.heads(low.size, least, enough)
    holders = (np.sort(codes.astype(np.int64) << 32 | owner) & 0xFFFFFFFF).astype(np.int32)
    upto = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=_RANKED + _PLACES))])
    start, many = upto[wanted], upto[wanted + 1] - upto[wanted]
    some = np.flatnonzero(many)
    start, many, row = start[some], many[some], row[some].astype(np.int32 if len(low.size) * len(high.size) < 1 << 31 else np.int64)
    # Cuts between sets of high, wherever the matches are about as many as are held at once.
    upto, last = np.concatenate([[0], np.cumsum(many)]), np.append(np.flatnonzero(np.diff(row)) + 1, len(row))
    cuts = np.unique(np.concatenate([[0], last[np.searchsorted(upto[last], np.arange(_AT_ONCE, upto[-1] + _AT_ONCE, _AT_ONCE)).clip(max=len(last) - 1)]]))
    words = min(len(b.mark) // len(b.size) for b in (low, high))
    marks = low.marks(words), high.marks(words)
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        pairs = np.repeat(row[x:y] * len(low.size), many[x:y]) + holders[_spans(start[x:y], many[x:y])]
        pairs.sort()
        full = pairs[enough - 1 :] == pairs[: max(0, len(pairs) - enough + 1)]
        full &= np.append(True, pairs[1:] != pairs[:-1])[: len(full)]
        found = pairs[: len(full)][full]
        one, two = found // len(low.size), found % len(low.size)
        if same:
            one, two = one[one > two], two[one > two]
        for k in range(0, len(one), 1 << 15):
            p, q = one[k : k + (1 << 15)], two[k : k + (1 << 15)]
            apart = np.bitwise_count(marks[1][p] ^ marks[0][q]).sum(axis=1, dtype=np.int64)
            both = high.size[p] + low.size[q]
            near = both - apart >= 2 * both * (least / (1 + least)) - 1e-6
            if near.any():
                yield p[near], q[near]


def _scored(low: _Block, high: _Block, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The similarities of sets of ``high`` and sets of ``low``, by all their tokens."""
    common, mark = np.zeros(len(one), np.int64), np.zeros(_RANKED, np.int32)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(one)) + 1, [len(one)]])
    sums = lambda flags, many: np.diff(np.concatenate([[0], np.cumsum(flags)])[np.concatenate([[0], np.cumsum(many)])])
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        own, others = one[x], two[x:y]
        ranks = high.common[high.of_common[own] : high.of_common[own + 1]]
        many = low.of_common[others + 1] - low.of_common[others]
        mark[ranks] = 1
        common[x:y] = sums(mark[low.common[_spans(low.of_common[others], many)]], many)
        mark[ranks] = 0
        rare = high.rare[high.of_rare[own] : high.of_rare[own + 1]]
        if len(rare):
            many = low.of_rare[others + 1] - low.of_rare[others]
            values = low.rare[_spans(low.of_rare[others], many)]
            common[x:y] += sums(rare[np.searchsorted(rare, values).clip(max=len(rare) - 1)] == values, many)
    return common / (high.size[one] + low.size[two] - common)


def _similar(sets: DataFrame, least: float, tile_sets: int = 4000, tile_tokens: int = 2_000_000, small: int = 200_000, part: int = 12_000_000) -> DataFrame:
    """(grp, a, b, score): similar pairs of coded sets, each pair once.

    Sets of a group are dealt by their size into bands and those into blocks of at most about ``tile_sets`` sets and
    ``tile_tokens`` tokens, each of which is one row. Blocks of bands whose sizes may be similar meet two by two, and
    pairs are found and compared there, so neither tokens nor pairs are dealt: a set is shuffled as often in a large
    table as in a small one. Groups of over ``small`` tokens meet as partitions (of about ``part`` tokens) by partitions
    that are read from the shared folder, groups of fewer in one block a band by their key. However frequent a token or large a family is,
    a task holds two blocks at once.
    """
    reach = math.ceil(_BANDS * math.log2(1 / least) - 1e-9)
    made = kept(sets.withColumn("size", (F.size("rare") + F.size("common")).cast("long")).withColumn("band", F.floor(F.log2("size") * _BANDS + 1e-9).cast("int")))
    blocks = F.ceil(F.greatest(F.count("*") / tile_sets, F.sum("size") / tile_tokens)).cast("int")
    bands = made.groupBy("grp", "band").agg(blocks.alias("n"), F.sum("size").alias("tokens"))
    # The bands of large groups: a group for each ``small`` tokens or each block at most.
    large = bands.groupBy("grp").agg(F.max("n").alias("most"), F.sum("tokens").alias("tokens")).where(f"most > 1 OR tokens > {small}").select("grp")
    dealt = made.join(F.broadcast(bands.join(large, "grp").select("grp", "band", "n")), ["grp", "band"], "left")
    dealt = dealt.withColumns({"large": F.col("n").isNotNull(), "block": F.pmod(F.xxhash64("id"), F.coalesce("n", F.lit(1))).cast("int")})
    kinds = {f.name: f.dataType for f in sets.schema}
    arrays = [T.StructField(c, T.BinaryType()) for c in ("n_rare", "n_common", "rare", "common", "mark")]
    row = T.StructType([T.StructField("grp", kinds["grp"]), T.StructField("band", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("large", T.BooleanType()), T.StructField("ids", T.ArrayType(kinds["id"])), *arrays])
    total = made.agg(F.sum("size").alias("n")).first()["n"] or 0
    parts = max(min(12, total // small), -(-total // part), 1)
    packed = kept(dealt.select("grp", "band", "block", "large", "id", "rare", "common").groupBy("grp", "band", "block", "large").applyInArrow(_packed, row).repartition(parts))
    low, high = (packed.select([F.col(c).alias(f"{c}_{end}") for c in packed.columns]) for end in ("low", "high"))
    near = (F.col("grp_low") == F.col("grp_high")) & F.expr(f"band_high - band_low BETWEEN 0 AND {reach} AND (band_low < band_high OR block_low <= block_high)")
    # Partitions by partitions: a join by the group would bring all blocks of a large one to one task.
    tiles = low.where("large_low").hint("shuffle_replicate_nl").join(high.where("large_high"), near).unionAll(low.where("NOT large_low").join(high.where("NOT large_high"), near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                below, above = _Block(batch, k, "low"), _Block(batch, k, "high")
                same = all(batch.column(f"{c}_low")[k] == batch.column(f"{c}_high")[k] for c in ("band", "block"))
                for one, two in _met(below, above, same, least):
                    score = _scored(below, above, one, two)
                    good = np.flatnonzero(score >= least)
                    if len(good):
                        grp = pa.repeat(batch.column("grp_low")[k], len(good))
                        yield pa.RecordBatch.from_arrays([grp, above.ids.take(pa.array(one[good])), below.ids.take(pa.array(two[good])), pa.array(score[good])], ["grp", "a", "b", "score"])

    out = T.StructType([T.StructField("grp", kinds["grp"]), T.StructField("a", kinds["id"]), T.StructField("b", kinds["id"]), T.StructField("score", T.DoubleType())])
    return tiles.mapInArrow(run, out)


def candidates(sets: DataFrame, least: float, tile_sets: int = 4000, tile_tokens: int = 2_000_000) -> DataFrame:
    """(grp, a, b, score): the pairs of ``sets`` (grp, id, tokens) that are similar, each once. Equal sets stay apart."""
    return _similar(_coded(sets), least, tile_sets, tile_tokens)


def all_pairs(articles: DataFrame, id_col: str, group: str, gist: Column, least: float = 0.5, block_tokens: int = 2_000_000) -> DataFrame:
    """U-4: all pairs of a group at a Jaccard similarity of ``least`` or more (above 0), by their rarest tokens.

    Equal token sets are one before the join, their smallest id stands for them, so a hot gist costs no square.
    Sets are packed into blocks of about ``block_tokens``, in which pairs are found and compared (see ``_similar``).
    """
    grouped = articles.select(F.col(id_col).alias("id"), F.col(group).alias("grp"), gist.alias("gist")).where("grp IS NOT NULL")
    # The filter on the sets stays above explode(), so they are made once.
    each = grouped.select("id", "grp", F.explode(F.array(_hashed(F.col("gist")))).alias("tokens")).where(F.size("tokens") > 0)
    sets = _coded(each).groupBy("grp", "rare", "common").agg(F.min("id").alias("id"))
    found = _similar(sets, least, tile_tokens=block_tokens)
    return found.select(F.col("grp").alias(group), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def copies(articles: DataFrame, id_col: str, text: Column) -> DataFrame:
    """For each text its hash, the first id and how many rows hold it."""
    return articles.groupBy(F.sha2(text, 256).alias("content_hash")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))


def unseen(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """J7, U-5: candidates whose key isn't known yet."""
    return candidates.join(known.select(key), key, "left_anti")


def union_first(parts: list[DataFrame], key: str, *order: Column) -> DataFrame:
    """U-1, U-2, U-6: all parts one after another, the first row of each key."""
    numbered = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    whole = numbered[0]
    for more in numbered[1:]:
        whole = whole.unionByName(more)
    return first_by(whole, [key], F.col("_part"), *order).drop("_part")
