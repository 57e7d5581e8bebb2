"""The operators for training data against brute force, round trips and hostile input."""

import base64
import hashlib
import itertools
import json
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from newsdesk.llm import line_dedup, near_dups, neighbours, packing, quality, registry, sentencepieces, shards, tool_calls, toxicity, warc

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "one", "a b c d e", "Ünï çödé 中文 😀", "x" * 5000, "w " * 3000, "a\0b\tc\x0bd", "<|endoftext|> <s> ▁", "same line that is long enough\nother", "same line that is long enough\nother", "SAME line that is long enough \n", "  lead and trail  "]
KIND = "doc_id long, text string, id long, lot int, _stats int, n int"


@pytest.fixture(scope="module")
def odd(spark):
    """Hostile rows: nulls, empty and long texts, repeated rows and ids, and columns named like the operators' own."""
    rows = [(k, t, 7, 7, 7, 7) for k, t in enumerate(ODD)] + [(None, "null id", None, None, None, None), (3, "again another", 1, 1, 1, 1), (5, "a b c d e", 7, 7, 7, 7)]
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def docs():
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1


def test_block_max_is_exact():
    rng = random.Random(1)
    vectors = []
    for _ in range(700):
        v = {t: rng.random() for t in [*rng.sample(range(30), rng.randint(1, 6)), *rng.sample(range(30, 400), rng.randint(0, 9))]}
        norm = sum(w * w for w in v.values()) ** 0.5
        vectors.append((np.array(sorted(v)), np.array([v[t] / norm for t in sorted(v)])))
    index = toxicity.Index(vectors, list(range(700)), [0] * 700, 400)
    assert 0 < len(index.dense) < 60 and len(index.most) > 9
    whole = np.zeros((700, 400))
    for i, (terms, weights) in enumerate(vectors):
        whole[i, terms] = weights
    for k in (1, 9, 1000):
        for q, near in zip(range(90), index.nearest(vectors[:90], k), strict=True):
            cosines = whole @ whole[q]
            assert np.allclose([s for s, _ in near], [c for c in -np.sort(-cosines)[:k] if c > 1e-15])
            assert all(abs(cosines[index.ids[at]] - s) < 1e-9 for s, at in near)
    assert toxicity.Index([], [], [], 0).nearest([(np.empty(0, int), np.empty(0))], 3) == [[]]


def test_toxicity_terms():
    """Words and their telling terms against the plain definition, whole ASCII texts and others."""
    words, telling = ["bad", "badly", "so", "über", "x1"], ["bad", "so", "unbad", "bad+", "badl+", "übe+"]
    terms = toxicity.Terms(words, telling)
    for text in ("Bad_badly BAD so, so unbad baddest? x1\x0bx1\x1fba", "ÜBER bad\u00a0badly übers", "", "_ \n\x00"):
        found = re.findall(r"[^\W_]+", text.lower())
        want = Counter(words.index(w) for w in found if w in words)
        for k, t in enumerate(telling, len(words)):
            n = sum(w.startswith(t[:-1]) and len(w) >= len(t) if t.endswith("+") else w == t for w in found)
            want += Counter({k: n})
        assert toxicity._found(text) == found
        assert terms.count(toxicity.words_of(text)) == want
        assert list(terms.count(toxicity.words_of(text))) == sorted(want)
        assert terms.held(toxicity.all_words(text)) == set(want)


def test_toxicity_is_its_definition(spark):
    """Scores and evidence of every text, recomputed without an index from the model's terms and frequencies."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    counts = {k: model.terms.count(toxicity.words_of(t)) for k, t in texts.items()}
    df = Counter(t for c in counts.values() for t in c)
    assert np.allclose(model.idf, [np.log((1 + len(texts)) / (1 + df[t])) + 1 for t in range(model.terms.n)])
    # No word of an example is left out, and words that no example holds lengthen a text's vector.
    assert set(model.terms.words) == {w for k in set(model.index.ids) for w in toxicity.words_of(texts[k])}
    other = {k: sum(((1 + np.log(n)) * (np.log((1 + len(texts)) / 2) + 1)) ** 2 for w, n in toxicity.words_of(t).items() if w not in model.terms.words) for k, t in texts.items()}

    def dense(c, more=0.0):
        words = {t: (1 + np.log(n)) * model.idf[t] for t, n in c.items() if t < model.terms.n_words}
        norm = (sum(w * w for w in words.values()) + more) ** 0.5
        out = np.zeros(model.terms.n)
        for t, n in c.items():
            out[t] = words[t] / norm * toxicity.REST if t in words else n * model.idf[t]
        return out / max(1e-300, ((out**2).sum() + (more * (toxicity.REST / norm) ** 2 if words else more)) ** 0.5)

    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert sorted(model.index.ids) == sorted(toxic)
    examples = np.array([dense(counts[k]) for k in model.index.ids])
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.toxicity(docs, model).collect()}
    for key, c in counts.items():
        cosines = examples @ dense(c, other[key])
        near = [i for i in np.lexsort((np.arange(len(cosines)), -np.round(cosines, 12)))[: model.k] if cosines[i] > 0]
        assert all(abs(cosines[i] - cosines[model.index.ids.index(e)]) < 1e-9 for i, e in zip(near, got[key]["evidence"]))
        assert bool(near) == bool(got[key]["evidence"])
        weights = [1 / (1.1 - min(1, cosines[i])) for i in near]
        share = (sum(w for w, i in zip(weights, near) if toxic[model.index.ids[i]]) + model.prior) / (sum(weights) + 1)
        at = [y for x, y in zip(*model.knots) if x <= share + 1e-9] or model.knots[1][:1]
        assert abs(got[key]["score"] - (at[-1] if near else model.prior)) < 1e-6 or min(abs(x - share) for x in model.knots[0]) < 1e-6


def test_toxicity_copies_and_scripts(spark):
    """A copy of an example finds it, whatever its words; unspaced letters count by pairs."""
    base = [(k, " ".join(f"w{k}x{j}" for j in range(30)) * 1 + f" shared{k % 3}", k % 2) for k in range(20)]
    texts = [(k, t) for k, t, _ in base] + [(100 + k, t + " new") for k, t, _ in base] + [(200, "你好世界和平"), (201, "世界和平啊"), (202, "全不同的字")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, x) for k, _, x in base] + [(200, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.toxicity(docs, model).collect()}
    assert all(got[100 + k]["evidence"][0] == k for k in range(20)) and got[201]["evidence"] == [200] and got[202]["evidence"] == []


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    found = registry.op1_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    c = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert c[1, 1] / (c[1, 1] + c.get((1, 0), 0)) > 0.85
    assert c.get((0, 1), 0) <= 0.01 * c[0, 0]


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(None, 1), (1, None), (4, 1), (5, 0), (5, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.toxicity(odd, model).select("toxicity.score", "toxicity.predicted").collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    again = toxicity.toxicity(odd.withColumn("toxicity", F.lit(1)).withColumn("words", F.lit(1)), model)
    assert again.columns.count("toxicity") == 1 and again.select("toxicity.score").count() == odd.count()
    none = toxicity.fit(odd, labels.limit(0))
    assert toxicity.toxicity(odd.limit(0), none).count() == 0 and toxicity.toxicity(odd, none).where("toxicity.score > 0").count() == 0


# 2


def test_differencing():
    rng = np.random.default_rng(2)
    sums = np.zeros((500, 8), np.int64)
    sums[:, 0] = rng.integers(1, 10_000, 500)
    place, total = shards.difference(sums)
    assert np.array_equal(np.bincount(place[:, 0], sums[:, 0], 8), total) and total.max() - total.min() <= 2


def test_differencing_is_the_naive_one():
    """Against differencing over plain sorted lists of (sum, members), as the method is told."""
    rng = random.Random(14)
    for n, k in ((7, 3), (40, 4), (25, 2)):
        sizes = [rng.randrange(1, 500) for _ in range(n)]
        states = [[(x, [i])] + [(0, [])] * (k - 1) for i, x in enumerate(sizes)]
        order = list(range(n))
        while len(order) > 1:
            spread = lambda s: states[s][0][0] - states[s][-1][0]
            a, b = sorted(order, key=lambda s: (-spread(s), s))[:2]
            joined = [(x + y, p + q) for (x, p), (y, q) in zip(states[a], reversed(states[b]), strict=True)]
            states.append(sorted(joined, key=lambda t: -t[0]))
            order = [s for s in order if s not in (a, b)] + [len(states) - 1]
        sums = np.zeros((n, k), np.int64)
        sums[:, 0] = sizes
        place, total = shards.difference(sums)
        assert sorted(total.tolist()) == sorted(x for x, _ in states[order[0]])
        assert np.array_equal(np.bincount(place[:, 0], sizes, k), total)


@pytest.mark.parametrize(("lot", "fan"), [(20_000, 200), (10, 3)])
def test_sharding(spark, docs, lot, fan):
    got = shards.assign(spark.read.parquet(f"{SF}/documents.parquet"), 7, lot_size=lot, fan_in=fan, slice_rows=50).collect()
    text = dict(docs)
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    size, by_text, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        size[r["shard"]] += r["size"]
        by_text[raw].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Lots of a few groups are coarser, but never by more than the largest group.
    groups = Counter(raw for raw in map(str.encode, text.values()))
    largest = max(n * (len(raw) + 16) for raw, n in groups.items())
    assert max(size.values()) - min(size.values()) < (0.01 * sum(size.values()) / 7 + 50 if lot > 1000 else largest)


def test_sharding_odd(spark, odd):
    got = shards.assign(odd, 40).collect()
    assert len(got) == odd.count() and {r["size"] for r in got if r["doc_id"] == 0} == {16}
    assert shards.assign(odd.limit(0), 40).count() == 0


# 3


def check_packing(rows, texts, length):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for key, text in texts.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return sum(r["length"] for r in rows) / (len(by_sequence) * length)


def test_packing(spark, docs):
    rows = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), slice_rows=30).collect()
    assert check_packing(rows, dict(docs), 2048) > 0.97


def test_packing_odd(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    unique = odd.where("doc_id IS NOT NULL AND doc_id NOT IN (3, 5)")
    check_packing(packing.pack(unique, path).collect(), {r["doc_id"]: r["text"] for r in unique.collect()}, 2048)
    assert packing.pack(odd, path).groupBy().sum("length").first()[0] > 0 and packing.pack(odd.limit(0), path).count() == 0


def test_packing_of_short_documents(spark):
    """Documents of a few ids fill their sequences."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(9)
    for sizes in ([0], [8], [24], list(range(40))):
        texts = {k: " a" * rng.choice(sizes) for k in range(4000)}
        rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path, length=512).collect()
        assert check_packing(rows, texts, 512) >= 0.97


def test_repeated_rows_are_many_slices(spark):
    """Equal rows without an id are dealt to slices like others and fill sequences without gaps."""
    docs = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'same' AS text")
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=64, slice_rows=100).collect()
    held = Counter(r["sequence_id"] for r in rows)
    assert len(rows) == 3000 and len(held) == -(-3000 // 32) and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000
    slots = shards.assign(docs, n_shards=3, slice_rows=100).collect()
    assert sorted(r["slot"] for r in slots) == list(range(3000)) and len({r["shard"] for r in slots}) == 1


def test_tokenizer_holds_bytes_not_entries():
    """Texts without spaces are not remembered, and generations end by their bytes; ids stay right."""
    tok = packing.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    for _ in range(40):
        text = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(2000))
        assert tok.encode(text) == np.array(tok.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert tok.held == 0 and not tok.known
    tok.HELD_BYTES = 20_000
    for _ in range(60):
        text = " ".join(f"w{rng.randint(0, 500)}x" for _ in range(40))
        assert tok.encode(text) == np.array(tok.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert sum(tok.ENTRY_BYTES + 4 * len(k) + len(v) for k, v in tok.known.items()) == tok.held <= 20_000
        assert sum(tok.ENTRY_BYTES + 4 * len(k) + len(v) for k, v in tok.old.items()) <= 20_500


def test_prices_are_the_best():
    """The knapsack's pattern against all patterns, with classes of uneven sizes."""
    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes = np.unique(rng.integers(1, 12, 4))
        values, capacity = rng.random(len(sizes)) * (rng.random(len(sizes)) < 0.8), int(sizes[-1]) * 2
        best = np.zeros(capacity + 1)
        for w in range(1, capacity + 1):
            best[w] = max([best[w - 1], *(best[w - s] + v for s, v in zip(sizes, values) if s <= w)])
        pattern = packing._price(values, sizes, capacity)
        assert pattern @ sizes <= capacity and abs(pattern @ values - best[capacity]) < 1e-9
    assert packing.class_sizes(20, 4, 8).tolist() == [1, 2, 3, 4, 12, 20] and packing.class_sizes(3, 64, 8).tolist() == [1, 2, 3]


def test_column_generation():
    rng = np.random.default_rng(3)
    demand = np.bincount(rng.integers(1, 65, 5000), minlength=65)[1:]
    patterns, x = packing.columns(demand)
    units = np.arange(1, 65)
    assert (patterns @ units <= 64).all() and ((patterns.T * x).sum(axis=1) >= demand - 1e-6 * demand.sum()).all()
    assert x.sum() < 1.01 * (demand @ units) / 64 + 1
    made = packing.plan(demand)
    assert np.array_equal((made.patterns * made.counts[:, None]).sum(axis=0), demand)


def test_column_generation_against_the_least():
    """The program's value is between the least number of sequences by volume and by exhaustive search."""

    def least(items, size):
        best = len(items)

        def place(k, room):
            nonlocal best
            if len(room) >= best:
                return
            if k == len(items):
                best = len(room)
                return
            for j in range(len(room)):
                if room[j] >= items[k] and room[j] not in room[:j]:
                    place(k + 1, room[:j] + [room[j] - items[k]] + room[j + 1 :])
            place(k + 1, [*room, size - items[k]])

        place(0, [])
        return best

    rng = random.Random(15)
    for _ in range(30):
        size = rng.randint(6, 12)
        items = sorted((rng.randint(1, size) for _ in range(10)), reverse=True)
        demand = np.bincount(items, minlength=size + 1)[1:]
        _, x = packing.columns(demand)
        made, fewest = packing.plan(demand), least(items, size)
        assert sum(items) / size - 1e-6 <= x.sum() <= fewest * 1.003 + 1e-6
        assert fewest <= made.counts.sum() <= fewest + 1


def test_other_tokenizers_stay_whole(tmp_path):
    made = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    made["pre_tokenizer"]["add_prefix_space"] = True
    made["normalizer"] = {"type": "Lowercase"}
    made["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    tok = packing.ChunkTokenizer(str(path))
    assert not tok.apart and packing.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json")).apart
    for text in ("Some Words here, and more.", "A\nB", ""):
        got = np.frombuffer(tok.encode(text), "<u4").tolist()
        assert got == tok.library.encode(text, add_special_tokens=False).ids and tok.library.decode(got).strip() == text.lower()


def test_chunks_are_the_tokenizers():
    tok = packing.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    pieces = ["a", "The", " ", "  ", "\n", "\n\n", ".", ",", "..", "'s", "\t", "é", "中", "1", "2.5", " ", "\x1c", "_", "😀", "<|endoftext|>", "\0"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert tok.encode(text) == np.array(tok.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


# 4


def components_of(rows):
    sets = {}
    for key, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_near_dups(spark, docs):
    got = near_dups.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components_of(docs)


def test_near_dups_branching(spark):
    """Leaves of three documents force branching and blocks; families differ in a few words at 0.75 and above."""
    rng = random.Random(5)
    rows, shared = [], [f"p{k}" for k in range(60)]
    for family in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for copy in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(copy % 4):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text + (shared if family % 2 else []))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = components_of(rows)
    for depth in (2, 12):
        got = near_dups.near_duplicates(df, leaf=3, depth=depth).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == wanted


def test_near_dups_recall_of_branches(spark):
    """All documents share a passage, so every node is large and really branches; no link may be lost."""
    assert near_dups.roots_for(1 - 2e-6, 75, 24) == 12 and near_dups.lost(0.75, 12, 24) < 2e-6 < near_dups.lost(0.75, 11, 24)
    rng, rows = random.Random(12), []
    shared = [f"p{k}" for k in range(100)]
    for _ in range(60):
        base = shared + [f"w{rng.randrange(10**6)}" for _ in range(38)]
        for copy in range(3):
            text = list(base)
            if copy:
                at = rng.randrange(100, 128)
                text[at : at + rng.randint(3, 12)] = [f"x{rng.randrange(10**6)}" for _ in range(8)]
            rows.append((len(rows), " ".join(text)))
    levels = []
    branch = near_dups._branch
    near_dups._branch = lambda nodes, roots: levels.append(1) or branch(nodes, roots)
    try:
        got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=14).collect()
    finally:
        near_dups._branch = branch
    assert len(levels) >= 2
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components_of(rows)


def test_near_dups_hot_label(spark):
    """A large group of one label and strays in its nodes; sets of a node in parts of a few hundred bytes."""
    rng, rows = random.Random(13), []
    base = [f"w{k}" for k in range(100)]
    for k in range(90):
        rows.append((len(rows), " ".join(base + [f"y{k}"])))
    for k in range(12):  # linked with few of the others, through their own ends
        rows.append((len(rows), " ".join(base[:62] + [f"z{k}x{j}" for j in range(rng.choice([20, 9, 30]))] + base[62:90])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dups.near_duplicates(df, leaf=20, node_bytes=1500).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components_of(rows)


def test_joins_on_nodes_can_be_split(spark):
    """Both sides of a join on nodes come from exchanges of their own, so adaptive execution may split a hot one."""
    first = spark.range(100).selectExpr("id AS rep", "id % 3 AS node")
    sizes = first.groupBy("node").agg(F.count("*").alias("size"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = first.join(sizes.select(near_dups._again("node"), "size"), "node")._jdf.queryExecution().executedPlan().toString()
        assert first.join(sizes.select(near_dups._again("node"), "size"), "node").count() == 100
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 3 and "SortMergeJoin" in plan


def test_near_dups_odd(spark, odd):
    got = near_dups.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (3, 5)}
    assert by[None]["component_id"] is None and by[1]["n_shingles"] == 0 and by[12]["component_id"] == 11 and by[4]["n_shingles"] == 1
    assert near_dups.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    got = {r["v"]: r["label"] for r in near_dups.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {v: v for ab in links for v in ab}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {v: r for v, r in root.items() if any(v in ab and ab[0] != ab[1] for ab in links)}


# 5


def test_lines_odd(spark, odd):
    got = line_dedup.dedup_lines(odd).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (3, 5)}
    assert len(got) == odd.count() and (by[0]["text"], by[0]["_n_lines"]) == (None, 1) and by[3 - 2]["_n_lines"] == 1
    assert (by[11]["text"], by[12]["text"], by[13]["text"]) == ("other", "other", ODD[13])
    assert (by[11]["_n_dropped"], by[13]["_n_dropped"], by[2]["id"]) == (1, 0, 7)
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_lines_of_shared_ids(spark):
    line = "the same long line in many rows"
    rows = [(1, line), (1, line + "\nx"), (2, line), (3, line.upper() + " of three"), (4, line + " of three"), (4, line + " of three\ny"), (5, " " + line + " of three")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"], r["_n_dropped"]) for r in got) == [(1, line, 0), (1, line + "\nx", 0), (2, line, 0), (3, "", 1), (4, "", 1), (4, "y", 1), (5, " " + line + " of three", 0)]


@pytest.mark.parametrize("name", ["op4_near_dups", "op5_line_dedup", "op8_tool_calls", "op10_warc"])
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    wanted = c.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(str, wanted))


# 6


def test_neighbours(spark):
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    got = neighbours.search(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 5 == 0).collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found, hits, n = defaultdict(list), 0, 0
    for r in got:
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in np.flatnonzero(ids % 5 == 0):
        cos = unit @ unit[q]
        cos[q] = -2
        true = set(ids[np.lexsort((ids, -cos))[:5]].tolist())
        mine = sorted(found[int(ids[q])])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(s - cos[np.flatnonzero(ids == v)[0]]) < 1e-9 for _, v, s in mine)
        hits, n = hits + len(true & {v for _, v, _ in mine}), n + 5
    assert hits / n >= 0.9


def test_neighbours_recall_large(spark):
    """Recall against brute force on 50,000 vectors around 400 centres, which are many blocks; every query is found k times."""
    rng = np.random.default_rng(11)
    n, dim = 50_000, 32
    x = rng.normal(size=(400, dim))[rng.integers(0, 400, n)] + 0.7 * rng.normal(size=(n, dim))
    vectors = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)})).repartition(8)
    got = neighbours.search(vectors, F.col("vec_id") % 50 == 0).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = defaultdict(set)
    for r in got:
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, n, 50):
        cos = unit @ unit[q]
        cos[q] = -2
        hits += len(set(np.argpartition(-cos, 5)[:5].tolist()) & found[q])
    recall = hits / (5 * len(range(0, n, 50)))
    print("recall", recall)
    assert set(Counter(r["query_id"] for r in got).values()) == {5} and recall >= 0.9


def test_neighbours_odd(spark):
    v = [1.0, 2.0, 0.5]
    rows = [(0, v), (1, [0.0] * 3), (2, None), (3, [1.0, None, 1.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, []), (7, [1.0]), (None, v), (8, v), (9, [-1.0, 1.0, 0.0]), (9, v), (10, [x * 3 for x in v])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, query int")
    got = [tuple(r) for r in neighbours.search(df, F.col("vec_id") % 5 == 0, block=2, query_block=1).orderBy("query_id", "rank").collect()]
    assert [(q, i) for q, _, i, _ in got if q == 0] == [(0, 8), (0, 9), (0, 10)] and {q for q, *_ in got} == {0, 10}
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 16))
    x[:60] = x[0] + 1e-3 * rng.normal(size=(60, 16))  # near copies that share their codes
    ids = rng.permutation(1200)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    asks = F.col("vec_id").isin(ids[:60].tolist())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def recall(got):
        found = defaultdict(set)
        for r in got:
            found[r["query_id"]].add(r["vec_id"])
        hits = 0
        for q in range(60):
            cos = unit @ unit[q]
            cos[q] = -2
            hits += len(set(ids[np.argsort(-cos)[:5]].tolist()) & found[int(ids[q])])
        return hits / 300

    def quantiser(coarse, probes):
        monkeypatch.setattr(neighbours, "train", lambda *_, **__: neighbours.Quantiser(unit[coarse].astype(np.float32), np.zeros((16, 256, 1), np.float32), probes))

    quantiser([0, *range(60, 160)], 3)
    assert recall(neighbours.search(df, asks, block=100).collect()) == 1
    # One list is opened and many hold few vectors: queries that find too few see all.
    quantiser(range(60, 660), 1)
    got = neighbours.search(df, F.col("vec_id") < 100, block=100).collect()
    assert Counter(r["query_id"] for r in got) == {i: 5 for i in range(100)}


# 7


def stats_of(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_statistics(spark, odd, docs):
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.createDataFrame([(1, "a b c a b c a b c a b"), (2, "a a a a"), (3, "x y z\nx y z\n \n")], "doc_id long, text string")):
        got = quality.judge(df, []).collect()
        assert len(got) == df.count()
        for r in got:
            assert tuple(r["_stats"][c] for c in quality.BASE) == stats_of(r["text"]), r["text"]
            n, *_, repeated = stats_of(r["text"])
            assert r["_base_failed"] == (n < 50 or 100 * repeated > 50 * n) and r["_kept"] == (not r["_base_failed"])
    assert quality.judge(odd.limit(0), []).count() == 0


def test_decision_list(spark):
    rng = random.Random(7)
    rows = [({f: rng.random() for f in quality.FEATURES}, False) for _ in range(900)]
    rows = [(r, r["upper_share"] > 0.8 and r["bang_share"] <= 0.5 or r["symbol_share"] > 0.95) for r, _ in rows]
    rules = quality.learn(rows)
    say = lambda r: any(all(t.holds(r) for t in rule) for rule in rules)
    assert sum(say(r) == bad for r, bad in rows) > 0.97 * len(rows)
    df = spark.createDataFrame([(r,) for r, _ in rows[:200]], f"s struct<{','.join(f + ':double' for f in quality.FEATURES)}>")
    assert [r[0] > 0 for r in df.select(quality.verdict(rules, F.col("s"))).collect()] == [say(r) for r, _ in rows[:200]]
    assert quality.learn([]) == [] and quality.learn([(rows[0][0], False)]) == []


def test_quality_verdict_is_its_definition(spark):
    """Every statistic and the verdict of learned rules, recomputed for every document."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    rules = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert rules
    dropped = 0
    for r in quality.judge(docs, rules).collect():
        text = r["text"] or ""
        n, chars, symbols, dup, repeated = stats_of(text)
        lines = len([x for x in text.split("\n") if words_of(x)])
        upper = len(regex.findall(r"\p{Lu}", text))
        row = dict(symbol_share=symbols / n if n else 0, dup_line_share=dup / lines if lines else 0, repeat_share=repeated / n if n else 0, mean_word=chars / n if n else 0,
                   upper_share=upper / chars if chars else 0, bang_share=text.count("!") / n if n else 0, line_words=n / lines if lines else 0)
        assert all(abs(row[f] - r["_stats"][f]) < 1e-12 for f in quality.FEATURES)
        number = next((k for k, rule in enumerate(rules, 1) if all(t.holds(row) for t in rule)), 0)
        failed = n < 50 or 100 * repeated > 50 * n
        assert (r["_rule"], r["_base_failed"], r["_kept"]) == (number, failed, not failed and number == 0)
        dropped += number > 0 and not failed
    assert dropped


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    rules = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.judge(docs, rules).where("NOT _base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality", "_kept").count().collect()
    c = {(r["quality"], r["_kept"]): r["count"] for r in got}
    assert c.get((1, False), 0) <= 0.01 * c[1, True] and c.get((0, True), 0) <= 0.1 * c[0, False]


# 8


def test_tool_calls(spark):
    schemas = {"add": {"x": {"type": "integer", "required": True, "min": 1}, "why": {"type": "string", "enum": ["a", "b"]}}}
    calls = [
        ("g", "c1", 5, "add", '{"why":"a","x":2}', ["c2"]), ("g", "c2", 9, "add", '{"x":0}', None), ("g", "c3", 1, "add", '{"x":"1","z":{"b":1,"a":2}}', ["c1", "nope"]),
        ("g", "c4", 2, "mul", "[1", None), ("g", "c4", 3, "mul", "[2", None), ("h", "a", 1, "add", '{"x":1}', ["b"]), ("h", "b", 2, "add", '{"x":1}', ["a"]), (None, "c1", 1, "add", "{}", None), ("g", None, None, None, None, None),
    ]
    results = [("g", "c1", 6, "two\n\"q\""), ("g", "c1", 7, "late"), ("g", "zz", 8, None), (None, None, 1, "x")]
    a = spark.createDataFrame(calls, "grp string, id string, at long, tool string, arguments string, after array<string>")
    b = spark.createDataFrame(results, "grp string, id string, at long, content string")
    got = {(r["grp"], r["id"]): r for r in tool_calls.link(a, b, schemas).collect() if r["position"] is not None or None in (r["grp"], r["id"])}
    order = [k for k, _ in sorted((((r["grp"], r["id"]), r["position"]) for r in got.values() if r["grp"] == "g" and r["id"]), key=lambda x: x[1])]
    assert [k[1] for k in order] == ["c4", "zz", "c2", "c1", "c3"] and [got[k]["position"] for k in order] == [0, 1, 2, 3, 4]
    assert got["g", "c1"]["errors"] == ["repeated result"] and got["g", "c1"]["linked"]
    assert got["g", "c2"]["errors"] == ["x is below 1"]
    assert got["g", "c3"]["errors"] == ["x is no integer", "unexpected: z", "unknown dependency: nope"]
    assert got["g", "c4"]["errors"] == ["unknown tool", "arguments are no object", "repeated call"]
    assert got["g", "zz"]["errors"] == ["result without a call"] and "depends on itself" in got["h", "a"]["errors"]
    assert len(got) == 10 and got[None, "c1"]["position"] is None
    record = got["g", "c3"]["record"]
    assert record == json.dumps(json.loads(record), sort_keys=True, separators=(",", ":"), ensure_ascii=False) and '"z":{"a":2,"b":1}' in record
    assert json.loads(got["g", "c1"]["record"])["result"] == 'two\n"q"'
    assert tool_calls.link(a.limit(0), b.limit(0), schemas).count() == 0


def test_tool_calls_deep(spark):
    """A chain of a thousand calls told backwards, and cycles: only the calls that wait for each other are marked."""
    rng, rows = random.Random(8), []
    rows += [("chain", f"c{k:04d}", 1000 - k, [f"c{k - 1:04d}"] if k else []) for k in range(1000)]
    # Two cycles that share a call, a call above them, a chain below them and one that waits for itself.
    knot = {"a": ["b", "up"], "b": ["c"], "c": ["a", "e"], "d": ["c"], "e": ["d"], "up": [], "self": ["self"]} | {f"f{k}": [f"f{k - 1}" if k else "b"] for k in range(5)}
    rows += [("knot", k, rng.randrange(50), on) for k, on in knot.items()]
    # Any acyclic graph, with equal and null times.
    names = [f"n{k}" for k in rng.sample(range(60), 60)]
    rows += [("any", n, rng.choice([None, 1, 2, rng.randrange(99)]), rng.sample(names[:i], min(i, rng.randrange(4)))) for i, n in enumerate(names)]
    df = spark.createDataFrame([(g, i, at, "t", "{}", on, 1) for g, i, at, on in rows], "grp string, id string, at long, tool string, arguments string, after array<string>, position int")
    none = spark.createDataFrame([], "grp string, id string, at long, content string")
    got = {(r["grp"], r["id"]): r for r in tool_calls.link(df, none, {"t": {}}).collect()}
    assert [got["chain", f"c{k:04d}"]["position"] for k in range(1000)] == list(range(1000))
    assert {i for (_, i), r in got.items() if "depends on itself" in r["errors"]} == {"a", "b", "c", "d", "e", "self"}
    for g, i, _, on in rows:
        for dep in on:
            if not (got[g, i]["errors"] and got[g, dep]["errors"]):
                assert got[g, dep]["position"] < got[g, i]["position"]
    for g in ("chain", "knot", "any"):
        assert sorted(r["position"] for (k, _), r in got.items() if k == g) == list(range(sum(k == g for k, *_ in rows)))


def test_tool_calls_repeats(spark):
    calls = [("g", "a", 1, "t", "{}", ["a2", None])] * 3 + [("g", "a", 2, "t", '{"x":1}', None)] * 2 + [("g", "a2", None, None, None, None)]
    results = [("g", "a", 3, "r"), ("g", "a", 4, "s"), ("g", "a", 4, "s"), ("g", "z", 1, None), ("g", "z", 1, None)]
    a = spark.createDataFrame([(*c, 0, "x") for c in calls], "grp string, id string, at long, tool string, arguments string, after array<string>, copies int, record string")
    b = spark.createDataFrame([(*r, 0) for r in results], "grp string, id string, at long, content string, linked int")
    got = [(r["id"], r["position"], r["linked"], r["errors"], json.loads(r["record"])) for r in tool_calls.link(a, b, {"t": {}}).collect()]
    assert sum(r["calls"] for *_, r in got) == 6 and sum(r["results"] for *_, r in got) == 5
    first = next(x for x in got if x[:3] == ("a", 1, True) or x[:3] == ("a", 2, True))
    assert first[3] == ["repeated call", "repeated result"] and (first[4]["calls"], first[4]["results"], first[4]["result"]) == (3, 1, "r")
    rest = sorted((x[0], x[3], x[4]["calls"], x[4]["results"]) for x in got if x[1] is None)
    assert rest == [("a", ["repeated result"], 0, 2), ("a", ["unexpected: x", "repeated call"], 2, 0)]
    assert next(x for x in got if x[0] == "z")[3] == ["result without a call", "repeated result"]


# 9


def test_pieces_are_the_librarys(odd, docs):
    codec = sentencepieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(9)
    bits = ["a", "word", " ", "  ", "\n", "▁", "é", "中", "😀", ".", "\t", "<s>", "\0", " "]
    texts = [t or "" for t in ODD] + [t for _, t in docs[:40]] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    for text in texts:
        ids, decimals = codec.encode(text)
        assert ids == codec.library.encode(text) and decimals == ",".join(map(str, ids)), repr(text)
        spans, raw = codec.spans(text), text.encode()
        assert [s[0] for s in spans] == ids
        assert all(s[2] <= s[3] for s in spans) and (not spans or spans[-1][3] == len(raw))
        for number, piece, start, end in spans:
            if not codec.library.is_byte(number) and "▁" not in text:
                assert piece.replace("▁", " ").strip(" ") == raw[start:end].decode().strip(" ")


def test_character_map():
    import sentencepiece

    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    blob = dict(f for field, value in sentencepieces._fields(rule.serialized_model_proto()) if field == 3 for f in sentencepieces._fields(value))
    codec = sentencepieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    codec.map, codec.dummy, codec.squeeze, codec.escape = sentencepieces.CharMap(blob[2]), True, True, True
    for text in ("ﬁne ①２", "Ａ b", "é é", "㍿ x", "ｶﾞ", "plain", "  two  spaces "):
        new, source = codec.normalise(text)
        assert new.decode() == rule.normalize(text) and len(source) == len(new) + 1 and source[-1] <= len(text.encode())
        assert source == sorted(source)


def test_sentencepiece_odd(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in sentencepieces.digests(odd, path).collect()}
    assert got[0]["n_tokens"] == 0 and got[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[7]["decoded_sha256"] == hashlib.sha256(ODD[7].encode()).hexdigest()
    assert sentencepieces.encoded(odd, path).count() == odd.count() and sentencepieces.digests(odd.limit(0), path).count() == 0


def test_spans_of_the_query(spark, odd, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec = sentencepieces.Codec(path)
    rng = random.Random(10)
    bits = ["a", "word", " ", "  ", "\n", "▁", "é", "中", "😀", ".", "<s>", "\0"]
    texts = [t or "" for t in ODD] + [t for _, t in docs[:40]] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    for text in texts:
        ids, _, ends = codec.covered(text)
        norm, source = codec.aligned(text)
        assert (norm.tobytes(), source.tolist()) == codec.normalise(text), repr(text)
        if "▁" not in text:
            for n, (a, b), piece in zip(ids, ends.reshape(-1, 2).tolist(), codec.library.encode(text, return_type="proto").pieces, strict=True):
                assert codec.library.is_byte(n) or (a, b) == (piece.begin, piece.end), repr(text)
    wanted = {k: hashlib.sha256(codec.project(t or "", codec.library.encode(t or "")).tobytes()).hexdigest() for k, t in docs}
    assert {r["doc_id"]: r["spans_sha256"] for r in registry.op9_sentencepiece(spark, SF).collect()} == wanted
    codec.project = lambda text, ids: np.array([0, 1] * len(ids))
    with pytest.raises(ValueError):
        codec.covered("several words of a text")


# 10


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 3000, "<p>b</p>\r\n\r\nWARC/1.1", "", "<p>a</p>"]
    rows = [(k * 10, f"http://h/{k}\n" if k != 4 else None, h, 1) for k, h in enumerate(html)] + [(None, "u", "<p>a</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, first int")
    made = {}
    for n in (1, 5):
        out = f"file://{tmp_path}/w{n}"
        manifest = warc.write(df.repartition(n), out, roll_bytes=600, range_bytes=3000).collect()
        made[n] = {r["file"]: r["sha1"] for r in manifest}
        assert sum(r["records"] for r in manifest) == len(rows) and not list((tmp_path / f"w{n}").glob(".pages*gz*[!c]"))
        got = {r["record_id"]: r for r in warc.read(spark, out).collect()}
        firsts = {}
        lone = got[warc.record_id(None, base64.b32encode(hashlib.sha1(b"<p>a</p>").digest()).decode())]
        assert lone["record_type"] == "response" and lone["refers_to"] is None
        for key, _, h, _ in rows[:-1]:
            raw = (h or "").encode()
            r = got[warc.record_id(key)]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            first = firsts.setdefault(raw, key)
            assert r["record_type"] == ("response" if first == key else "revisit") and r["refers_to"] == (None if first == key else warc.record_id(first))
            assert r["payload"] == (raw if first == key else None)
    assert made[1] == made[5] and len(made[1]) > 1
    empty = f"file://{tmp_path}/none"
    assert warc.write(df.limit(0), empty).count() == 0 and warc.read(spark, empty).count() == 0


def test_warc_ranges(spark, tmp_path):
    """An outlier among the ids, repeated ids, many pages without one: ranges stay small, and an independent reader agrees."""
    import gzip

    rng = random.Random(11)
    rows = [(k, "u", f"<p>{rng.random()}</p>" * 20, 1, 2, 3) for k in range(400)] + [(2**62, "far", "x", 1, 2, 3), (-(2**62), "low", None, 1, 2, 3)]
    rows += [(7, f"again{k}", rows[7][2], 1, 2, 3) for k in range(3)] + [(7, "other", "other", 1, 2, 3)] + [(None, f"n{k}", f"null {k}" * 100, 1, 2, 3) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, range int, cell int, node int")
    ranges, n = warc._ranges(df.select(F.col("page_id").alias("id"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size")).where("id IS NOT NULL"), 20_000, cells=16)
    placed = warc._placed(df.select(F.col("page_id").alias("id")).where("id IS NOT NULL"), ranges).collect()
    by = defaultdict(list)
    for r in placed:
        by[r["range"]].append(r["id"])
    assert sorted(by) == list(range(n)) and n > 15
    assert all(max(by[k]) < min(by[k + 1]) for k in range(n - 1))
    made = []
    for parts in (1, 4):
        out = f"file://{tmp_path}/r{parts}"
        made.append({r["file"]: r["sha1"] for r in warc.write(df.repartition(parts), out, range_bytes=20_000).collect()})
    assert made[0] == made[1] and len(made[0]) > 15
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "r1").glob("*.gz")))
    heads = re.findall(rb"WARC/1\.1\r\nWARC-Type: (\w+)\r\nWARC-Record-ID: <([^>]+)>", raw)
    assert len(heads) == len(rows) == len({h[1] for h in heads if b"page" in h[1]}) + 60
    got = {r["record_id"]: r for r in warc.read(spark, out).collect()}
    own = sorted((r["record_type"], r["refers_to"] or "") for k, r in got.items() if re.search(r"page:7(:\d)?$", k))
    assert [x for x, _ in own] == ["response"] * 2 + ["revisit"] * 3 and len({x for _, x in own}) == 2 and len(got) == len(rows)


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    one = p.stage_toxicity(spark, docs, SF)
    assert one.columns == docs.columns and 0.8 * len(before) < one.count() <= len(before)
    two = p.stage_quality(spark, docs, SF)
    kept = {r["doc_id"] for r in two.select("doc_id").collect()}
    for key, text in before.items():
        n, *_, repeated = stats_of(text)
        if n < 50 or 100 * repeated > 50 * n:
            assert key not in kept
    three = p.stage_line_dedup(spark, docs, SF)
    assert three.columns == docs.columns and three.count() == len(before)
    four = {r["doc_id"] for r in p.stage_near_dups(spark, docs, SF).select("doc_id").collect()}
    assert four == {k for k, (_, c) in components_of(before.items()).items() if k == c}
    whole = p.run(spark, SF).collect()
    assert {r["doc_id"] for r in whole} <= set(before)
    by_doc = defaultdict(int)
    for r in whole:
        by_doc[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert all(n == total for (_, n), total in by_doc.items())


def test_pipeline_stages_odd(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ties, clashing columns and empty tables in every stage."""
    import corpus_pipeline as p

    words = " ".join(f"word{k}" for k in range(80))
    texts = [None, "", " ", words, words, words + " more", "line that is long enough to count\n" + words, "line that is long enough to count\nx", "line that is long enough to count", "long " * 400_000, "x" * 2_000_000, "Ünï 中文 😀 " * 30]
    rows = [(k, t, "en", "s", len(t) if t else None, 1, 1, 1, 1) for k, t in enumerate(texts)] + [(None, words, None, None, None, 1, 1, 1, 1), (3, words, "en", "s", 1, 1, 1, 1, 1), (3, "other text of id three", "en", "s", 1, 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxicity int, _stats int, label int, node int").repartition(2)
    spark.createDataFrame([(3, 1, 0), (4, 1, 1), (5, 0, 0), (None, 1, 1), (6, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/none/labels.parquet")
    d = f"file://{tmp_path}"
    kept = {name: stage(spark, docs, d) for name, stage in p.STAGES}
    for name, found in kept.items():
        rows_ = found.collect()
        if name != "packing":
            assert tuple(found.columns) == p.COLUMNS and all(r["doc_id"] is None or 0 <= r["doc_id"] < len(texts) for r in rows_)
    ids = lambda name: Counter(r["doc_id"] for r in kept[name].select("doc_id").collect())
    assert not {0, 1, 2, 7, 8} & set(ids("quality_rules"))
    assert sum(ids("line_dedup").values()) == len(rows)
    near = ids("near_dups")
    assert near[3] >= 2 and 4 not in near and 5 not in near and near[None] == 1 and {0, 1, 2, 9, 10} <= set(near)
    assert set(ids("packing")) == {*range(len(texts)), None}
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), f"{d}/none").count() == 0, name
    everything = p.stage_toxicity(spark, docs, f"{d}/none")
    assert everything.count() == len(rows)


def test_pipeline_cleans_up(spark, tmp_path, monkeypatch):
    import corpus_pipeline as p

    monkeypatch.setattr(p, "scratch", lambda _, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(p, "STAGES", [("one", lambda s, docs, d: docs), ("two", lambda s, docs, d: docs.where("doc_id < 9")), ("three", lambda s, docs, d: docs)])
    assert p.run(spark, SF).count() > 0 and [x.name for x in tmp_path.iterdir()] == ["pipeline-three"]
