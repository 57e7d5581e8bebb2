"""The pipeline's run() as a whole against its stages recomputed in plain Python, text by text."""

import re
from collections import Counter, defaultdict

import numpy as np
import regex
from test_llm import check_packing, components_of, stats_of, words_of

import corpus_pipeline as pipeline
from newsdesk.llm import quality, toxicity
from newsdesk.llm.registry import held_out
from pyspark.sql import functions as F

D = "/root/testdata/sf0.01"


def toxic_ids(model, texts, toxic):
    """Ids whose score is at least 0.5: cosines with every example, without an index."""
    counts = {k: model.terms.count(toxicity.words_of(t or "")) for k, t in texts.items()}
    unseen = np.log((1 + len(texts)) / 2) + 1

    def vector(key):
        c = counts[key]
        more = sum(((1 + np.log(n)) * unseen) ** 2 for w, n in toxicity.words_of(texts[key] or "").items() if w not in model.terms.words)
        words = {t: (1 + np.log(n)) * model.idf[t] for t, n in c.items() if t < model.terms.n_words}
        norm = (sum(w * w for w in words.values()) + more) ** 0.5
        out = np.zeros(model.terms.n)
        for t, n in c.items():
            out[t] = words[t] / norm * toxicity.REST if t in words else n * model.idf[t]
        return out / max(1e-300, ((out**2).sum() + (more * (toxicity.REST / norm) ** 2 if words else more)) ** 0.5)

    examples = np.array([vector(k) for k in model.index.ids])
    found = set()
    for key in texts:
        cosines = examples @ vector(key)
        near = [i for i in np.lexsort((np.arange(len(cosines)), -np.round(cosines, 12)))[: model.k] if cosines[i] > 0]
        weights = [1 / (1.1 - min(1, cosines[i])) for i in near]
        share = (sum(w for w, i in zip(weights, near) if toxic[model.index.ids[i]]) + model.prior) / (sum(weights) + 1)
        at = [y for x, y in zip(*model.knots) if x <= share + 1e-9] or model.knots[1][:1]
        if (at[-1] if near else model.prior) >= 0.5:
            found.add(key)
    return found


def is_kept(text, rules):
    n, chars, symbols, dup, repeated = stats_of(text)
    lines = len([x for x in text.split("\n") if words_of(x)])
    upper = len(regex.findall(r"\p{Lu}", text))
    row = dict(symbol_share=symbols / n if n else 0, dup_line_share=dup / lines if lines else 0, repeat_share=repeated / n if n else 0, mean_word=chars / n if n else 0,
               upper_share=upper / chars if chars else 0, bang_share=text.count("!") / n if n else 0, line_words=n / lines if lines else 0)
    return n >= 50 and 100 * repeated <= 50 * n and not any(all(t.holds(row) for t in rule) for rule in rules)


def without_lines(texts):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for k, text in texts.items():
        for line in (text or "").split("\n"):
            holders[key(line)].add(k)
    gone = {line: max(ks) for line, ks in holders.items() if len(line) >= 20 and len(ks) >= 3}
    return {k: "\n".join(x for x in (text or "").split("\n") if gone.get(key(x), k) == k) for k, text in texts.items()}


def test_run_is_its_stages(spark):
    rows = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet").where(~held_out(F.col("doc_id")))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert len(texts) == rows.count()
    model = toxicity.fit(rows, labels)
    rejected = toxic_ids(model, texts, {r["doc_id"]: r["toxic"] for r in labels.collect()})
    one = {k: t for k, t in texts.items() if k not in rejected}
    rules = quality.fit(rows.where(~F.col("doc_id").isin(*rejected)), spark.read.parquet(f"{D}/labels.parquet"))
    two = {k: t for k, t in one.items() if is_kept(t or "", rules)}
    three = without_lines(two)
    groups = {k: c for k, (_, c) in components_of(three.items()).items()}
    four = {k: t for k, t in three.items() if groups[k] == k}
    # Every stage decides something here.
    assert len(texts) > len(one) > len(two) > len(four) and Counter(map(len, three.values())) != Counter(len(t or "") for t in two.values())
    got = pipeline.run(spark, D).collect()
    assert {r["doc_id"] for r in got} == set(four)
    assert check_packing(got, four, 2048) > 0.97
