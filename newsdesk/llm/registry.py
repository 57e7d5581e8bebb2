"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm import fill_middle, lexical, line_dedup, near_dups, neighbours, packing, quality, sentencepieces, shards, simhash, tool_calls, toxicity, warc
from newsdesk.llm.common import cut, remove, scratch, table


def public_file(name: str) -> str:
    """A public tokenizer's file. The path is a parameter of each operator; this is the queries' choice."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id):
    """One id in five teaches nothing; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    found = toxicity.toxicity(docs, toxicity.fit(docs, labels))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        F.col("toxicity.predicted").alias("predicted"),
        F.col("toxicity.evidence").alias("evidence"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"), n_shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"), length=2048, end_id=1)


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select(
        "doc_id",
        *[F.col(f"_stats.{c}").alias(c) for c in quality.BASE],
        F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
        F.col("_rule").alias("rule"),
    )


#: What a turn asks of an assistant, as the arguments of a call.
REPLY = {
    "reply": {
        "question": {"type": "string", "required": True, "min": 1, "max": 4000},
        "turn": {"type": "integer", "required": True, "min": 0},
        "words": {"type": "integer", "required": True, "min": 1},
    },
    "context": {"text": {"type": "string", "required": True, "min": 1}},
}


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds no tool calls, so each user turn is taken as a call of ``reply`` and the assistant's
    turn after it as the result; turns of other roles are calls of ``context`` that nothing answers. A reply
    depends on the one two turns before, and on a context just before it. Times run backwards, so that every
    dependency contradicts them and order comes from the dependencies alone; contexts of odd length are
    sent twice."""
    turns = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    user = turns.where(F.col("role") == "user")
    other = turns.where(F.coalesce(~F.col("role").isin("user", "assistant"), F.lit(True)))
    sent = F.when(F.char_length("text") % 2 == 1, 2).otherwise(1)
    known = user.select("conv_id", (F.col("turn") + 2).alias("turn")).distinct().withColumn("follows", F.lit(True))
    told = other.select("conv_id", (F.col("turn") + 1).alias("turn")).distinct().withColumn("told", F.lit(True))
    after = F.array_compact(F.array(F.when(F.col("follows"), name(F.col("turn") - 2)), F.when(F.col("told"), name(F.col("turn") - 1))))
    calls = user.join(known, ["conv_id", "turn"], "left").join(told, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("grp"), name(F.col("turn")).alias("id"), (-F.col("turn")).alias("at"), F.lit("reply").alias("tool"),
        F.to_json(F.struct(words.alias("words"), "turn", F.col("text").alias("question"))).alias("arguments"), after.alias("after"),
    ).unionByName(other.withColumn("sent", F.explode(F.array_repeat(F.lit(True), sent))).select(
        F.col("conv_id").alias("grp"), name(F.col("turn")).alias("id"), (-F.col("turn")).alias("at"), F.lit("context").alias("tool"),
        F.to_json(F.struct("text")).alias("arguments"), F.array().cast("array<string>").alias("after"),
    ))
    results = turns.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("grp"), name(F.col("turn") - 1).alias("id"), (-F.col("turn")).alias("at"), F.col("text").alias("content")
    )
    return tool_calls.link(calls, results, REPLY).select(
        F.col("grp").alias("conv_id"), F.col("id").alias("call_id"), "position", "linked", "valid", "record"
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(table(spark, sf_dir, "documents"), public_file("piece_bpe_32k.model"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), out)
    page = lambda name: F.regexp_extract(name, r"page:(-?\d+)(?::\d+)?$", 1).try_cast("long")
    # What was read back is kept, and the archives of this query go.
    found = cut(
        warc.read(spark, out, payloads=False).select(
            page("record_id").alias("page_id"),
            "payload_bytes",
            "payload_digest",
            "record_type",
            F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to"),
        )
    )
    remove(spark, out)
    return found


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # The text is rebuilt from what was put out and the form alone.
    back = fill_middle.restored(F.col("fim.output"), F.col("fim.form"))
    return made.select(
        "doc_id",
        *[F.col(f"fim.{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2(F.col("fim.output"), 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_near_dups": op4_near_dups,
    "op5_line_dedup": op5_line_dedup,
    "op6_neighbours": op6_neighbours,
    "op7_quality_rules": op7_quality_rules,
    "op8_tool_calls": op8_tool_calls,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_warc": op10_warc,
    "op11_fill_middle": op11_fill_middle,
    "op12_lexical": op12_lexical,
    "op13_simhash": op13_simhash,
}

ORACLES: dict[str, str] = {
    # Base32 by hand: the digest's 160 bits in 32 groups of five.
    "op10_warc": r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT hex, array_to_string(list_transform(string_split(hex, ''), lambda c:
    right('000' || bin(instr('0123456789abcdef', c) - 1), 4)), '') AS b FROM (SELECT DISTINCT hex FROM p)
), coded AS (
  SELECT hex, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (list_sum(list_transform(range(5), lambda j: CAST(substr(b, i * 5 + j + 1, 1) AS INT) * (16 >> j::INT)))::BIGINT + 1), 1)), '') AS payload_digest FROM bits
), firsts AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN coded USING (hex) JOIN firsts USING (hex)""",
    "op11_fill_middle": r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS s FROM documents
), drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
         array_to_string(u[greatest(x, y) + 1:], '') AS r FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || r || '<M>' || m ELSE '<S>' || r || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts""",
    "op12_lexical": r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL
), lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id
), totals AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM lengths
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, totals
), m AS (SELECT doc_id, 100 - 50 + ((50 * n * nd) // l) AS m FROM lengths, totals
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
    "op4_near_dups": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM worded
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), smallest AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN smallest ON smallest.a = d.doc_id""",
    "op5_line_dedup": r"""
WITH split AS (
  SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split
), common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id < c.keeper, FALSE) AS gone FROM lines l LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op8_tool_calls": r"""
WITH calls AS (
  SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'reply' ELSE 'context' END AS tool,
         len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM conversations WHERE role IS DISTINCT FROM 'assistant'
), results AS (
  SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant'
), runs AS ( -- replies that follow each other in steps of two turns
  SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run, turn % 2 AS side FROM calls WHERE tool = 'reply'
), firsts AS (
  SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id, side, run) AS first FROM runs
), chains AS ( -- what a reply rests on first: its run's first reply, or the context before that
  SELECT f.conv_id, f.turn, coalesce(c.turn, f.first) AS start, (f.turn - f.first) // 2 + CASE WHEN c.turn IS NULL THEN 0 ELSE 1 END AS hops
  FROM firsts f LEFT JOIN calls c ON c.conv_id = f.conv_id AND c.turn = f.first - 1 AND c.tool = 'context'
), paired AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, c.turn IS NOT NULL AS called,
         r.turn IS NOT NULL AS came, c.tool, c.text AS said, c.words, r.text AS content,
         CASE WHEN c.tool = 'context' AND length(c.text) % 2 = 1 THEN 2 ELSE 1 END AS sent,
         CASE WHEN c.turn IS NULL THEN -r.turn - 1 ELSE -coalesce(k.start, c.turn) END AS place, coalesce(k.hops, 0) AS hops
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.turn = r.turn
  LEFT JOIN chains k ON k.conv_id = c.conv_id AND k.turn = c.turn
), checked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place, hops, conv_id || ':' || turn) - 1 AS position,
         list_filter([CASE WHEN tool = 'context' AND said IS NULL THEN 'text is missing' END,
                      CASE WHEN tool = 'context' AND length(said) < 1 THEN 'text is below 1' END,
                      CASE WHEN tool = 'reply' AND said IS NULL THEN 'question is missing' END,
                      CASE WHEN tool = 'reply' AND length(said) < 1 THEN 'question is below 1' END,
                      CASE WHEN tool = 'reply' AND length(said) > 4000 THEN 'question is above 4000' END,
                      CASE WHEN tool = 'reply' AND words IS NULL THEN 'words is missing' END,
                      CASE WHEN tool = 'reply' AND words < 1 THEN 'words is below 1' END,
                      CASE WHEN NOT called THEN 'result without a call' END,
                      CASE WHEN sent > 1 THEN 'repeated call' END], lambda x: x IS NOT NULL) AS errors
  FROM paired
)
SELECT conv_id, conv_id || ':' || turn AS call_id, position, called AND came AS linked, len(errors) = 0 AS valid,
       '{"arguments":' || CASE WHEN tool = 'reply' THEN '{"question":' || CAST(to_json(said) AS VARCHAR) || ',"turn":' || turn || ',"words":' || words || '}'
                               WHEN tool = 'context' THEN '{"text":' || CAST(to_json(said) AS VARCHAR) || '}' ELSE 'null' END
       || ',"calls":' || CASE WHEN called THEN sent ELSE 0 END
       || ',"errors":' || CAST(to_json(errors) AS VARCHAR) || ',"id":"' || conv_id || ':' || turn || '","position":' || position || ',"result":'
       || CASE WHEN came THEN CAST(to_json(content) AS VARCHAR) ELSE 'null' END
       || ',"results":' || CASE WHEN came THEN '1' ELSE '0' END || ',"tool":' || coalesce('"' || tool || '"', 'null') || '}' AS record
FROM checked""",
}
