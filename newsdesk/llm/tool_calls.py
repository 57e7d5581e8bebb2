"""Chat formatting [native]: tool calls linked to their results, ordered, checked and serialised.

Calls and results meet in a hash join on their identifier, calls are put after what they depend on,
arguments are checked against schemas and every exchange becomes one canonical JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.llm.common import cut, remove, scratch, stored

#: {tool: {argument: rule}}; a rule has "type" (string, integer, number, boolean, array, object) and
#: may have "required", "min", "max" (of numbers, or of a string's length) and "enum".
Schemas = dict[str, dict[str, dict]]

_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*|FLOAT)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}


def json_text(value: Column) -> Column:
    """A string as a JSON string; null as null."""
    whole = F.to_json(F.array(value))
    return F.when(value.isNull(), "null").otherwise(F.substring(whole, F.lit(2), F.char_length(whole) - 2))


def _problems(tool: Column, arguments: Column, parsed: Column, schemas: Schemas) -> Column:
    """Messages in a fixed order: the tool, the form, each argument by name, then unexpected ones."""
    found = [
        F.when(~F.coalesce(tool.isin(*schemas), F.lit(False)), "unknown tool"),
        F.when(parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), "arguments are no object"),
    ]
    for name, rules in sorted(schemas.items()):
        ours = tool == name
        for argument, rule in sorted(rules.items()):
            at = f'$["{argument}"]'
            value = F.try_variant_get(parsed, at, "variant")
            there = value.isNotNull() & ~F.is_variant_null(value)
            right = F.schema_of_variant(value).rlike(_TYPES[rule["type"]])
            if rule.get("required"):
                found.append(F.when(ours & ~F.coalesce(there, F.lit(False)), f"{argument} is missing"))
            found.append(F.when(ours & there & ~right, f"{argument} is no {rule['type']}"))
            text = F.try_variant_get(parsed, at, "string")
            size = F.char_length(text) if rule["type"] == "string" else F.try_variant_get(parsed, at, "double")
            if "min" in rule:
                found.append(F.when(ours & there & right & (size < rule["min"]), f"{argument} is below {rule['min']}"))
            if "max" in rule:
                found.append(F.when(ours & there & right & (size > rule["max"]), f"{argument} is above {rule['max']}"))
            if "enum" in rule:
                found.append(F.when(ours & there & right & ~text.isin(*rule["enum"]), f"{argument} is not allowed"))
        extra = F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(a) for a in sorted(rules)]).cast("array<string>")))
        found.append(F.when(ours & (F.size(extra) > 0), F.concat(F.lit("unexpected: "), F.array_join(extra, ","))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _cycles(chain: DataFrame, ends: DataFrame, at: str) -> DataFrame:
    """(grp, id, head) of the ``ends`` (grp, id), all of them on cycles of ``chain`` (grp, id, parent):
    ``head`` is the smallest id of the cycle. Every round looks twice as far."""
    known = ends.join(chain, ["grp", "id"])
    low = stored(known.select("grp", "id", F.col("parent").alias("to"), F.least("id", "parent").alias("head")), at)
    n, seen = low.count(), 1
    while seen < n:
        far = low.select("grp", F.col("id").alias("to"), F.col("to").alias("next"), F.col("head").alias("other"))
        low = stored(low.join(far, ["grp", "to"]).select("grp", "id", F.col("next").alias("to"), F.least("head", "other").alias("head")), at)
        seen *= 2
    return low.select("grp", "id", "head")


def _roots(chain: DataFrame, at: str) -> tuple[DataFrame, DataFrame | None]:
    """Where the parents of ``chain`` (grp, id, parent) lead: (grp, id, to, dist), and the nodes on cycles
    if there are any. Every round doubles the steps; more than all nodes have are steps round a cycle."""
    steps = stored(chain.select("grp", "id", F.col("parent").alias("to"), F.lit(1).cast("long").alias("dist"), F.lit(True).alias("on")), at)
    n, seen = steps.count(), 1
    while True:
        far = steps.select("grp", F.col("id").alias("to"), F.col("to").alias("next"), F.col("dist").alias("more"))
        both = steps.join(far, ["grp", "to"], "left")
        steps = stored(both.select("grp", "id", F.coalesce("next", "to").alias("to"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("next").isNotNull().alias("on")), at)
        if steps.where("on").isEmpty():
            return steps, None
        if seen >= n:
            return steps, steps.where("on").select("grp", F.col("to").alias("id")).distinct()
        seen *= 2


def _ordered(nodes: DataFrame) -> DataFrame:
    """``nodes`` (grp, id, at, after) with place, hops and cyclic, by which every node sorts after those in
    ``after``: the latest time of all nodes it rests on, itself included, and the most steps from there.

    Only edges that point back in time move anything, so most inputs need one look. Otherwise each node
    follows the largest of the nodes it waits for, all chains of such choices are followed in steps that
    double, and the choices are made anew until none is better: deep chains take few rounds. Choices
    that go round are a cycle; its nodes become one, and the search starts again on what is left.
    """
    there = nodes.select("grp", F.col("id").alias("on"))
    listed = nodes.select("grp", "id", F.explode("after").alias("on"))
    alone = listed.where(F.col("id") == F.col("on")).select("grp", "id").distinct()
    edges = listed.where(F.col("id") != F.col("on")).distinct().join(there, ["grp", "on"], "left_semi")
    base = nodes.select("grp", "id", F.col("at").alias("place"))
    at = scratch(nodes.sparkSession, "order")
    heads: DataFrame | None = None  # (grp, id, head) of nodes on cycles
    while True:
        keys = base.select("grp", "id", "place", F.lit(0).cast("long").alias("hops"), F.lit(None).cast("string").alias("parent"))
        round_ = None
        while round_ is None:
            before = keys.select("grp", F.col("id").alias("on"), F.col("place").alias("p"), F.col("hops").alias("h"))
            late = edges.join(before, ["grp", "on"]).join(keys, ["grp", "id"]).where("struct(p, h) >= struct(place, hops)")
            late = stored(late.groupBy("grp", "id").agg(F.max(F.struct("p", "h", "on")).alias("best")).select("grp", "id", F.col("best.on").alias("follow")), at)
            if late.isEmpty():
                break
            keys = stored(keys.join(late, ["grp", "id"], "left").select("grp", "id", F.coalesce("follow", "parent").alias("parent")), at)
            chain = keys.where("parent IS NOT NULL")
            steps, round_ = _roots(chain, at)
            if round_ is None:
                ends = steps.join(base.select("grp", F.col("id").alias("to"), F.col("place").alias("p")), ["grp", "to"])
                valued = base.join(ends.select("grp", "id", "p", "dist"), ["grp", "id"], "left").join(keys, ["grp", "id"])
                keys = stored(valued.select("grp", "id", F.coalesce("p", "place").alias("place"), F.coalesce("dist", F.lit(0)).alias("hops"), "parent"), at)
        if round_ is None:
            break
        merged = _cycles(chain, round_, at)
        name = lambda c: merged.withColumnsRenamed({"id": c, "head": f"{c}_head"})  # noqa: E731, B023
        edges = edges.join(name("id"), ["grp", "id"], "left").join(name("on"), ["grp", "on"], "left")
        edges = edges.select("grp", F.coalesce("id_head", "id").alias("id"), F.coalesce("on_head", "on").alias("on"))
        edges = stored(edges.where(F.col("id") != F.col("on")).distinct(), at)
        base = base.join(name("id"), ["grp", "id"], "left").groupBy("grp", F.coalesce("id_head", "id").alias("id")).agg(F.max("place").alias("place"))
        base = stored(base, at)
        if heads is not None:
            old = heads.withColumnRenamed("head", "via").join(merged.withColumnsRenamed({"id": "via", "head": "new"}), ["grp", "via"], "left")
            old = old.select("grp", "id", F.coalesce("new", "via").alias("head"))
            merged = old.unionByName(merged.join(heads.select("grp", "id"), ["grp", "id"], "left_anti"))
        heads = stored(merged, at)
    keys = cut(keys)
    heads = cut(heads) if heads is not None else None
    remove(nodes.sparkSession, at)
    out = nodes.join(alone.withColumn("own", F.lit(True)), ["grp", "id"], "left")
    if heads is not None:
        out = out.join(heads, ["grp", "id"], "left").withColumn("known", F.coalesce("head", "id"))
        found = out.join(keys.select("grp", F.col("id").alias("known"), "place", "hops"), ["grp", "known"])
        return found.withColumn("cyclic", F.col("own").isNotNull() | F.col("head").isNotNull()).drop("own", "head", "known")
    return out.join(keys.select("grp", "id", "place", "hops"), ["grp", "id"]).withColumn("cyclic", F.col("own").isNotNull()).drop("own")


_CALL = "STRUCT<at: BIGINT, tool: STRING, arguments: STRING, after: ARRAY<STRING>, copies: BIGINT>"
_RESULT = "STRUCT<at: BIGINT, content: STRING, copies: BIGINT>"


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each identifier of a group: grp, id, position, linked, valid, errors, record.

    ``calls`` has grp, id, at (long), tool, arguments (JSON text) and after (array of ids in the group
    that must come first); ``results`` has grp, id, at and content. Of calls, or results, that share
    an identifier the first by time (then by content) counts. The others come as rows of their own without
    a position, equal ones once; ``record`` has how many ``calls`` and ``results`` it stands for.
    A call without a result stays pending, a result without a call comes as an orphan at its own
    time. Unknown ids in ``after`` are an error of the record and order nothing, null ones are ignored. Calls
    that rest on themselves, through others or not, are marked and stand together; only those that wait
    for each other are. Rows with a null group or id cannot be linked: each comes as a row of its own with
    a null position. Null times sort first. An empty table gives no rows. Extra columns are ignored.

    position counts from 0 in each group, by dependencies (of any depth), then time, then id. ``record`` has
    sorted keys at every level, no white space and the same text in every run.
    """
    none = F.array().cast("array<string>")
    asked = calls.select("grp", "id", F.coalesce("at", F.lit(-(2**62))).alias("at"), "tool", "arguments", F.coalesce(F.array_compact("after"), none).alias("after"))
    came = results.select("grp", "id", F.coalesce("at", F.lit(-(2**62))).alias("at"), "content")
    named = F.col("grp").isNotNull() & F.col("id").isNotNull()
    # Equal rows are counted first, so what repeats often moves once.
    one = asked.where(named).groupBy("grp", "id", "at", "tool", "arguments", "after").agg(F.count("*").alias("copies"))
    two = came.where(named).groupBy("grp", "id", "at", "content").agg(F.count("*").alias("copies"))
    call, result = F.struct("at", "tool", "arguments", "after", "copies"), F.struct("at", "content", "copies")
    first = one.groupBy("grp", "id").agg(F.min(call).alias("c"), F.count("*").alias("n_calls"))
    answer = two.groupBy("grp", "id").agg(F.min(result).alias("r"), F.count("*").alias("n_results"))
    pairs = first.join(answer.hint("shuffle_hash"), ["grp", "id"], "full")
    nodes = cut(pairs.select("grp", "id", "c", "r", "n_calls", "n_results", F.coalesce("c.at", "r.at").alias("at"), F.coalesce("c.after", none).alias("after")))
    # Positions: rows are dealt by ranges of the order, counted in each range and moved up by those before.
    order = ["place", "hops", "at", "id"]
    placed = cut(_ordered(nodes).repartitionByRange("grp", *order).withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("grp", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("grp", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("grp", "part").orderBy(*order)
    placed = placed.withColumn("own", F.row_number().over(own) - 1).join(starts, ["grp", "part"]).withColumn("position", (F.col("own") + F.col("start")).cast("long"))
    # Dependencies that no call has.
    wanted = nodes.select("grp", "id", F.explode("after").alias("on")).distinct()
    missing = wanted.join(nodes.select("grp", F.col("id").alias("on")), ["grp", "on"], "left_anti").groupBy("grp", "id").agg(F.array_sort(F.collect_set("on")).alias("missing"))
    every = placed.join(missing, ["grp", "id"], "left").select("grp", "id", "c", "r", "n_calls", "n_results", "position", "cyclic", "missing")
    lone = asked.where(~named).withColumn("copies", F.lit(1).cast("long")).select("grp", "id", call.alias("c"), F.expr(f"CAST(NULL AS {_RESULT})").alias("r"))
    stray = came.where(~named).withColumn("copies", F.lit(1).cast("long")).select("grp", "id", F.expr(f"CAST(NULL AS {_CALL})").alias("c"), result.alias("r"))
    more = [lone, stray]
    if not nodes.where("n_calls > 1 OR n_results > 1").isEmpty():
        firsts = nodes.where("n_calls > 1").select("grp", "id", F.col("c").alias("first"), "n_calls")
        more.append(one.join(firsts, ["grp", "id"]).where(call != F.col("first")).select("grp", "id", call.alias("c"), F.expr(f"CAST(NULL AS {_RESULT})").alias("r"), "n_calls"))
        firsts = nodes.where("n_results > 1").select("grp", "id", F.col("r").alias("first"), "n_results")
        more.append(two.join(firsts, ["grp", "id"]).where(result != F.col("first")).select("grp", "id", F.expr(f"CAST(NULL AS {_CALL})").alias("c"), result.alias("r"), "n_results"))
    for rows in more:
        every = every.unionByName(rows, allowMissingColumns=True)

    tool, arguments = F.col("c.tool"), F.col("c.arguments")
    every = every.withColumn("parsed", F.try_parse_json(arguments))
    has_call, has_result = F.col("c").isNotNull(), F.col("r").isNotNull()
    repeat = F.col("grp").isNotNull() & F.col("id").isNotNull() & F.col("position").isNull()
    more = F.array(
        F.when(F.col("grp").isNull() | F.col("id").isNull(), "no identifier"),
        F.when(~has_call & ~repeat, "result without a call"),
        F.when((F.col("n_calls") > 1) | (F.col("c.copies") > 1), "repeated call"),
        F.when((F.col("n_results") > 1) | (F.col("r.copies") > 1), "repeated result"),
        F.when(F.col("missing").isNotNull(), F.concat(F.lit("unknown dependency: "), F.array_join("missing", ","))),
        F.when(F.col("cyclic"), "depends on itself"),
    )
    errors = F.concat(
        F.when(has_call, _problems(tool, arguments, F.col("parsed"), schemas)).otherwise(F.array().cast("array<string>")),
        F.filter(more, lambda x: x.isNotNull()),
    )
    # explode() of the one value keeps what reads it from computing it again.
    every = every.withColumn("errors", F.explode(F.array(errors)))
    record = F.concat(
        F.lit('{"arguments":'), F.when(F.col("parsed").isNotNull(), F.to_json("parsed")).otherwise(json_text(arguments)),
        F.lit(',"calls":'), F.coalesce("c.copies", F.lit(0)).cast("string"),
        F.lit(',"errors":'), F.to_json("errors"),
        F.lit(',"id":'), json_text(F.col("id")),
        F.lit(',"position":'), F.coalesce(F.col("position").cast("string"), F.lit("null")),
        F.lit(',"result":'), json_text(F.col("r.content")),
        F.lit(',"results":'), F.coalesce("r.copies", F.lit(0)).cast("string"),
        F.lit(',"tool":'), json_text(tool), F.lit("}"),
    )
    return every.select(
        "grp", "id", "position", (has_call & has_result).alias("linked"), (F.size("errors") == 0).alias("valid"), "errors", record.alias("record")
    )
