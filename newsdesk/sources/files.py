"""Readers and writers of the pipeline's files. Fetching them from the network is left to others."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.functions.urls import feed_form
from newsdesk.sources import schemas


_PAGE = pa.schema([("render_file", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("failure", pa.string())])


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return read.json(path)


def crawl_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each crawl file: site and day from its name, what it holds, or that it can't be read."""
    name = F.col("_metadata.file_name")
    return _json(spark, path, schemas.CRAWL).select(
        name.alias("file"), F.regexp_extract(name, r"^(.+)-(\d{4}-\d{2}-\d{2})\.json$", 1).alias("site"), F.regexp_extract(name, r"^(.+)-(\d{4}-\d{2}-\d{2})\.json$", 2).alias("day"),
        "source", "fetched_at", F.coalesce("count", F.size("articles")).alias("count"), "articles", F.col("_corrupt_record").isNotNull().alias("unreadable"),
    )


def packets(spark: SparkSession, path: str) -> DataFrame:
    """A row for each packet file with its time."""
    return _json(spark, path, schemas.PACKET).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("packet_at"))


def render_names(packet: DataFrame) -> DataFrame:
    """Each enriched entry with the name of its page: the place in the packet is part of
    the name where the packet has more than one enriched entry."""
    base = F.regexp_extract("file", r"^(?:infographic[-_])?(.+?)(?:\.json)?$", 1)
    n = F.size(F.filter("articles", lambda a: a["status"] == "enriched"))
    each = packet.select("file", "packet_at", base.alias("base"), n.alias("n"), F.posexplode("articles").alias("at", "entry")).where("entry.status = 'enriched'")
    suffix = F.when(F.col("n") > 1, F.concat(F.lit("-"), (F.col("at") + 1).cast("string"))).otherwise("")
    return each.select("file", "packet_at", "at", "entry", F.concat(F.lit("infographic_"), "base", suffix, F.lit(".dc.html")).alias("render_file"))


def jobs(spark: SparkSession, path: str, as_of: Column, limit: int = 20) -> DataFrame:
    """The newest jobs; unreadable snapshots are passed over, silent ones are stale."""
    rows = _json(spark, path, schemas.JOB).where("_corrupt_record IS NULL AND id IS NOT NULL")
    old = (F.col("status") == "running") & (F.col("updatedAt") < as_of - F.expr("INTERVAL 5 MINUTES"))
    return rows.withColumn("status", F.when(old, "stale").otherwise(F.col("status"))).orderBy(F.desc("startedAt"), "id").limit(max(1, limit))


def feed_time(text: Column) -> Column:
    """The time that a feed gives: RFC 822 with a zone or ISO 8601; null if it is neither."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\w+,\s*", ""), r"(GMT|UTC|UT|Z)$", "+0000")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm Z")), F.try_to_timestamp(F.trim(text)))


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, published): what feeds of either kind hold. Of an item its link, or else its guid, and
    pubDate or dc:date; of an Atom entry the first link of the kind alternate (which is what a link without a
    kind is), or else the first of all, and published or else updated. Prefixes of namespaces don't count."""
    read = lambda tag, schema: spark.read.format("xml").schema(schema).option("rowTag", tag).option("ignoreNamespace", True).option("mode", "PERMISSIVE").load(path)
    text = lambda c: F.trim(F.col(f"{c}._VALUE"))
    given = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs])
    value, link = "struct<_VALUE:string>", "struct<_VALUE:string,_href:string,_rel:string>"
    items = read("item", f"title {value}, link array<{link}>, guid {value}, pubDate {value}, date {value}, published {value}")
    links = F.transform(F.coalesce("link", F.array()), lambda x: F.trim(F.coalesce(x["_VALUE"], F.lit(""))))
    first = F.get(F.filter(links, lambda x: x != ""), F.lit(0))
    items = items.select(text("title").alias("title"), given(first, text("guid")).alias("link"), given(text("date"), text("pubDate"), text("published")).alias("published"))
    entries = read("entry", f"title {value}, link array<{link}>, published {value}, updated {value}")
    alternate = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    href = F.coalesce(F.get(alternate, F.lit(0)), F.get("link", F.lit(0)))["_href"]
    return items.unionByName(entries.select(text("title").alias("title"), F.trim(href).alias("link"), given(text("published"), text("updated")).alias("published")))


def feed_items(spark: SparkSession, path: str, since: str, zone: str, limit: int) -> DataFrame:
    """S1, P4, U-1: items and entries of captured feeds from a first local day on: newest first, the first of each
    url. Those without a link or a time that can be read are passed over."""
    found = feed_entries(spark, path).select(F.coalesce("title", F.lit("")).alias("title"), feed_form("link").alias("href"), feed_time(F.col("published")).alias("published_at"))
    found = found.where("href <> '' AND published_at IS NOT NULL")
    local = F.to_date(F.from_utc_timestamp("published_at", zone))
    newest = found.where(local >= F.lit(since).cast("date")).groupBy("href").agg(F.max(F.struct("published_at", "title")).alias("x"))
    return newest.select("href", "x.title", "x.published_at").orderBy(F.desc("published_at"), "href").limit(limit)


#: Charsets of captured pages that Spark decodes; GB2312 is read as GBK, which holds it.
CHARSETS = {"gbk": "GBK", "gb2312": "GBK", "gb18030": "GB18030", "big5": "Big5", "shift_jis": "Shift_JIS", "euc-jp": "EUC-JP", "euc-kr": "EUC-KR", "iso-8859-1": "windows-1252", "windows-1252": "windows-1252", "utf-16": "UTF-16"}


def page_text(content: Column, content_type: Column) -> Column:
    """Bytes as text: by the charset of the header, else of a meta tag in the first 2,048 bytes, else as
    UTF-8, or as GBK where that is no UTF-8 but fits. What fits nothing keeps replacement characters. Needs
    spark.sql.legacy.javaCharsets for charsets other than Unicode and Latin-1, and
    spark.sql.legacy.codingErrorAction for bytes that no charset holds."""
    head = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    named = F.lower(F.coalesce(F.nullif(F.regexp_extract(content_type, r"(?i)charset=([a-zA-Z0-9_-]+)", 1), F.lit("")), F.regexp_extract(head, r"(?i)<meta[^>]+charset=[\"']?([a-zA-Z0-9_-]+)", 1)))
    utf8, whole = content.cast("string"), F.is_valid_utf8(content.cast("string"))
    gbk = F.decode(content, "GBK")
    plain = F.when(whole, utf8).when(~gbk.contains("\ufffd"), gbk).otherwise(F.make_valid_utf8(utf8))
    made = None
    for name, charset in CHARSETS.items():
        made = F.when(named == name, F.decode(content, charset)) if made is None else made.when(named == name, F.decode(content, charset))
    return made.otherwise(plain)


def captured_text(spark: SparkSession, path: str, most: int = 8_000_000) -> DataFrame:
    """Captured responses up to a size as text (see page_text); files have no header."""
    raw = spark.read.format("binaryFile").load(path).where(F.col("length") <= most)
    return raw.select("path", page_text(F.col("content"), F.lit("")).alias("text"))


def robots_rules(text: Column, agent: str) -> Column:
    """The disallowed paths that hold for ``agent`` (up to its first space or slash) or everyone, in
    order. Rules belong to the agents named above them up to an empty line; comments are cut."""
    token = re.split(r"[\s/]", agent.lower())[0]
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    start = F.struct(F.lit(False).alias("ours"), F.array().cast("array<string>").alias("rules"))

    def step(state: Column, line: Column) -> Column:
        name, value = F.lower(F.regexp_extract(line, r"^([^:]*)", 1)), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))
        named = (name == "user-agent") & F.lower(value).isin("*", token)
        ours = F.when(line == "", F.lit(False)).otherwise(state["ours"] | named)
        rules = F.when((name == "disallow") & state["ours"], F.concat(state["rules"], F.array(value))).otherwise(state["rules"])
        return F.struct(ours.alias("ours"), rules.alias("rules"))

    return F.aggregate(lines, start, step, lambda s: s["rules"])


def sse_answer(text: Column) -> Column:
    """Text, finish_reason, usage (JSON) and error of a captured stream of data frames: contents
    joined, the last reason and usage. Frames that are no JSON are passed over; reasoning isn't the answer."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    frames = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.try_parse_json(F.btrim(F.substring(x, 6, 2**31 - 1), F.lit(" \t"))))
    frames = F.filter(frames, lambda x: x.isNotNull())
    every = lambda path: F.filter(F.transform(frames, lambda x: F.try_variant_get(x, path, "string")), lambda p: p.isNotNull())
    last = lambda values: F.get(values, F.size(values) - 1)
    usage = F.filter(F.transform(frames, lambda x: F.try_variant_get(x, "$.usage", "variant")), lambda u: u.isNotNull() & ~F.is_variant_null(u))
    errors = F.filter(F.transform(frames, lambda x: F.try_variant_get(x, "$.error", "variant")), lambda e: e.isNotNull() & ~F.is_variant_null(e))
    message = F.concat(F.lit("Stream error: "), F.coalesce(F.try_variant_get(F.get(errors, 0), "$.message", "string"), F.lit("unknown")))
    return F.struct(
        F.array_join(every("$.choices[0].delta.content"), "").alias("text"), last(every("$.choices[0].finish_reason")).alias("finish_reason"),
        F.to_json(last(usage)).alias("usage"), F.when(F.size(errors) > 0, message).alias("error"),
    )


def write_crawl(articles: DataFrame, path: str) -> None:
    """K1: JSON by site and day; days that the batch holds are replaced, others stay."""
    articles.write.partitionBy("site", "day").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def save_packet(documents: DataFrame, path: str, text: str) -> None:
    """K5: research documents with the hash of each text, for replay."""
    documents.withColumn("content_hash", F.sha2(text, 256)).write.mode("overwrite").json(path)


def replay(packet: DataFrame, text: str, content_hash: str) -> DataFrame:
    """K5: documents whose text no longer has the hash that was noted."""
    return packet.where(F.sha2(text, 256) != F.col(content_hash))


def site_configs(spark: SparkSession, path: str) -> DataFrame:
    """Site configurations by id, each with what is wrong with it."""
    from newsdesk.operators.crawl import config_errors

    rows = _json(spark, path, schemas.SITE)
    site = F.struct(*[F.col(c) for c in rows.columns if c != "_corrupt_record"])
    return rows.withColumn("errors", F.when(F.col("_corrupt_record").isNotNull(), F.array(F.lit("unreadable"))).otherwise(config_errors(site))).drop("_corrupt_record").orderBy("id")


def save_site_configs(configs: DataFrame, path: str) -> None:
    """K6: site configurations, one JSON object for each id in a folder of its own; saved ids are replaced, others stay."""
    from newsdesk.operators.crawl import config_errors

    wrong = configs.where(F.size(config_errors(F.struct(*configs.columns))) > 0)
    if not wrong.isEmpty():
        raise ValueError("a site configuration has errors; site_configs lists them")
    named = configs.withColumn("site_id", F.col("id")).repartition("site_id")
    named.write.partitionBy("site_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def publish_once(rows: DataFrame, path: str, number: int) -> bool:
    """Write a batch's rows as JSON to ``path``/jobs-<number>, under a hidden name that is renamed when it is whole, so
    readers see whole ones. A batch that comes again finds its folder and changes nothing, or writes anew
    what an attempt left half done. Whether this call published it."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    hidden, shown = at(f"{path}/.jobs-{number:09d}"), at(f"{path}/jobs-{number:09d}")
    system = shown.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(shown):
        system.delete(hidden, True)
        return False
    rows.withColumn("batch", F.lit(number)).write.mode("overwrite").json(hidden.toString())
    if not system.rename(hidden, shown):
        raise OSError(f"{hidden} could not be renamed to {shown}")
    return True


def write_job_snapshots(events: DataFrame, path: str, checkpoint: str, seconds: float = 0.5, late: str = "0 seconds"):
    """K4: the state of each crawl job that events (see streaming.state.job_progress) change, at most one write in
    ``seconds``. What came before is the stream's state, nothing is read again; see publish_once for
    what a retried batch does. Events may come ``late`` after newer ones. Returns the running query."""
    from newsdesk.streaming.state import job_progress

    def publish(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            if not rows.isEmpty():
                publish_once(rows, path, number)
        finally:
            rows.unpersist()

    progress = job_progress(events, late)
    return progress.writeStream.outputMode("update").foreachBatch(publish).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").option("checkpointLocation", checkpoint).start()


def search_hits(spark: SparkSession, path: str) -> DataFrame:
    """Recorded search answers, a row for each hit with its place."""
    rows = _json(spark, path, "query string, results array<struct<title:string,url:string,snippet:string,publisher:string>>, _corrupt_record string")
    return rows.where("_corrupt_record IS NULL").select("query", F.posexplode("results").alias("position", "hit")).select("query", "position", "hit.*")


def write_packets(packets: DataFrame, path: str) -> None:
    """K2: packets as JSON by site and day; days that the batch holds are replaced."""
    packets.write.partitionBy("site", "day").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def page_files(path: str):
    """The file system of ``path`` as executors open it, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:") if path.startswith(("/", "file:/")) else path)


def write_pages(pages: DataFrame, path: str) -> DataFrame:
    """K3: each (render_file, html) as a file of that name in ``path``, an address that executors open too. A task writes
    many files, each under a hidden name that is renamed when it is whole: a task that is repeated
    writes the same files again, readers see whole ones. Of rows with one name the greatest html counts.

    Returns what happened, as stored in ``path``/_manifest (replaced): (render_file, bytes, sha256, failure). A page
    that can't be written is a row with its failure and stops no other: rows without html (with
    pages_of's ``failure`` where there is one), names that leave the folder, errors of the file system."""
    spark = pages.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    reason = F.col("failure") if "failure" in pages.columns else F.lit(None).cast("string")
    one = pages.groupBy("render_file").agg(F.max("html").alias("html"), F.max(reason).alias("failure"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = page_files(root)
        files.create_dir(folder)
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                name, html = row["render_file"], row["html"]
                made = {"render_file": name, "bytes": None, "sha256": None, "failure": None}
                done.append(made)
                if html is None:
                    made["failure"] = row["failure"] or "no html"
                elif not name or name.startswith((".", "_")) or "/" in name or "\\" in name:
                    made["failure"] = "not a file name"
                else:
                    data, hidden = html.encode(), f"{folder}/.{uuid.uuid4().hex}"
                    try:
                        with files.open_output_stream(hidden) as out:
                            out.write(data)
                        _moved(files, hidden, f"{folder}/{name}")
                        made |= {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
                    except OSError as failed:  # one page's failure is data
                        made["failure"] = str(failed)[:500]
            yield pa.RecordBatch.from_pylist(done, schema=_PAGE)

    one.mapInArrow(run, "render_file string, bytes long, sha256 string, failure string").write.mode("overwrite").json(f"{root}/_manifest")
    return spark.read.schema("render_file string, bytes long, sha256 string, failure string").json(f"{root}/_manifest")


def _moved(files, hidden: str, shown: str) -> None:
    """Rename where that replaces, or remove what an earlier attempt left first."""
    try:
        files.move(hidden, shown)
    except OSError:
        try:
            files.delete_file(shown)
            files.move(hidden, shown)
        except OSError:
            files.delete_file(hidden)
            raise


def lost_pages(manifest: DataFrame, path: str) -> DataFrame:
    """Pages of a manifest that aren't in ``path`` as they were written."""
    spark = manifest.sparkSession
    held = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("render_file"), F.sha2("content", 256).alias("sha256"))
    return manifest.where("failure IS NULL").join(held, ["render_file", "sha256"], "left_anti")
