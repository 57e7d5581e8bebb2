"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by id within ranges of about equal payload, each range is written as files that
roll over at a compressed size, and every header and digest is made anew. A file is written under a
temporary name and renamed, which a repeated task may do again with the same bytes; a manifest
written last says which files count.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm.common import cut, regrouped

MANIFEST = "file string, records long, bytes long, sha1 string"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _files(uri: str):
    """The file system of a folder and the folder's path there; pyarrow knows local, HDFS and object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(kind: str, number: str, url: str, date: str, payload: bytes, payload_digest: str, refers: str | None, refers_url: str | None) -> bytes:
    """One record as a gzip member. A response's block is an HTTP head and the payload, a revisit's the head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{number}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{refers}>",
            f"WARC-Refers-To-Target-URI: {_header(refers_url or '')}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _header(value: str) -> str:
    return " ".join(value.split())


def record_id(page_id: int | str | None, payload_digest: str = "") -> str:
    """The same for the same page in every run; a page without an id is known by its payload."""
    return f"urn:x-newsdesk:page:{page_id}" if page_id is not None else f"urn:x-newsdesk:payload:{payload_digest}"


def _classified(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(id, sha1, size, first): ``first`` is the smallest id with an equal payload."""
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    small = cut(pages.select(F.col(id_col).alias("id"), F.unhex(F.sha1(body)).alias("sha1"), F.octet_length(body).alias("size")))
    firsts = small.where(F.col("size") >= min_bytes).groupBy("sha1").agg(F.min("id").alias("first"))
    return small.join(firsts.select(regrouped("sha1"), "first"), "sha1", "left")


_STEP = "node int, cell long, range int, next int, low decimal(20,0), width decimal(20,0)"
_CELL = "CAST((CAST(id AS DECIMAL(20,0)) - low) DIV width AS LONG)"


def _ranges(rows: DataFrame, wanted: int, cells: int = 65_536) -> tuple[list[DataFrame], int]:
    """Tables of _STEP that lead each id of ``rows`` (id, size) to its range (see _placed), and the number of ranges.

    Ids are counted in equal cells, 64 for each range and at most about ``cells``. A cell with more than ``wanted`` bytes, or a
    32,768th of all, is divided into smaller ones, and so on, so that outliers and gaps among the ids
    don't matter. Neighbouring cells are gathered into ranges of about that many bytes; a single id is
    never divided. What comes to the driver at once is a short row for each cell.
    """
    spark = rows.sparkSession
    low, high, total = rows.agg(F.min("id"), F.max("id"), F.sum(F.col("size") + 600)).first()
    if low is None:
        return [], 0
    wanted = max(wanted, -(-total // 32_768))
    cells = min(cells, 64 * -(-total // wanted))
    parts = {0: (low, max(1, -(-(high - low + 1) // cells)))}  # a node's smallest id and the width of its cells
    levels: list[list[tuple[int, int, int, int | None]]] = []  # (node, cell, bytes, the node that divides it)
    left = rows.select("id", "size", F.lit(0).alias("node"), F.expr(_CELL.replace("low", f"({low})").replace("width", str(parts[0][1]))).alias("cell"))
    while True:
        found = sorted(map(tuple, left.groupBy("node", "cell").agg(F.sum(F.col("size") + 600)).collect()))
        heavy = [(node, cell) for node, cell, size in found if size > wanted and parts[node][1] > 1]
        numbers = {at: len(parts) + k for k, at in enumerate(heavy)}
        for node, cell in heavy:
            start, width = parts[node]
            parts[numbers[node, cell]] = (start + cell * width, max(1, -(-width // max(2, cells // len(heavy)))))
        levels.append([(node, cell, size, numbers.get((node, cell))) for node, cell, size in found])
        if not heavy:
            break
        step = [(node, cell, None, k, *map(Decimal, parts[k])) for (node, cell), k in numbers.items()]
        # At most ``cells`` short rows, so this table and the steps may be broadcast at any size.
        left = left.join(F.broadcast(spark.createDataFrame(step, _STEP)), ["node", "cell"])
        left = left.select("id", "size", F.col("next").alias("node"), F.expr(_CELL).alias("cell"))
    order = sorted((parts[node][0] + cell * parts[node][1], size, node, cell) for level in levels for node, cell, size, into in level if into is None)
    ranges, k, held = {}, 0, 0
    for _, size, node, cell in order:
        if held and held + size > wanted:
            k, held = k + 1, 0
        held += size
        ranges[node, cell] = k
    steps = [[(-1, 0, None, 0, *map(Decimal, parts[0]))]]
    steps += [[(n, c, ranges.get((n, c)), i, *(map(Decimal, parts[i]) if i is not None else (None, None))) for n, c, _, i in level] for level in levels]
    return [spark.createDataFrame(step, _STEP) for step in steps], k + 1


def _placed(rows: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """``rows`` with the range that the steps lead their ids to."""
    out = rows.withColumns({"node": F.lit(-1), "cell": F.lit(0).cast("long"), "range": F.lit(None).cast("int")})
    for step in steps:
        out = out.withColumnRenamed("range", "known").join(F.broadcast(step), ["node", "cell"], "left")
        out = out.withColumns({"range": F.coalesce("known", "range"), "node": F.col("next"), "cell": F.expr(_CELL)}).drop("known", "next", "low", "width")
    return out.drop("node", "cell")


def write(
    pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    date: datetime = datetime(2024, 1, 1, tzinfo=timezone.utc), min_bytes: int = 0, roll_bytes: int = 32_000_000, range_bytes: int = 16_000_000,
) -> DataFrame:
    """Write ``pages`` under the folder ``out`` and return its manifest (file, records, bytes, sha1).

    Of records with equal payloads of at least ``min_bytes`` bytes that with the smallest id is a
    response and the others revisit it. A null payload is empty, a null url is the empty text. Ids
    must be integers. Rows with a null id are responses of their own in the last ranges, known by their
    payload digest, and nothing refers to them. If an id repeats, records are ordered by payload hash and
    url, the later ones have a number after the id in their names, and of equal payloads under one id the
    first is the response and the others revisit it. Where one id has several payloads, other pages
    refer to the id's first name, and the payload digest says which one is meant. No pages: no files and an empty manifest. Other columns are not written.

    The same pages give the same files, whatever the partitions: ranges follow from the ids and sizes.
    """
    spark = pages.sparkSession
    stamp = date.strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = cut(_classified(pages.where(F.col(id_col).isNotNull()), id_col, payload_col, min_bytes))
    steps, n = _ranges(rows, range_bytes)
    # Pages without an id are dealt by their payloads.
    lone = pages.where(F.col(id_col).isNull()).agg(F.sum(F.octet_length(F.coalesce(F.col(payload_col), F.lit(""))) + 600)).first()[0] or 0
    n_lone = min(32_768, -(-lone // range_bytes))
    urls = pages.select(F.col(id_col).alias("first"), F.coalesce(F.col(url_col), F.lit("")).alias("first_url"))
    # A first is looked up by another expression than urls are grouped by, so that one of very many copies is a hot key that can be split.
    urls = urls.groupBy("first").agg(F.min("first_url").alias("first_url")).select((F.col("first") + 0).alias("first"), "first_url")
    links = rows.where(F.col("id") != F.col("first")).join(urls, "first").select("id", "sha1", "first", "first_url").distinct()
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    full = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), body.alias("payload"), F.unhex(F.sha1(body)).alias("sha1"))
    # A link comes to its page in the same shuffle, just before it in the order: payloads move once.
    both = full.withColumn("page", F.lit(1)).unionByName(links.withColumn("page", F.lit(0)), allowMissingColumns=True)
    here = _placed(both.where("id IS NOT NULL"), steps) if steps else both.where("id IS NOT NULL").withColumn("range", F.lit(0))
    rest = both.where("id IS NULL").withColumn("range", (F.lit(n) + F.pmod(F.xxhash64("sha1"), F.lit(max(1, n_lone)))).cast("int"))
    dealt = here.unionByName(rest).repartitionById(max(1, n + n_lone), F.col("range")).sortWithinPartitions("range", "id", "sha1", "page", "url")

    def write_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _files(out)
        done: list[tuple[str, int, int, str]] = []
        state: dict = {"range": None}
        link: tuple = (None, None, None, None)
        last, again = None, 0  # the id and payload before, and how many records of the id came
        first_name, first_url = "", ""  # of the first record with this id and payload

        def close() -> None:
            if state.get("stream"):
                state["stream"].close()
                system.move(state["tmp"], f"{root}/{state['name']}")
                done.append((state["name"], state["records"], state["bytes"], state["hash"].hexdigest()))
                state["stream"] = None

        def open_next(k: int) -> None:
            state["part"] = state["part"] + 1 if state["range"] == k else 0
            name = f"pages-{k:06d}-{state['part']:05d}.warc.gz"
            tmp = f"{root}/.{name}.{uuid.uuid4().hex}"
            state.update(range=k, name=name, tmp=tmp, stream=system.open_output_stream(tmp, compression=None), records=0, bytes=0, hash=hashlib.sha1())

        try:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    if not row.page:
                        link = (row.id, bytes(row.sha1), record_id(row.first), row.first_url)
                        continue
                    here, sha = (row.id, bytes(row.sha1)), base64.b32encode(row.sha1).decode()
                    same = row.id is not None and here == last
                    again = again + 1 if row.id is not None and here[0] == (last or (None,))[0] else 0
                    last, refers = here, link[2:] if link[:2] == here else (None, None)
                    if same and refers[0] is None and len(row.payload) >= min_bytes:
                        refers = (first_name, first_url)
                    name = record_id(row.id, sha) + (f":{again}" if again else "")
                    first_name, first_url = (first_name, first_url) if same else (name, row.url)
                    made = record("response" if refers[0] is None else "revisit", name, row.url, stamp, bytes(row.payload), sha, *refers)
                    if state["range"] != row.range or not state.get("stream") or state["bytes"] + len(made) > roll_bytes and state["records"]:
                        close()
                        open_next(row.range)
                    state["stream"].write(made)
                    state["hash"].update(made)
                    state["records"] += 1
                    state["bytes"] += len(made)
            close()
        finally:
            if state.get("stream"):
                state["stream"].close()
                system.delete_file(state["tmp"])
        yield pd.DataFrame(done, columns=["file", "records", "bytes", "sha1"])

    system, root = _files(out)
    system.create_dir(root, recursive=True)
    manifest = f"{out}/manifest.parquet"
    # Ids as texts: pandas would make numbers with nulls floating.
    named = dealt.select(F.col("id").cast("string").alias("id"), "url", "payload", "sha1", F.col("first").cast("string").alias("first"), "first_url", "page", "range")
    named.mapInPandas(write_ranges, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def records(stream, limit: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive, one record in memory at a time."""
    with gzip.GzipFile(fileobj=stream) as data:
        while line := data.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            headers: dict[str, str] = {}
            while (line := data.readline()).strip():
                name, _, value = line.decode().partition(":")
                headers[name.strip().lower()] = value.strip()
            size = int(headers["content-length"])
            block = data.read(size)
            if len(block) != size or digest(block) != headers["warc-block-digest"].removeprefix("sha1:"):
                raise ValueError(f"a damaged record: {headers.get('warc-record-id')}")
            yield headers, block


READ = "record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def read(spark: SparkSession, out: str, payloads: bool = True) -> DataFrame:
    """The records of all files in the manifest of ``out``. payload_bytes is what the response's
    HTTP head says, for revisits too. Block digests are checked, payload digests of responses as well."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest.parquet")

    def read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _files(out)
        columns = [c.split(" ")[0] for c in READ.split(", ")]
        for batch in batches:
            for name in batch["file"]:
                rows, held = [], 0
                with system.open_input_file(f"{root}/{name}") as stream:
                    for headers, block in records(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        kind, sha = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != size or digest(payload) != sha):
                            raise ValueError(f"a damaged payload: {headers['warc-record-id']}")
                        refers = headers.get("warc-refers-to")
                        kept = payload if payloads and kind == "response" else None
                        rows.append((headers["warc-record-id"].strip("<>"), kind, headers["warc-target-uri"], sha, size, refers and refers.strip("<>"), kept))
                        held += len(payload) if payloads else 100
                        if held > 8_000_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    files = manifest.select("file").repartition(manifest.count() or 1, "file")
    return files.mapInPandas(read_files, READ)
