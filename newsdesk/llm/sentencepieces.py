"""SentencePiece encoding and decoding that keeps byte offsets.

Texts are normalised by the longest prefix in the model's compiled character map, each normalised
byte remembering where it came from; pieces are then projected back to spans of original bytes.
The pieces themselves come from the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if tag & 7 == 2 else (8 if tag & 7 == 1 else 4, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _width(first: int) -> int:
    """Bytes of the UTF-8 character that begins with ``first``."""
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 and the strings that it points to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """What the longest key that starts at ``at`` becomes, and the key's length."""
        if not self.units:
            return None
        found, unit = None, self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & (1 << 31 | 255) != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                start = self.units[node] & 0x7FFFFFFF
                found = (self.strings[start : self.strings.index(b"\0", start)], k + 1 - at)
        return found


class Codec:
    """One model: normalisation, encoding, spans and decoding. Held once by a Python worker."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            data = file.read()
        rules = dict(f for field, value in _fields(data) if field == 3 for f in _fields(value))
        self.map = CharMap(rules.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [dict(_fields(value)) for field, value in _fields(data) if field == 1]
        names = [p[1].decode() for p in pieces]
        # Normalised bytes of each piece; one of those that stand for a byte, -1 of the unknown one.
        kinds = np.array([p.get(3, 1) for p in pieces])
        self.bytes = kinds == 6
        self.sizes = np.where(self.bytes, 1, np.where(kinds == 2, -1, [len(p[1]) for p in pieces]))
        self.decimals = [str(k) for k in range(len(names))]

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """The normalised bytes, and for each of them and the end the original byte it came from."""
        data = text.encode("utf-8", "replace")
        space = SPACE.encode() if self.escape else b" "
        out, source, at = bytearray(), [], 0

        def step(at: int) -> tuple[bytes, int]:
            if hit := self.map.longest(data, at):
                return hit
            size = _width(data[at])
            return data[at : at + size], size

        if self.squeeze:
            while at < len(data) and (hit := step(at))[0] == b" ":
                at += hit[1]
        if at == len(data):
            return b"", [at]
        if self.dummy:
            out += space
            source += [at] * len(space)
        before = self.squeeze
        while at < len(data):
            new, size = step(at)
            while self.squeeze and before and new.startswith(b" "):
                new = new[1:]
            before = new.endswith(b" ") if new else before
            for byte in new:
                out += space if byte == 32 else bytes([byte])
                source += [at] * (len(space) if byte == 32 else 1)
            at += size
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = source[len(out)]
                del source[len(out) :]
        return bytes(out), [*source, at]

    def aligned(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """normalise() as arrays; with no map and no squeezing, for all bytes at once."""
        if self.map.units or self.squeeze or not text:
            norm, source = self.normalise(text)
            return np.frombuffer(norm, np.uint8), np.array(source, np.int32)
        raw, space = text.encode("utf-8", "replace"), SPACE.encode() if self.escape else b" "
        head = space if self.dummy else b""
        data = np.frombuffer(raw, np.uint8)
        first = np.maximum.accumulate(np.where(data & 0xC0 != 0x80, np.arange(len(data), dtype=np.int32), 0))
        first = np.repeat(first, np.where(data == 32, len(space), 1))
        return np.frombuffer(head + raw.replace(b" ", space), np.uint8), np.concatenate([np.zeros(len(head), np.int32), first, np.array([len(data)], np.int32)])

    def project(self, text: str, ids: list[int]) -> np.ndarray:
        """The first byte and the byte after the last of the original text for each of its pieces
        ``ids``, in turn. The bytes that an unknown character falls back to share its span."""
        norm, source = self.aligned(text)
        numbers = np.array(ids, np.int64)
        sizes = self.sizes[numbers]
        if (sizes < 0).any():
            at = 0
            for k, size in enumerate(sizes.tolist()):
                sizes[k] = _width(norm[at]) if size < 0 and at < len(norm) else size
                at += sizes[k]
        stops = np.cumsum(sizes)
        starts = stops - sizes
        if sizes.sum() != len(norm):
            raise ValueError(f"pieces hold {sizes.sum()} of {len(norm)} normalised bytes")
        if (fell := self.bytes[numbers]).any():
            leads = np.append(np.flatnonzero(norm & 0xC0 != 0x80), len(norm))
            at = np.searchsorted(leads, starts[fell], "right")
            starts[fell], stops[fell] = leads[at - 1], leads[at]
        return np.stack([source[starts], source[stops]], axis=1).ravel().astype(np.int64)

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids, and the same as decimals with commas."""
        ids = self.library.encode(text) if text else []
        return ids, ",".join(map(self.decimals.__getitem__, ids))

    def covered(self, text: str) -> tuple[list[int], str, np.ndarray]:
        """encode() and the pieces' spans, which must follow one another from the first byte to the
        last; only bytes of one character may share a span, and only squeezed spaces at the ends may
        be left out."""
        ids, decimals = self.encode(text)
        ends = self.project(text, ids)
        starts, stops = ends[0::2], ends[1::2]
        first, last = 0, len(text.encode())
        if self.squeeze and ids:
            source = self.normalise(text)[1]
            first, last = source[0], source[-1]
        same = (starts[1:] == starts[:-1]) & (stops[1:] == stops[:-1])
        if (starts[0] != first or stops[-1] != last) if ids else last and not self.squeeze:
            raise ValueError(f"spans leave bytes of a text of {last} bytes at its ends")
        if (starts > stops).any() or not ((starts[1:] == stops[:-1]) | same).all():
            raise ValueError("spans have gaps or overlap")
        return ids, decimals, ends

    def spans(self, text: str) -> list[tuple[int, str, int, int]]:
        """(id, piece, first byte, byte after the last) of the original text for each id."""
        ids = self.encode(text)[0]
        ends = self.project(text, ids)
        return [(n, self.library.id_to_piece(n), a, b) for n, a, b in zip(ids, ends[0::2].tolist(), ends[1::2].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a model file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    return (x.as_py() or "" for x in batch.column(name))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, spans_sha256) for each row; null is an empty text,
    which has no ids. spans_sha256 is over the first byte and the byte after the last of the original
    text for each piece, as 64-bit integers, little end first; spans that do not cover a text are an error.

    The columns of the result are named so whatever else ``docs`` holds. Repeated rows stay.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            rows = []
            for text in _texts(batch, "text"):
                ids, decimals, ends = model.covered(text)
                spans = hashlib.sha256(ends.astype("<i8", copy=False)).hexdigest()
                rows.append((len(ids), _sha(decimals), _sha(model.decode(ids) if ids else ""), spans))
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
        .withColumnRenamed("id", id_col)
    )


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pieces, decoded): for each row all pieces as (id, piece, start, end), start and end being
    bytes of the original text in UTF-8. Null and empty texts have no pieces."""
    kind = docs.schema[id_col].dataType.simpleString()
    piece = pa.struct([("id", pa.int32()), ("piece", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            for at in range(0, len(batch), 64):  # spans are many times the text
                part = batch.slice(at, 64)
                spans = [model.spans(text) for text in _texts(part, "text")]
                rows = [[dict(zip(("id", "piece", "start", "end"), s, strict=True)) for s in row] for row in spans]
                decoded = [model.decode([s[0] for s in row]) if row else "" for row in spans]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, pa.list_(piece)), pa.array(decoded, pa.string())], ["id", "pieces", "decoded"])

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(run, f"id {kind}, pieces array<struct<id:int,piece:string,start:long,end:long>>, decoded string")
        .withColumnRenamed("id", id_col)
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
