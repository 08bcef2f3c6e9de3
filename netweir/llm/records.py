"""Token ids as length-delimited binary records with an offset index.

A record is

    uint64 length | uint32 masked CRC-32 of those 8 bytes | payload | uint32 masked CRC-32 of the payload | 0x0A

in little-endian order; the mask is the usual rotation by 15 bits plus a constant, so that checksums of data
that holds checksums stay strong. The last byte is the line end of Spark's text writer, which writes the
records: it commits whole tasks, so lost executors leave no half files, and reaches any file system that
Spark does. The payload is: 1 byte width of an id (2 or 4), 1 byte that is 1 if the document id is null, int64
document id, the ids.

Files follow one another in document order by their names. The index has a row per record with its file,
byte offset and length; a reader that shuffles takes rows of the index in any order.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netweir.llm.common import CACHES, map_texts, slices, text_key, written

HEAD, BODY = struct.Struct("<QI"), struct.Struct("<BBq")
ENTRIES = 600_000
#: what a part starts with, letters, closing punctuation
WORD = re.compile("([ \n]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)").fullmatch


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17 & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


class Encoder:
    """Encodes whole texts; the parts between spaces and line ends are encoded once and kept.

    A byte-level tokenizer cuts before a space that stands between two characters that are not white space,
    and on both sides of such a line end, whatever follows; so the ids of a text are those of its parts.
    Texts with any other white space go to the tokenizer whole. About `entries` parts are kept, in two halves:
    when the newer is full the older goes, and what is met again meanwhile moves to the newer.
    """

    def __init__(self, path: str, entries: int = ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.entries = entries
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.code = "H" if self.width == 2 else "I"
        # the characters that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in set(shown)]
        self.shown = {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(hidden)}
        self.space = self.shown[32]
        self.line = self._whole("\n")
        self.line_id = int(np.frombuffer(self.line, self.type)[0])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _each(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, encoded as lines of longer texts; a line end is one id by itself."""
        texts = ["\n".join(parts[i:i + 256]) for i in range(0, len(parts), 256)]
        out = []
        for i in range(0, len(texts), 32):
            for e in self.tokenizer.encode_batch_fast(texts[i:i + 32], add_special_tokens=False):
                ids = np.array(e.ids, self.type)
                data = ids.tobytes()
                cuts = (np.flatnonzero(ids == self.line_id) * self.width).tolist()
                out += [data[x:y] for x, y in zip([0, *(c + self.width for c in cuts)], [*cuts, len(data)])]
        return out

    def _learn(self, parts: set[str]) -> None:
        """Keeps the ids of parts without other white space: as they are after a space; after a line end, with \\n first; at the start of
        a text, with a space first.

        The tokenizer cuts a run of letters from closing punctuation. Most parts are such runs, which go to
        the tokenizer's model straight away and are kept without the punctuation as well; the others pass its
        whole pipeline.
        """
        model, known, older, code, space, tails, other = (self.tokenizer.model.tokenize, self.known, self.older, self.code, self.space,
                                                          self.tails, [])
        for part in parts:
            ids = older.get(part)
            if ids is not None:
                known[part] = ids
                continue
            found = WORD(part)
            if not found:
                other.append(part)
                continue
            lead, body, tail = found.groups()
            ids = None if lead else known.get(body) or older.get(body)
            if ids is None:
                mapped = body if body.isascii() else "".join([self.shown[x] for x in body.encode()])
                ids = array(code, [t.id for t in model(mapped if lead else space + mapped)]).tobytes()
                if not lead:
                    known[body] = ids
            if tail:
                if tail not in tails:
                    tails[tail] = self._whole(tail)
                ids += tails[tail]
            known[part] = self.line + ids if lead == "\n" else ids
        other = [p for p in other if (p[1:] if p[:1] in (" ", "\n") else p).split() == [p.lstrip(" \n")]]
        bare = [p[1:] if p[0] in " \n" else " " + p for p in other]
        for part, ids in zip(other, self._each(bare)):
            known[part] = self.line + ids if part[0] == "\n" else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Parts that hold other white space, or nothing, are never kept; their texts go whole."""
        out, parts, ends = [b""] * len(texts), [], []
        for text in texts:
            if text:
                own = text.replace("\n", " \n").split(" ")
                own[0] = " " + own[0]
                parts += own
            ends.append(len(parts))
        if 2 * len(self.known) > self.entries:
            self.older, self.known, self.tails = self.known, {}, {}
        ids = list(map(self.known.get, parts))
        new = [j for j, v in enumerate(ids) if v is None]
        fresh = {parts[j] for j in new}
        self._learn(fresh)
        odd = set()
        for j in new:
            ids[j] = self.known.get(parts[j])
            if ids[j] is None:
                odd.add(bisect_right(ends, j))
        begin = 0
        for i, end in enumerate(ends):
            if i in odd:
                out[i] = self._whole(texts[i])
            elif end > begin:
                out[i] = b"".join(ids[begin:end])
            begin = end
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


CACHES.append(encoder.cache_clear)


def frame(doc: int | None, ids: bytes, width: int) -> bytes:
    """A record without its last byte, which the text writer adds."""
    body = BODY.pack(width, doc is None, doc or 0) + ids
    length = struct.pack("<Q", len(body))
    return b"".join((length, struct.pack("<I", masked_crc(length)), body, struct.pack("<I", masked_crc(body))))


def write_records(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 0,
                  records_per_file: int = 5000, bytes_per_file: int = 1 << 30) -> None:
    """Encodes every text, appends end_id and writes the records below `path` in ascending id order.

    Null texts are encoded as empty ones and so hold end_id only. Null ids come first; rows of one id are
    ordered by their text's hash, then by the text. An empty table writes no record. A file holds at most
    `records_per_file` records, and fewer where the longest text could make them more than `bytes_per_file`:
    readers take files whole.
    """
    longest = docs.agg(F.max(F.octet_length(text))).first()[0] or 1
    records_per_file = max(1, min(records_per_file, bytes_per_file // (4 * longest + 64)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), text_key(F.col(text))[0])
    rows = rows.repartitionByRange("id", "k1").sortWithinPartitions("id", "k1", "text").select("id", "text")

    def run(batches):
        enc = encoder(tokenizer)
        last = np.array([end_id], enc.type).tobytes()
        for batch in slices(batches, 1, keep=True):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            frames = [frame(i, ids + last, enc.width) for i, ids in zip(batch.column(0).to_pylist(), enc.encode(texts))]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["value"])

    map_texts(rows, run, "value binary").select(F.col("value").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", records_per_file).text(path)


def parse_record(content: bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """(document id, ids, bytes of the record) of the record at an offset; raises where a checksum is wrong."""
    length, check = HEAD.unpack_from(content, at)
    if masked_crc(content[at:at + 8]) != check:
        raise ValueError(f"wrong checksum of the length at byte {at}")
    body = content[at + HEAD.size:at + HEAD.size + length]
    if len(body) != length or struct.pack("<I", masked_crc(body)) != content[at + HEAD.size + length:at + HEAD.size + length + 4]:
        raise ValueError(f"wrong checksum of the record at byte {at}")
    width, null, doc = BODY.unpack_from(body)
    return None if null else doc, np.frombuffer(body, f"<u{width}", offset=BODY.size), HEAD.size + length + 5


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def index_records(spark: SparkSession, path: str) -> DataFrame:
    """Reads the files back: file, offset, length, id, file_start (ids before it in the file), n_tokens, ids_crc32."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                at, ids_before, rows = 0, 0, []
                while at < len(content):
                    doc, ids, size = parse_record(content, at)
                    rows.append((name, at, size, doc, ids_before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at, ids_before = at + size, ids_before + len(ids)
                if rows:
                    names = ["file", "offset", "length", "id", "file_start", "n_tokens", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.string() if j == 0 else pa.int64()) for j, c in enumerate(zip(*rows))], names)

    files = _parts(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return map_texts(files, run, "file string, offset long, length long, id long, file_start long, n_tokens long, ids_crc32 long")


def write_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Writes the offset index as a table with `start`, the ids of all records before, and returns it."""
    rows = written(index_records(spark, path), f"{index}/records")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    files = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    placed = rows.join(files, "file").withColumn("start", F.col("before") + F.col("file_start")).drop("before", "file_start")
    return written(placed, f"{index}/index")


def shuffled_read(spark: SparkSession, path: str, index: DataFrame, seed: int) -> DataFrame:
    """(position, id, ids) of the indexed records in a seeded random order of positions, read by their offsets."""
    wanted = index.select("file", "offset", F.xxhash64(F.lit(seed), "file", "offset").alias("position")).groupBy("file").agg(
        F.collect_list(F.struct("offset", "position")).alias("wanted"))
    files = _parts(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(wanted, "file")

    def run(batches):
        for batch in batches:
            for content, places in zip(batch.column(0), batch.column(1)):
                content, rows = content.as_py(), []
                for place in places.as_py():
                    doc, ids, _ = parse_record(content, place["offset"])
                    rows.append((place["position"], doc, ids.astype(np.int64)))
                position, doc, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(position, pa.int64()), pa.array(doc, pa.int64()),
                                                  pa.array(ids, pa.list_(pa.int64()))], ["position", "id", "ids"])

    return map_texts(files.select("content", "wanted"), run, "position long, id long, ids array<long>")
