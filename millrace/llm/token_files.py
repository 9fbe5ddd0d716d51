"""Operator 5: token ids in seekable compressed files.

A file is a run of independent zstandard frames and ends with the seek table of the
public seekable format: a skippable frame with each frame's compressed size, plain
size and checksum (low 32 bits of XXH64), the number of frames, a flag byte and the
magic number. Any zstandard reader can decompress the file.

- A data frame holds a run of documents: their number (u32), null flags of the keys
  (u8 each), keys (i64), id counts (u32) and ids (u16 or u32, little-endian).
- The last frame is the directory: magic and id width (u32 each), then for each data
  frame its number of documents and ids (u64 each) and its least and greatest key.

A reader takes the tail, the directory and the frames it was asked for; it checks
their checksums and decompresses nothing else. Keys ascend over a file's frames and
over the files of a folder.

The files go through Spark's own writer (one row a file), so they reach any store and
a lost task leaves nothing behind. The writer puts a separator after a row: it is the
format's magic number, the last four bytes of a file.

Defined cases: a null or empty text has the end id only; null keys come first; rows
that share a key stand side by side, each with its own ids; an empty table gives a
folder without files, which reads as an empty table; other columns are not stored.
"""

from __future__ import annotations

import struct
from collections.abc import Collection

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import blocks, named, small_batches
from .pieces import pack, pieces

#: Fixed values of the seekable format: skippable frame, end of seek table, "has checksums".
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
DIRECTORY = 0x4D52544B
#: Plain bytes of a frame and compressed bytes of a file, after which the next begins.
FRAME_BYTES, FILE_BYTES = 256 << 10, 32 << 20


class Writer:
    """Collects documents into frames and frames into one file's bytes."""

    def __init__(self, width: int):
        self.width, self.zip = width, zstandard.ZstdCompressor(level=3)
        self.data, self.seek, self.frames = [], [], []
        self.keys, self.ids, self.held, self.size = [], [], 0, 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= FRAME_BYTES:
            self.flush()

    def _frame(self, plain: bytes) -> None:
        packed = self.zip.compress(plain)
        self.data.append(packed)
        self.size += len(packed)
        self.seek.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def flush(self) -> None:
        if not self.keys:
            return
        counts = np.array([len(x) // 4 for x in self.ids], "<u4")
        ids = np.frombuffer(b"".join(self.ids), "<u4").astype(f"<u{self.width}")
        known = [k for k in self.keys if k is not None]
        keys = np.array([k or 0 for k in self.keys], "<i8")
        nulls = np.array([k is None for k in self.keys], "u1")
        self._frame(struct.pack("<I", len(keys)) + nulls.tobytes() + keys.tobytes() + counts.tobytes() + ids.tobytes())
        least, most = (min(known), max(known)) if known else (1, 0)
        self.frames.append(struct.pack("<QQqq", len(keys), int(counts.sum()), least, most))
        self.keys, self.ids, self.held = [], [], 0

    def finish(self) -> bytes:
        """The file's bytes without the magic number at its end."""
        self.flush()
        self._frame(struct.pack("<II", DIRECTORY, self.width) + b"".join(self.frames))
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IB", len(self.seek), CHECKSUMS)
        return b"".join(self.data) + struct.pack("<II", SKIPPABLE, len(table) + 4) + table


class Reader:
    """Random access to the frames of one file."""

    def __init__(self, content: bytes):
        n, flags, magic = struct.unpack_from("<IBI", content, len(content) - 9)
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums")
        self.content, self.zip = content, zstandard.ZstdDecompressor()
        table = np.frombuffer(content, "<u4", 3 * n, len(content) - 9 - 12 * n).reshape(n, 3)
        self.table, self.at = table, np.concatenate([[0], np.cumsum(table[:, 0], dtype="i8")])
        directory = self.frame(n - 1)
        magic, self.width = struct.unpack_from("<II", directory)
        if magic != DIRECTORY:
            raise ValueError("no directory")
        self.frames = [struct.unpack_from("<QQqq", directory, 8 + 32 * k) for k in range(n - 1)]
        self.tokens = sum(f[1] for f in self.frames)

    def frame(self, k: int) -> bytes:
        plain = self.zip.decompress(self.content[self.at[k] : self.at[k + 1]], max_output_size=int(self.table[k, 1]))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} fails its checksum")
        return plain

    def documents(self, wanted: Collection[int] | None = None):
        """(key, ids before it in the file, packed ids); of the wanted keys only, if given."""
        before = 0
        for k, (_, tokens, least, most) in enumerate(self.frames):
            if wanted is None or any(least <= w <= most for w in wanted):
                plain = self.frame(k)
                n = struct.unpack_from("<I", plain)[0]
                nulls = np.frombuffer(plain, "u1", n, 4)
                keys = np.frombuffer(plain, "<i8", n, 4 + n).tolist()
                counts = np.frombuffer(plain, "<u4", n, 4 + 9 * n)
                ids = np.frombuffer(plain, f"<u{self.width}", -1, 4 + 13 * n).astype("<u4")
                ends = np.cumsum(counts, dtype="i8").tolist()
                for null, key, count, end in zip(nulls, keys, counts.tolist(), ends, strict=True):
                    if wanted is None or (not null and key in wanted):
                        yield None if null else key, before + end - count, ids[end - count : end].tobytes()
            before += tokens


def write_tokens(df: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id``, and write ``folder`` in ascending key order.

    Rows are dealt by ranges of the key, split further by the text's hash, so that rows
    of one key need not meet in one task.
    """

    def run(batches):
        vocabulary, writer, end = pieces(tokenizer), None, pack([end_id])
        width = 2 if max(vocabulary.library.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        for batch in batches:
            for block in blocks(batch, 1):
                split = [vocabulary.split(t) for t in block.column(1).to_pylist()]
                known = vocabulary.learn(set().union(*split))
                for one, words in zip(block.column(0).to_pylist(), split, strict=True):
                    writer = writer or Writer(width)
                    writer.add(one, b"".join(map(known.__getitem__, words)) + end)
                    if writer.size >= FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([writer.finish()], pa.binary())], ["content"])
                        writer = None
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([writer.finish()], pa.binary())], ["content"])

    order = ["key", F.xxhash64("text")]
    rows = df.select(named(key).cast("long").alias("key"), named(text).cast("string").alias("text"))
    small_batches(rows)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    magic = struct.pack("<I", SEEKABLE).decode("latin-1")
    files = dealt.mapInArrow(run, "content binary").select(F.col("content").cast("string"))
    files.write.option("lineSep", magic).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def read_tokens(spark: SparkSession, folder: str, wanted: Collection[int] | None = None) -> DataFrame:
    """key, start (ids of all documents before it in the folder), ids (packed).

    ``wanted`` is a list of keys small enough to travel with the tasks; only the frames
    that may hold them are decompressed.
    """

    def count(batches):
        for batch in batches:
            totals = [Reader(x).tokens for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64())], ["path", "tokens"])

    # One row a file: the task number and the number of the task's file give the order.
    part = [F.regexp_extract("path", p, 1).cast("long") for p in (r"part-(\d+)-[^/]*$", r"-c(\d+)[^/]*$")]
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    totals = _files(spark, folder).mapInArrow(count, "path string, tokens long")
    based = cut_lineage(totals.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")))

    def unpack(batches):
        for batch in batches:
            for base, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for some in _runs(Reader(content.as_py()).documents(wanted)):
                    keys, starts, ids = zip(*some, strict=True)
                    columns = [pa.array(keys, pa.int64()), pa.array([base + s for s in starts], pa.int64()), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "start", "ids"])

    return _files(spark, folder).join(based, "path").select("base", "content").mapInArrow(unpack, "key long, start long, ids binary")


def _runs(rows, most: int = 2000):
    some = []
    for row in rows:
        some.append(row)
        if len(some) == most:
            yield some
            some = []
    if some:
        yield some
