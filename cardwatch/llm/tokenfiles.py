"""Operator 6: token ids in files of independent zstandard frames with a trailing seek table.

A file holds one frame per document, in ascending order of ids, so a reader decompresses the documents it wants and nothing else.
Behind the frames come two skippable frames, which plain zstandard readers ignore: the ids of the documents, and the seek
table of the public seekable format (compressed size, decompressed size and checksum of every frame). Token ids are
16-bit where the vocabulary allows it, else 32-bit, little-endian.

Files are written by the tasks of a range-sorted table and named by task attempt; the table of files that Spark commits names the
attempt that counts, so a task that runs again after a lost executor leaves at most an unused file.

Ids are gathered from a dictionary of the pieces between white space (``pieces``); what a worker remembers is bounded.

Defined cases: null text is empty and holds the end id alone; null ids come first, rows that repeat an id follow each other ordered by text;
an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from cardwatch.llm.pieces import PieceEncoder, slices
from cardwatch.llm.text import table
from cardwatch.session import shared_folder, stage

END_ID = 2
BLOCK = 16 << 20  # bytes of a file that is read whole
FILE_BYTES = 256 << 20  # of text
PIECE = 4 << 20  # bytes of text at a time

#: Fixed values of the zstandard seekable format and of skippable frames.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

MANIFEST = "part int, path string, docs long, ids long"


class Encoder:
    """Token ids of texts in the width of the file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.pieces = PieceEncoder(tokenizer, path)

    def encode(self, texts: pa.Array) -> list[bytes]:
        ids, offsets = self.pieces.encode(texts)
        data, places = ids.astype(self.dtype).tobytes(), (offsets * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Writer:
    """One file of frames."""

    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.compress = zstandard.ZstdCompressor(level=3).compress
        self.doc_ids: list[int | None] = []
        self.entries = bytearray()
        self.ids = 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        frame = self.compress(data)
        self.stream.write(frame)
        self.entries += struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF)
        self.doc_ids.append(doc_id)
        self.ids += len(data) // self.width

    def close(self) -> None:
        values = np.array([0 if x is None else x for x in self.doc_ids], dtype="<i8").tobytes()
        missing = np.array([x is None for x in self.doc_ids], dtype="u1").tobytes()
        index = bytes([self.width]) + self.compress(values + missing)
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        footer = struct.pack("<IBI", len(self.doc_ids), HAS_CHECKSUMS, SEEK_MAGIC)
        seek = bytes(self.entries) + footer
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
        self.stream.close()


class Reader:
    """Random access to a file: ``doc_ids`` in file order, and the ids of the n-th document."""

    def __init__(self, path: str):
        store, inner = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(inner)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError(f"no seek table with checksums in {path}")
        table = size - 9 - 12 * frames
        self.entries = np.frombuffer(self._at(table, 12 * frames), dtype="<u4").reshape(-1, 3)
        self.places = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        kind, length = struct.unpack("<II", self._at(int(self.places[-1]), 8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError(f"no index of documents in {path}")
        index = self._at(int(self.places[-1]) + 8, length)
        self.dtype = np.dtype(f"<u{index[0]}")
        plain = zstandard.ZstdDecompressor().decompress(index[1:])
        missing = np.frombuffer(plain, dtype="u1", offset=8 * frames)
        self.doc_ids = [None if m else int(x) for x, m in zip(np.frombuffer(plain, dtype="<i8", count=frames), missing, strict=True)]
        self.decompress = zstandard.ZstdDecompressor().decompress

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def ids(self, n: int) -> np.ndarray:
        return self._plain(n, self._at(int(self.places[n]), int(self.entries[n, 0])))

    def _plain(self, n: int, frame) -> np.ndarray:
        plain, checksum = int(self.entries[n, 1]), int(self.entries[n, 2])
        data = self.decompress(frame, max_output_size=plain)
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {n} is damaged")
        return np.frombuffer(data, dtype=self.dtype)

    def every(self) -> Iterator[np.ndarray]:
        """Ids of all documents in file order; the file is read in blocks instead of frame by frame."""
        n = 0
        while n < len(self.entries):
            last = max(n + 1, int(np.searchsorted(self.places, self.places[n] + BLOCK, side="right")) - 1)
            block = memoryview(self._at(int(self.places[n]), int(self.places[last] - self.places[n])))
            for k in range(n, last):
                at = int(self.places[k] - self.places[n])
                yield self._plain(k, block[at : at + int(self.entries[k, 0])])
            n = last

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of the documents with this id; only their frames are read."""
        return [self.ids(n) for n, x in enumerate(self.doc_ids) if x == doc_id]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write docs (doc_id, text) below folder; returns the table of files (MANIFEST, parts ascend with doc_id)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]  # rows of one id can lie in several files

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tokens, writer = TaskContext.get(), encoder(tokenizer), None
        end = np.array([end_id], dtype=tokens.dtype).tobytes()
        path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.tokens.zst"
        for batch in batches:
            for a, b in slices(batch.column("text"), PIECE):
                part = batch.slice(a, b - a)
                if writer is None:
                    store, inner = fs.FileSystem.from_uri(path)
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    writer = Writer(store.open_output_stream(inner, compression=None), tokens.dtype.itemsize)
                for doc_id, data in zip(part.column("doc_id").to_pylist(), tokens.encode(part.column("text")), strict=True):
                    writer.add(doc_id, data + end)
        if writer is not None:
            writer.close()
            row = {"part": [task.partitionId()], "path": [path], "docs": [len(writer.doc_ids)], "ids": [writer.ids]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    ordered = docs.select("doc_id", "text").repartitionByRange(parts, *by).sortWithinPartitions(*by, "text")
    return stage(ordered.mapInArrow(write, MANIFEST), "token-files")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = Reader(path)
                lengths, sums = [], []
                for ids in reader.every():
                    lengths.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                starts = start + np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.doc_ids, pa.int64()), pa.array(starts), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.select("path", "start").repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json")))
