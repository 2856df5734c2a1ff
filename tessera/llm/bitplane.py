"""Token ids in files of bit- or byte-plane shuffled blocks.

File format (little endian). ``TBPS1`` + mode byte (``B`` byte planes, ``b`` bit
planes); then blocks; then a footer; then the footer's length (8 bytes) and ``TBPS1``.
A block holds up to ``block_ids`` unsigned 32-bit ids: their bytes (or bits) are
transposed into planes, and each plane is compressed with zstandard; a plane of zeros
has length 0. The footer is zstandard-compressed JSON: the chunk index (per block:
offset, first id, ids, plane lengths, crc32 of the ids) and the extents of the document
index (blocks of doc_id, presence flag and id count).

Writing keeps ascending doc_id order over all files: range partitioning puts each id
range into one file. A task writes under a name of its own and returns it; only the
names in the written manifest count, so repeated or lost tasks leave no wrong file.

Defined results for odd input: null texts are empty (one end id); null doc_ids come
first; repeated rows are written as often as they occur, ordered by text; an empty
table gives no files; further columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shared, tokens
from tessera.session import table

MAGIC = b"TBPS1"
BLOCK_IDS = 1 << 16


def file_system(uri: str):
    """pyarrow file system and path of a folder's URI, or of a local path."""
    from pyarrow import fs

    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


def to_planes(ids: np.ndarray, bits: bool) -> list[np.ndarray]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    return list(np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1))


def from_planes(planes: list[np.ndarray | None], n: int, bits: bool) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if not bits:
        for k, p in enumerate(planes):
            if p is not None:
                out[:, k] = p
    else:
        wide = np.zeros((32, n), np.uint8)
        for k, p in enumerate(planes):
            if p is not None:
                wide[k] = np.unpackbits(p)[:n]
        out = np.packbits(wide.T, axis=1, bitorder="little")
    return np.ascontiguousarray(out).view("<u4").reshape(-1)


class ShardWriter:
    """Streams documents into one file; holds one block and the document index."""

    def __init__(self, stream, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = 1):
        import zstandard

        self.out, self.size, self.bits = stream, block_ids, bits
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at = self._put(MAGIC + (b"b" if bits else b"B"), 0)
        self.waiting: list[np.ndarray] = []
        self.held = self.n_ids = self.n_docs = 0
        self.blocks: list[list] = []
        self.doc_ids: list[np.ndarray] = []
        self.doc_index: list[list] = []

    def _put(self, data: bytes, at: int) -> int:
        self.out.write(data)
        return at + len(data)

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(p.tobytes()) if p.any() else b"" for p in to_planes(ids, self.bits)]
        self.blocks.append([self.at, self.n_ids, len(ids), [len(p) for p in packed], zlib.crc32(ids.astype("<u4").tobytes())])
        self.at = self._put(b"".join(packed), self.at)
        self.n_ids += len(ids)

    def add(self, doc_ids: np.ndarray, present: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        index = np.concatenate([doc_ids.astype("<i8").view(np.uint8), present.astype(np.uint8), lens.astype("<i8").view(np.uint8)])
        data = self.zip.compress(index.tobytes())
        self.doc_index.append([self.at, len(data), len(lens)])
        self.at = self._put(data, self.at)
        self.n_docs += len(lens)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.size:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.size * self.size
            for i in range(0, whole, self.size):
                self._block(ids[i : i + self.size])
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
            self.waiting, self.held = [], 0
        footer = self.zip.compress(json.dumps({"n_ids": self.n_ids, "n_docs": self.n_docs, "blocks": self.blocks, "docs": self.doc_index}).encode())
        self._put(footer + struct.pack("<Q", len(footer)) + MAGIC, self.at)


class ShardReader:
    """Random access to one file through its chunk index."""

    def __init__(self, stream):
        import zstandard

        self.file, self.unzip = stream, zstandard.ZstdDecompressor()
        stream.seek(0)
        head = stream.read(len(MAGIC) + 1)
        size = stream.seek(0, 2) or stream.tell()
        stream.seek(size - 8 - len(MAGIC))
        tail = stream.read(8 + len(MAGIC))
        if head[:-1] != MAGIC or tail[8:] != MAGIC:
            raise ValueError("not a plane-shuffled token file")
        self.bits = head[-1:] == b"b"
        n = struct.unpack("<Q", tail[:8])[0]
        stream.seek(size - 8 - len(MAGIC) - n)
        self.footer = json.loads(self.unzip.decompress(stream.read(n)))

    def block(self, k: int) -> np.ndarray:
        at, _, n, sizes, crc = self.footer["blocks"][k]
        self.file.seek(at)
        raw, planes, begin = self.file.read(sum(sizes)), [], 0
        for s in sizes:
            planes.append(np.frombuffer(self.unzip.decompress(raw[begin : begin + s]), np.uint8) if s else None)
            begin += s
        ids = from_planes(planes, n, self.bits)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids [begin, end) of this file; only the blocks they lie in are read."""
        firsts = [b[1] for b in self.footer["blocks"]]
        parts = []
        for k in range(max(0, int(np.searchsorted(firsts, begin, "right")) - 1), len(firsts)):
            if firsts[k] >= end:
                break
            parts.append(self.block(k)[max(0, begin - firsts[k]) : end - firsts[k]])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def documents(self):
        """(doc_ids, present, lens) by index block."""
        for at, size, n in self.footer["docs"]:
            self.file.seek(at)
            raw = np.frombuffer(self.unzip.decompress(self.file.read(size)), np.uint8)
            yield raw[: 8 * n].view("<i8"), raw[8 * n : 9 * n].astype(bool), raw[9 * n :].copy().view("<i8")


MANIFEST = "part int, path string, n_docs long, n_ids long"


def write_shards(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, bits: bool = False, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write one file per range of doc_id below
    ``folder``; returns the stored manifest, one row per file."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        from pyspark import TaskContext

        enc, writer = tokens.encoder(vocabulary), None
        part = TaskContext.get().partitionId()
        fs, base = file_system(folder)
        path = f"{base}/part-{part:05d}-{uuid.uuid4().hex}.tbps"
        for batch in batches:
            for some in shared.text_slices(batch, "text", 8 << 20):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    stream = fs.open_output_stream(path)
                    writer = ShardWriter(stream, block_ids, bits)
                ids, lens = tokens.with_end(*enc(some.column("text")), end_id)
                doc_ids = some.column("doc_id")
                present = doc_ids.is_valid().to_numpy(zero_copy_only=False)
                writer.add(doc_ids.fill_null(0).to_numpy(zero_copy_only=False), present, ids, lens)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "path": path, "n_docs": writer.n_docs, "n_ids": writer.n_ids}],
                pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text"))
    # The text's hash splits a doc_id that repeats very often over several files.
    ranged = rows.withColumn("k", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "k").sortWithinPartitions("doc_id", "k", "text")
    return shared.stored(ranged.select("doc_id", "text").mapInArrow(write, MANIFEST), "token-manifest")


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files. The
    manifest has one row per file, so the driver adds up where each file starts."""
    spark = manifest.sparkSession
    at, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        rows.append((r.path, at))
        at += r.n_ids

    def read(batches):
        fs, _ = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as f:
                    reader = ShardReader(f)
                    k, held, done = 0, np.zeros(0, np.uint32), 0
                    for doc_ids, present, lens in reader.documents():
                        need, parts = int(lens.sum()), [held]
                        while sum(map(len, parts)) < need:
                            parts.append(reader.block(k))
                            k += 1
                        ids = np.concatenate(parts)
                        held, raw = ids[need:], ids[:need].tobytes()
                        ends = np.cumsum(lens)
                        crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(doc_ids, mask=~present),
                                pa.array(row["base"] + done + ends - lens),
                                pa.array(lens),
                                pa.array(crcs, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        done += need

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(rows, "path string, base long").repartition(len(rows))
    return files.mapInArrow(read, schema)


def op1_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shared.prepare(spark)
    folder = shared.new_folder(spark, "token-files")
    manifest = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_documents(manifest, folder)
