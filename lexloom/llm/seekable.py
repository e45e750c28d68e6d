"""Token-id files: one zstandard frame a document, checksums, a seek table.

A file is a run of independent zstandard frames, each holding one document's
ids as little-endian uint32, then a skippable frame with the documents' keys as
int64 and one bit each for a null key, then the seek table of the public zstandard seekable format: for each
frame its compressed and plain size and the low half of the XXH64 of its plain
bytes. A reader fetches the table from the end of the file and then only the
frames it is asked for.

Documents are ordered by key over the whole table (ties by text), one file per
range of keys. Nulls: a null text counts as empty, a null key comes first. Repeated
rows are documents of their own, one after another. A very long text is one frame and
costs memory in proportion in one task. An empty table writes no file. Other columns
are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from . import common, tokens

# Fixed values of the zstandard seekable format.
SKIPPABLE_KEYS = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_FOOTER = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

LEVEL = 1


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


class Writer:
    def __init__(self, path: str, level: int = LEVEL):
        import zstandard

        system, inner = _open(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(inner, compression=None)
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.entries: list[bytes] = []
        self.keys: list[int | None] = []

    def add(self, key: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.compress(ids)
        self.out.write(frame)
        self.entries.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.keys.append(key)

    def close(self) -> None:
        missing = bytearray(-(-len(self.keys) // 8))
        for k, key in enumerate(self.keys):
            missing[k // 8] |= (key is None) << (k % 8)
        keys = struct.pack(f"<{len(self.keys)}q", *(k or 0 for k in self.keys)) + bytes(missing)
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE_KEYS, len(keys)) + keys)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, path: str):
        import zstandard

        system, inner = _open(path)
        self.file = system.open_input_file(inner)
        self.decompress = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER or not flags & WITH_CHECKSUMS:
            raise ValueError(f"no seek table with checksums at the end of {path}")
        start = size - 9 - 12 * count - 8
        if struct.unpack("<II", self._at(start, 8)) != (SKIPPABLE_SEEK, 12 * count + 9):
            raise ValueError(f"bad seek table in {path}")
        self.entries = list(struct.iter_unpack("<III", self._at(start + 8, 12 * count)))
        bits = -(-count // 8)
        keys, missing = self._at(start - bits - 8 * count, 8 * count), self._at(start - bits, bits)
        each = struct.unpack(f"<{count}q", keys)
        self.keys = [None if missing[k // 8] >> (k % 8) & 1 else key for k, key in enumerate(each)]
        self.offsets, at = [], 0
        for packed, _, _ in self.entries:
            self.offsets.append(at)
            at += packed

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.entries)

    def ids(self, k: int) -> bytes:
        """The k-th document's id bytes; reads and unpacks that frame alone."""
        import xxhash

        packed, plain, check = self.entries[k]
        data = self.decompress(self._at(self.offsets[k], packed), max_output_size=plain)
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        return data

    def close(self) -> None:
        self.file.close()


def write_ids(docs: DataFrame, folder: str, vocab_path: str, end_id: int, files: int) -> list[tuple[str, int, int]]:
    """Write doc_id and text as id files; returns (path, documents, ids) in key order.

    An attempt writes under a name of its own and only a finished task's names
    are returned, so a lost executor or a repeated task leaves no wrong file.
    """
    end = struct.pack("<I", end_id)

    def write(batches):
        from pyspark import TaskContext

        encoder, writer, count, total = tokens.encoder(vocab_path), None, 0, 0
        part = TaskContext.get().partitionId()
        path = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.zst"
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), tokens.GROUP):
                for key, ids in zip(keys[at:], encoder.encode(texts[at : at + tokens.GROUP])):
                    writer = writer or Writer(path)
                    writer.add(key, ids + end)
                    count, total = count + 1, total + len(ids) // 4 + 1
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "docs": [count], "ids": [total]})

    ordered = (
        common.small_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange(files, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    written = common.cut(ordered.mapInArrow(write, "part long, path string, docs long, ids long"), "manifest")
    manifest = [(r.path, r.docs, r.ids) for r in sorted(written.collect(), key=lambda r: r.part)]
    common.forget(written)
    return manifest


def read_ids(spark, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """One row a document: doc_id, start, n_tokens, ids_crc32, all from the files."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(path)
                for low in range(0, len(reader), 4096):
                    keys, starts, sizes, sums = reader.keys[low : low + 4096], [], [], []
                    for k in range(low, low + len(keys)):
                        data = reader.ids(k)
                        starts.append(base)
                        sizes.append(len(data) // 4)
                        sums.append(zlib.crc32(data))
                        base += sizes[-1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in (keys, starts, sizes, sums)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                reader.close()

    rows, base = [], 0
    for path, _, ids in manifest:
        rows.append((path, base))
        base += ids
    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
