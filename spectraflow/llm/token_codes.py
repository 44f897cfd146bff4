"""Token ids in directly addressable code files.

A file holds the ids of a run of documents. Ids are cut into 8-bit chunks, low
chunk first: level 0 has a chunk of every id, level k those of ids that need
more than k chunks. Each level but the last has a bitmap that says which of its
ids go on, and a rank directory, the ones before each block of 512 bits. A
token's place in the next level is the rank of its bit, so any token is read
with a few byte reads, without decoding a block.

Layout, little-endian: ``DAC1``, level count (u32), level lengths (u64 each);
then for each level its chunks, and but for the last, its bitmap (whole 64-byte
blocks) and its directory (u64 per block).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraflow.llm.common import batch_of, filesystem, fresh_dir, materialise, write_bytes
from spectraflow.llm.encoding import encoder

MAGIC = b"DAC1"
BLOCK = 512


def encode_ids(ids: np.ndarray) -> list[bytes]:
    """The parts of a file."""
    rest = ids.astype("<u4")
    head, body, lengths = [MAGIC], [], []
    while True:
        lengths.append(len(rest))
        body.append((rest & 0xFF).astype(np.uint8).tobytes())
        more = rest > 0xFF
        if not more.any():
            break
        bits = np.packbits(more, bitorder="little").tobytes()
        bits += bytes(-len(bits) % (BLOCK // 8))
        ones = np.bitwise_count(np.frombuffer(bits, "<u8").reshape(-1, BLOCK // 64)).sum(axis=1, dtype=np.uint64)
        body += [bits, np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones)[:-1]]).astype("<u8").tobytes()]
        rest = rest[more] >> 8
    head.append(struct.pack(f"<I{len(lengths)}Q", len(lengths), *lengths))
    return head + body


class Reader:
    """Random access to the tokens of one file through range reads."""

    def __init__(self, uri: str) -> None:
        store, path = filesystem(uri)
        self.file = store.open_input_file(path)
        head = self.file.read_at(8, 0)
        if head[:4] != MAGIC:
            raise ValueError(f"not a token code file: {uri}")
        (n,) = struct.unpack("<I", head[4:])
        self.lengths = struct.unpack(f"<{n}Q", self.file.read_at(8 * n, 8))
        self.levels, at = [], 8 + 8 * n
        for k, length in enumerate(self.lengths):
            blocks = -(-length // BLOCK) if k + 1 < n else 0
            self.levels.append((at, at + length, at + length + blocks * BLOCK // 8))
            at += length + blocks * (BLOCK // 8 + 8)

    def close(self) -> None:
        self.file.close()

    def rank(self, level: int, i: int) -> int:
        """Ones before bit ``i``: one directory entry, and what precedes in the bit's block."""
        _, bits, directory = self.levels[level]
        block, inside = divmod(i, BLOCK)
        if inside == 0 and i == self.lengths[level]:  # past the last block
            return self.lengths[level + 1]
        (before,) = struct.unpack("<Q", self.file.read_at(8, directory + 8 * block))
        own = np.unpackbits(np.frombuffer(self.file.read_at(BLOCK // 8, bits + block * (BLOCK // 8)), np.uint8), bitorder="little")
        return before + int(own[:inside].sum())

    def slice(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """Ids (at level 0) of positions start to stop."""
        chunks, bits, _ = self.levels[level]
        out = np.frombuffer(self.file.read_at(stop - start, chunks + start), np.uint8).astype("<u4")
        if level + 1 < len(self.levels) and stop > start:
            first = start // 8
            raw = np.frombuffer(self.file.read_at(-(-stop // 8) - first, bits + first), np.uint8)
            more = np.unpackbits(raw, bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            if n := int(more.sum()):
                at = self.rank(level, start)
                out[more] |= self.slice(at, at + n, level + 1) << 8
        return out

    def token(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


def write_codes(documents: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, file_tokens: int = 8_000_000) -> DataFrame:
    """Write all documents' ids, each with ``end_id``, in ascending doc_id order; return the index, materialised.

    Index: doc_id, start (ids of all documents before), n_tokens, file,
    file_start. A null text is an empty one; null doc_ids come first; equal
    doc_ids stand next to each other; other columns aren't read. Files get
    names of their own, so a repeated task leaves at worst a file that no index
    row names.
    """
    ties = F.xxhash64("text")
    ordered = documents.select(F.col("doc_id").cast("long"), "text")
    ordered = ordered.repartitionByRange(F.col("doc_id"), ties).sortWithinPartitions("doc_id", ties)
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = "doc_id long, n_tokens long, file string, file_start long, part int, part_start long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, before = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        held, tokens, rows = [], 0, []

        def flush() -> pa.RecordBatch:
            uri = f"{folder}/part-{part:06d}-{before:014d}-{uuid.uuid4().hex}.dac"
            write_bytes(uri, encode_ids(np.frombuffer(b"".join(held), "<u4")))
            docs, counts, starts = map(list, zip(*rows))
            long, n = pa.int64(), len(rows)
            columns = [(docs, long), (counts, long), ([uri] * n, pa.string()), (starts, long), ([part] * n, pa.int32()), ([before + s for s in starts], long)]
            return batch_of(["doc_id", "n_tokens", "file", "file_start", "part", "part_start"], columns)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = own.encode(text) + end
                held.append(ids)
                rows.append((doc, len(ids) // 4, tokens))
                tokens += len(ids) // 4
                if tokens >= file_tokens:
                    yield flush()
                    before, held, tokens, rows = before + tokens, [], 0, []
        if rows:
            yield flush()

    index = materialise(ordered.mapInArrow(run, schema), "token-index")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(parts, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "file", "file_start")


def read_digests(index: DataFrame) -> DataFrame:
    """Read every document's ids back from the files; add their count as ``read_tokens`` and ``ids_crc32``."""
    schema = index.select("*", F.lit(0).cast("long").alias("read_tokens"), F.lit(0).cast("long").alias("ids_crc32")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, reader = None, None
        for batch in batches:
            counts, sums = [], []
            for file, start, n in zip(*(batch.column(c).to_pylist() for c in ("file", "file_start", "n_tokens"))):
                if file != uri:
                    if reader:
                        reader.close()
                    uri, reader = file, Reader(file)
                ids = reader.slice(start, start + n)
                counts.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield batch_of([*batch.schema.names, "read_tokens", "ids_crc32"], [*batch.columns, (counts, pa.int64()), (sums, pa.int64())])
        if reader:
            reader.close()

    return index.mapInArrow(run, schema)


def encode_documents(documents: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 2) -> DataFrame:
    """Write, then read back: doc_id, start, n_tokens, ids_crc32, file, file_start."""
    folder = folder or fresh_dir(documents.sparkSession, "token-codes")
    back = read_digests(write_codes(documents, tokenizer_path, folder, end_id))
    return back.select("doc_id", "start", F.col("read_tokens").alias("n_tokens"), "ids_crc32", "file", "file_start")
