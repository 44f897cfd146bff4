"""Media columns: content-addressed payloads in tar shards.

A payload is stored as a lossless 8-bit grey PNG, 192 samples wide, in a member
named by the payload's SHA-256. Rows carry digest, shard, offset and length, so
that a payload's header, or all of it, is one range read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraflow.llm.common import batch_of, filesystem, fresh_dir, materialise, write_bytes

WIDTH = 192
HEADER_BYTES = 33  # signature and IHDR
#: Digests that a task remembers, some 60 MB.
REMEMBERED = 200_000
#: Tables of hex digests shrink by half under an entropy coder.
PACKED = {"compression": "zstd"}
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
STORED = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes padded with blanks to a positive multiple of 192."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes, level: int = 6) -> bytes:
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with its filter, 0
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth, from the first bytes only."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, body = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only filter 0 is written here")
    return rows[:, 1:].tobytes()


def store(documents: DataFrame, folder: str, shard_bytes: int = 32 << 20) -> DataFrame:
    """Write the payloads of all texts; one row per input row (STORED), materialised.

    A task stores a digest once while it remembers it (``REMEMBERED`` digests,
    then it starts anew), in shards of about ``shard_bytes``; a shard
    holds a payload larger than that alone. Of copies stored more than once
    every row names the same one, the first by shard and offset. A null text is
    an empty one, stored as 192 blanks. Shard names are new for every attempt.
    Repeated rows give a row each; an empty table gives an empty one.
    """
    names = [c.split()[0] for c in STORED.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed: dict[bytes, tuple[str, int, int]] = {}
        parts: list[bytes] = []
        used, shard = 0, f"{folder}/{uuid.uuid4().hex}.tar"
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                n, samples = payload(text)
                digest = hashlib.sha256(samples)
                place = placed.get(digest.digest())
                if place is None:
                    media = to_png(samples)
                    info = tarfile.TarInfo(digest.hexdigest() + ".png")
                    info.size = len(media)
                    parts += [info.tobuf(tarfile.USTAR_FORMAT), media, bytes(-len(media) % 512)]
                    if len(placed) >= REMEMBERED:
                        placed.clear()
                    place = placed[digest.digest()] = (shard, used + 512, len(media))
                    used += sum(map(len, parts[-3:]))
                rows.append((n, digest.hexdigest(), *place))
                if used >= shard_bytes:
                    write_bytes(shard, [*parts, bytes(1024)])
                    parts, used, shard = [], 0, f"{folder}/{uuid.uuid4().hex}.tar"
            yield batch_of(names, [batch.column("doc_id"), *((list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds))])
        if parts:
            write_bytes(shard, [*parts, bytes(1024)])

    return materialise(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORED), "media-rows", **PACKED)


def catalogue(stored: DataFrame) -> DataFrame:
    """One place per digest."""
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    return stored.groupBy("digest").agg(place).select("digest", "place.*")


def _ranges(frame: pd.DataFrame, read) -> list:
    """``read(file, offset, length)`` for every row; a file stays open while its rows follow each other."""
    out, uri, file = [], None, None
    for shard, offset, length in zip(frame["shard"], frame["offset"], frame["length"]):
        if shard != uri:
            if file:
                file.close()
            fs, path = filesystem(shard)
            uri, file = shard, fs.open_input_file(path)
        out.append(read(file, int(offset), int(length)))
    if file:
        file.close()
    return out


def fill_metadata(places: DataFrame) -> DataFrame:
    """Add width, height and bit_depth to rows with shard, offset and length, reading 33 bytes each."""
    schema = places.select("*", *[F.lit(0).alias(c) for c in ("width", "height", "bit_depth")]).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = _ranges(batch, lambda f, at, n: png_header(f.read_at(HEADER_BYTES, at)))
            yield batch.assign(**{c: np.array([h[i] for h in heads], dtype="int32") for i, c in enumerate(("width", "height", "bit_depth"))})

    return places.mapInPandas(run, schema)


def features(samples: bytes) -> str:
    """Exact moments and the 16-level histogram's largest bin."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    levels = np.bincount(x >> 4, minlength=16)
    return f"n={len(x)};sum={x.sum()};squares={(x * x).sum()};steps={np.abs(np.diff(x)).sum()};mode={levels.argmax()}:{levels.max()}"


def read_features(places: DataFrame) -> DataFrame:
    """Read each payload back whole; add payload_bytes, payload_sha256, tail_crc32, media_sha256 and feature."""
    extra = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"
    kinds = [c.split() for c in extra.split(", ")]
    schema = places.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds]).schema

    def facts(media: bytes) -> tuple:
        samples = from_png(media)
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), hashlib.sha256(media).hexdigest(), features(samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _ranges(batch, lambda f, at, n: facts(f.read_at(n, at)))
            yield batch.assign(**{c: [x[i] for x in found] for i, (c, _) in enumerate(kinds)})

    return places.mapInPandas(run, schema)


def media_columns(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """Store, then read back by digest: one row per input row with all the columns above."""
    stored = store(documents, folder or fresh_dir(documents.sparkSession, "media"))
    places = catalogue(stored).repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    read = materialise(read_features(fill_metadata(places)), "media-features", **PACKED)
    return stored.drop("shard", "offset", "length").join(read, "digest")
