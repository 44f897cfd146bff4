"""Packing of documents into fixed-length sequences.

Documents are encoded and cut where they lie; only lengths travel. Pieces that
fill a sequence stand alone. The others are dealt at random into groups of
bounded size; in each, best fit makes bins and a local search then empties the
least filled ones by moves and exchanges that increase the sum of squared
fills.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraflow.llm.common import batch_of, materialise, slices_of
from spectraflow.llm.encoding import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def cut(documents: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, position: str | None = None) -> DataFrame:
    """Encode each text, append ``end_id`` and cut what is longer than ``capacity``; the first piece takes the remainder.

    A null or empty text gives one piece with the end id. Repeated rows give
    their pieces each; an empty table gives an empty one. ``with_ids`` adds the
    ids themselves as ``ids`` array<int>. ``position`` names a long column that
    every piece gets as well. Other columns aren't read.
    """
    schema = PIECES + (", position long" if position else "") + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = encoder(tokenizer_path), 0
        for batch in (part for whole in batches for part in slices_of(whole)):
            memo: dict[str | None, bytes] = {}  # copies in a slice are encoded once
            row, piece, start, length, crc, parts = [], [], [], [], [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                ids = memo.get(text)
                if ids is None:
                    ids = memo[text] = own.encode(text) + end
                view, n = memoryview(ids), len(ids) // 4
                edge, left, k = n % capacity or capacity, 0, 0
                while left < n:
                    part = view[4 * left : 4 * edge]
                    row.append(at), piece.append(k), start.append(left), length.append(edge - left), crc.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(part)
                    left, edge, k = edge, edge + capacity, k + 1
            salt = (np.arange(seen, seen + len(row), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)).astype(np.int64)
            seen += len(row)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), (piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), (salt, pa.int64())]
            if position:
                columns.append(batch.column("position").take(pa.array(row, pa.int64())))
            if with_ids:
                values = pa.Array.from_buffers(pa.int32(), sum(length), [None, pa.py_buffer(b"".join(parts))])
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), values))
            yield batch_of(names, columns)

    extra = [F.col(position).cast("long").alias("position")] if position else []
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra).mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that takes it. Bins of positions."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g: a bin with gap g
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fitting = open_gaps >> lengths[i]
        if fitting:
            gap = lengths[i] + (fitting & -fitting).bit_length() - 1
            at = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
            bins[at].append(i)
        else:
            gap, at = capacity, len(bins)
            bins.append([i])
        gap -= lengths[i]
        by_gap[gap].append(at)
        open_gaps |= 1 << gap
    return bins


def least_bins(lengths: list[int], capacity: int) -> int:
    """A lower bound on the number of bins: for every threshold, long pieces need bins of their own, whose rests the middle ones may use."""
    count = np.bincount(np.asarray(lengths, dtype=np.int64), minlength=capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half, best = capacity // 2, -(-int(total[-1]) // capacity)
    for t in range(1, half + 1):
        own, middle = int(n[-1] - n[capacity - t]), int(n[capacity - t] - n[half])
        rest = middle * capacity - int(total[capacity - t] - total[half])
        best = max(best, own + middle + max(0, -(-(int(total[half] - total[t - 1]) - rest) // capacity)))
    return best


class Bins:
    """Bins of item positions, with bit sets of the sizes that bins of each gap hold: bit t for an item, or two items together, of size t.

    A gap's bit sets may hold bits that no bin has any more; ``holder`` finds out
    and clears them.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int) -> None:
        self.size, self.capacity = lengths, capacity
        self.items = [list(b) for b in bins]
        self.gap = [capacity - sum(lengths[i] for i in b) for b in bins]
        self.at: dict[int, set[int]] = {}
        self.ones: list[int] = [0] * len(bins)
        self.twos: list[int] = [0] * len(bins)
        self.all_ones: dict[int, int] = {}
        self.all_twos: dict[int, int] = {}
        for k in range(len(bins)):
            if self.gap[k] > 0:
                self.enter(k)

    def enter(self, k: int) -> None:
        ones = twos = 0
        for i in self.items[k]:
            twos |= ones << self.size[i]  # with each of those before
            ones |= 1 << self.size[i]
        g = self.gap[k]
        self.ones[k], self.twos[k] = ones, twos
        self.at.setdefault(g, set()).add(k)
        self.all_ones[g] = self.all_ones.get(g, 0) | ones
        self.all_twos[g] = self.all_twos.get(g, 0) | twos

    def leave(self, k: int) -> None:
        g = self.gap[k]
        bins = self.at.get(g)
        if bins and k in bins:
            bins.remove(k)
            if not bins:
                del self.at[g], self.all_ones[g], self.all_twos[g]

    def holder(self, g: int, t: int, two: bool, fullest: int) -> int | None:
        """A bin of gap ``g`` (not over ``fullest``) with an item, or two, of size ``t``."""
        held = self.twos if two else self.ones
        found = next((k for k in self.at[g] if held[k] >> t & 1), None) if g <= fullest else None
        if found is None and g <= fullest:
            every = self.all_twos if two else self.all_ones
            every[g] = 0
            for k in self.at[g]:
                every[g] |= held[k]
        return found

    def exchange(self, e: int, k: int, out: list[int], back: list[int]) -> None:
        """Bin ``e``, which is in no index, gives items ``out`` to ``k`` and takes ``back``."""
        self.leave(k)
        moved = sum(self.size[i] for i in out) - sum(self.size[i] for i in back)
        self.items[e] = [i for i in self.items[e] if i not in out] + back
        self.items[k] = [i for i in self.items[k] if i not in back] + out
        self.gap[e] += moved
        self.gap[k] -= moved
        if self.gap[k] > 0:
            self.enter(k)

    def step(self, e: int) -> bool:
        """The move or exchange out of ``e`` that carries most; False if there is none."""
        size, fullest = self.size, self.gap[e]
        mine = sorted(self.items[e], key=lambda i: -size[i])
        gaps = sorted(g for g in self.at if g <= fullest)
        if not gaps:
            return False
        for i in mine:
            if size[i] <= gaps[-1]:
                g = next(g for g in gaps if g >= size[i])
                self.exchange(e, next(iter(self.at[g])), [i], [])
                return True
        sets: dict[int, list[int]] = {}  # size given -> items of that size together
        for n, i in enumerate(mine):
            for j in mine[n + 1 :]:
                if size[i] + size[j] <= self.capacity:
                    sets.setdefault(size[i] + size[j], [i, j])
        offers = [(size[i], [i], two) for i in {size[i]: i for i in mine}.values() for two in (False, True)] + [(s, out, False) for s, out in sets.items()]
        while True:
            best = None  # gain, given, gap, size taken, two
            for s, out, two in offers:
                every = self.all_twos if two else self.all_ones
                for g in gaps:
                    least = max(s - g, 1)
                    found = (every[g] & ((1 << s) - 1)) >> least
                    if found:
                        t = least + (found & -found).bit_length() - 1
                        if best is None or s - t > best[0]:
                            best = (s - t, out, g, t, two)
            if best is None:
                return False
            _, out, g, t, two = best
            k = self.holder(g, t, two, fullest)
            if k is None:
                continue
            if not two:
                back = [next(i for i in self.items[k] if size[i] == t)]
            else:
                items = self.items[k]
                back = next([i, j] for n, i in enumerate(items) for j in items[n + 1 :] if size[i] + size[j] == t)
            self.exchange(e, k, out, back)
            return True


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty bins by moves and exchanges between underfull ones, taken from the least filled up.

    An item may move to a fuller bin, be exchanged for a smaller one, or for
    two smaller ones, or two items for a larger one; the step that carries most
    is taken. The other bin, at least as full, becomes fuller, so squared fill
    rises with every step and the search ends. It stops when the bins are as
    few as the lower bound, or when a round over all underfull bins finds no
    step; nothing else bounds it. The step is found in bit sets of the sizes
    per gap, so its cost depends on the capacity, not on the number of bins.
    """
    state, least, live = Bins(bins, lengths, capacity), least_bins(lengths, capacity), len(bins)
    taken = True
    while taken and live > least:
        taken = False
        for e in sorted((k for k in range(len(bins)) if state.items[k] and state.gap[k] > 0), key=lambda k: (-state.gap[k], k)):
            if live <= least:
                break
            if state.gap[e] <= 0:
                continue
            state.leave(e)
            while state.items[e] and state.step(e):
                taken = True
            if state.items[e]:
                state.enter(e)
            else:
                live -= 1
    return [b for b in state.items if b]


def pack(pieces: DataFrame, capacity: int = 1024, group_rows: int = 10_000, position: str | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``length`` (1 to capacity) and ``salt``; other columns are kept.

    Groups hold about ``group_rows`` short pieces whatever their keys, so hot
    documents or sources don't matter; a group can't waste more than its last
    bins. With ``position``, a column of the documents' places in training
    order (dense, from 0), groups are runs of that many documents and ids rise
    with them, so the order holds from group to group. Repeated rows are packed
    each; which of equal pieces comes first can't be told. An empty table gives
    an empty one; columns named sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    short, whole = pieces.where(F.col("length") < capacity), pieces.where(F.col("length") == capacity)
    if position:
        group = F.floor(F.col(position) / F.lit(group_rows)).cast("long")
        own = F.lit(1 << 39) + F.pmod(F.col(position), F.lit(group_rows)) * (1 << 24) + F.col("piece")
        alone = whole.withColumn("sequence_id", group * (1 << 40) + own)
    else:
        groups = max(1, -(-short.count() // group_rows))
        group = F.pmod(F.xxhash64("salt", "length", *[c for c in ("doc_id", "piece") if c in pieces.columns]), F.lit(groups))
        alone = whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    keys = short.withColumn("__group", group)
    out = short.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))

    def solve(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        first = table.column("__group")[0].as_py() << 40
        for n, members in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = first + n, at
                at += lengths[i]
        return table.drop_columns(["__group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    packed = keys.groupBy("__group").applyInArrow(solve, out.schema)
    return packed.unionByName(alone.withColumn("offset", F.lit(0).cast("long")))


def written_order(documents: DataFrame, most_files: int = 100_000) -> DataFrame:
    """Add ``__position``: a row's place, from 0, in the order in which a table was written, by file name and row. Parquet only.

    Up to ``most_files`` files their starts, some 100 bytes each, are broadcast,
    so that texts stay where they lie; of more the optimizer chooses the join.
    """
    rows = documents.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))  # a row per file
    earlier = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    if len(documents.inputFiles()) <= most_files:
        starts = F.broadcast(starts)
    return rows.join(starts, "__file").withColumn("__position", F.col("__start") + F.col("__row")).drop("__file", "__row", "__start")


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, in_order: bool = False) -> DataFrame:
    """Cut and pack all documents; one row per piece, see ``cut`` and ``pack``. Input columns but doc_id and text aren't read.

    ``in_order`` keeps the order in which the documents' Parquet files were
    written, from group to group of 10,000 documents.
    """
    rows = written_order(documents.select("doc_id", "text")) if in_order else documents
    pieces = materialise(cut(rows, tokenizer_path, capacity, end_id, with_ids, "__position" if in_order else None), "pieces")
    return pack(pieces, capacity, position="position" if in_order else None).drop("salt")
