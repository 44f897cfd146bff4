"""Merging feature tables: one row per group of features alike in m/z and time, at most one of each table."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraflow.operators.islands import value_islands


class _Groups:
    """The groups of one island: (number, tables, m/z, times, median m/z, median time), found by their time and tables."""

    def __init__(self, ppm: float, rt: float):
        self.ppm, self.rt, self.n = ppm, rt, 0
        self.cells: dict[int, dict[frozenset, list]] = {}

    def place(self, table, mz: float, rtime: float) -> list:
        """The group that a feature joins or begins; features come in order."""
        if mz is None or rtime is None or not math.isfinite(mz) or not math.isfinite(rtime):  # near nothing
            self.n += 1
            return [self.n - 1, frozenset([table]), [mz], [rtime], mz, rtime]
        d, rt = mz * self.ppm * 1e-6, self.rt
        cell, best, found = math.floor(rtime / (rt * (1 + 1e-9))), (math.inf, 0), None
        for at in (cell - 1, cell, cell + 1):
            for tables, groups in self.cells.get(at, {}).items():
                if table in tables:
                    continue
                gone = False
                for g in groups:  # by number
                    if g[4] <= mz - 2 * d:  # out of reach for all that follow
                        gone = True
                    elif mz - d < g[4] <= mz + d and abs(g[5] - rtime) <= rt:
                        apart = (abs(g[4] - mz) / d + abs(g[5] - rtime) / rt, g[0])
                        if apart < best:
                            best, found = apart, g
                        if apart[0] == 0:
                            break
                if gone:
                    groups[:] = [g for g in groups if g[4] > mz - 2 * d]
        if found is None:
            found = [self.n, frozenset(), [], [], mz, rtime]
            self.n += 1
        else:
            old = self.cells[math.floor(found[5] / (rt * (1 + 1e-9)))][found[1]]
            del old[bisect.bisect_left(old, found[0], key=lambda g: g[0])]
        found[1] = found[1] | {table}
        bisect.insort(found[2], mz), bisect.insort(found[3], rtime)
        found[4], found[5] = median(found[2]), median(found[3])
        home = self.cells.setdefault(math.floor(found[5] / (rt * (1 + 1e-9))), {}).setdefault(found[1], [])
        bisect.insort(home, found, key=lambda g: g[0])
        return found


def consensus(features: DataFrame, ppm: float = 4.0, rt: float = 15.0, reach: float = 0.05) -> DataFrame:
    """Long table (table, id, mz, rtime) with ``group`` (text), and the group's median m/z and time.

    In the order of m/z, time, table and id a feature joins the group whose
    centre it is nearest to in m/z over its tolerance plus time over ``rt``,
    among those within both and without a feature of its table; else it begins
    a group. Values of m/z a tolerance or more apart share no group, so each
    run of nearer ones is settled by itself; a task holds one run at a time.
    ``reach`` is the width of the buckets in which runs are found.
    """
    rows = features.select("table", "id", F.col("mz").cast("double").alias("mz"), F.col("rtime").cast("double").alias("rtime"))
    rows = value_islands(rows, "mz", lambda now, before: now - before >= now * (ppm * 1e-6) * (1 + 1e-9), reach)
    last = [F.asc_nulls_last(c) for c in ("mz", "rtime", "table", "id")]
    rows = rows.repartition("island").sortWithinPartitions("island", *last)
    kinds = dict(rows.dtypes)
    names = ["table", "id", "mz", "rtime", "group", "group_mz", "group_rtime"]

    def out(batch: pa.RecordBatch, islands: list, found: list) -> pa.RecordBatch:
        made = [(f"{i!r}_{g[0]}", g[4], g[5]) for i, g in zip(islands, found)]
        columns = [pa.array(list(c), k) for c, k in zip(zip(*made), (pa.string(), pa.float64(), pa.float64()))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), *columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, groups = [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            islands, tables, mzs, times = (batch.column(c).to_pylist() for c in ("island", "table", "mz", "rtime"))
            found = []
            for island, table, mz, rtime in zip(islands, tables, mzs, times):
                if groups is None or (island != now and not (island != island and now != now)):  # NaN is one island
                    for one in held:  # they end in a run that is settled
                        yield out(*one)
                    held, now, groups = [], island, _Groups(ppm, rt)
                found.append(groups.place(table, mz, rtime))
            held.append((batch, islands, found))
        for one in held:
            yield out(*one)

    return rows.mapInArrow(run, f"table {kinds['table']}, id {kinds['id']}, mz double, rtime double, group string, group_mz double, group_rtime double")


def merged(features: DataFrame, cells: DataFrame, tables: list[str], **options) -> DataFrame:
    """One row per group: its m/z, time, source_ids, and an area per table; ``cells`` has table, id and area."""
    found = consensus(features, **options).join(cells, ["table", "id"], "left")
    ids = F.array_join(F.sort_array(F.collect_set(F.concat_ws("::", "table", F.col("id").cast("string")))), ",")
    wide = found.groupBy("group", "group_mz", "group_rtime").pivot("table", tables).agg(F.sum("area")).fillna(0, tables)
    return wide.join(found.groupBy("group").agg(ids.alias("source_ids"), F.count(F.lit(1)).alias("n_tables")), "group")
