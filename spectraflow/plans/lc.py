"""From mzML files to a feature table, sample by sample and then over the whole project.

    features = process(spark, "/data/run")
    export(features, "/data/out")
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraflow.functions import arrays
from spectraflow.functions.text import truth
from spectraflow.operators import clusters, evaluation, islands, tables, tracks
from spectraflow.sources import mzml
from spectraflow.sources.tables import write_features


@dataclass(frozen=True)
class Parameters:
    """Defaults of a run; ``with_text`` takes them from a file's or a command line's texts."""

    mode: str = "pos"
    ppm: float = 5.0
    min_intensity: float = 100.0
    min_timepoints: int = 5
    min_peak_height: float = 1000.0
    min_peak_ratio: float = 0.001
    wlen: int = 25
    signal_noise_ratio: float = 2.0
    gaussian_shape: float = 0.5
    consecutive_gap: int = 2

    @property
    def limits(self) -> evaluation.Limits:
        """The peak limits; a prominence is at least a third of the least height."""
        return evaluation.Limits(
            self.min_intensity, self.min_peak_height, self.min_peak_ratio, int(0.33 * self.min_peak_height),
            timepoints=self.min_timepoints, wlen=self.wlen, snr=self.signal_noise_ratio, shape=self.gaussian_shape,
        )

    def with_text(self, values: dict[str, str]) -> Parameters:
        known = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        if unknown := set(values) - set(known):
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return replace(self, **{k: truth(v) if known[k] is bool else known[k](v) for k, v in values.items()})


def read_parameters(lines: list[str]) -> dict[str, str]:
    """``name: value`` or ``name = value`` a line; # begins a comment."""
    pairs = [line.split("#")[0].replace("=", ":", 1).partition(":") for line in lines]
    return {k.strip(): v.strip() for k, mark, v in pairs if mark and k.strip()}


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint in spark.checkpoint.dir, so that what follows neither plans nor runs it again; kept on the executors' disks where none is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist(StorageLevel.DISK_ONLY)


def mass_tracks(points: DataFrame, p: Parameters = Parameters()) -> tuple[DataFrame, DataFrame]:
    """Tracks (file, track, mz, height, n_points) and their cells (file, track, scan, intensity) from points (file, scan, mz, intensity).

    Buckets of a thousandth with enough points are chained per file; bins too
    low or too scattered go; wide ones are parted at their seeds.
    """
    binned = islands.mz_bins(points, F.floor(F.col("mz") * 1000), p.min_timepoints, p.ppm, keys=("file",))
    kept = clusters.compact(binned, ["file", "bin"], "scan", "intensity", p.min_timepoints, p.consecutive_gap, p.min_peak_height)
    parted = clusters.split_wide(kept.select("file", "bin", "scan", "mz", "intensity"), ["file", "bin"], "mz", p.ppm)
    named = settled(parted.withColumn("track", F.concat_ws("_", "bin", "part")))
    found = tracks.consensus_mz(named.withColumn("__key", F.struct("file", "track")), "__key", "mz", "intensity", "scan").select("__key.*", "mz", "height", "n_points")
    return found, named.groupBy("file", "track", "scan").agg(F.max("intensity").alias("intensity"))


def mass_grid(found: DataFrame, ppm: float = 5.0, reach: float = 0.1) -> DataFrame:
    """Tracks of all files in one grid: (file, track, row, row_mz). Values chain while they are less than ``ppm`` of the lower apart; wide chains are parted at their seeds.

    Of two tracks of a file in one row the last by m/z and name stays.
    """
    by = Window.partitionBy("island").orderBy("mz", "track", "file")
    marked = islands.coarse_islands(found.select("file", "track", "mz"), "mz", reach).withColumn("__p", F.lag("mz").over(by))
    new = F.coalesce((F.col("mz") - F.col("__p") >= F.col("__p") * (ppm * 1e-6)).cast("int"), F.lit(0))
    chained = marked.withColumn("__c", F.sum(new).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__p")
    parted = clusters.split_wide(chained, ["island", "__c"], "mz", ppm).withColumn("row", F.concat_ws("_", "island", "__c", "part"))
    centres = parted.groupBy("row").agg(F.median("mz").alias("row_mz"))
    return parted.groupBy("row", "file").agg(F.max_by("track", F.struct("mz", "track")).alias("track")).join(centres, "row")


def process(spark: SparkSession, path: str, p: Parameters = Parameters()) -> DataFrame:
    """The feature table of a folder of mzML files: id_number, mz, apex, bases, height, area, goodness, selectivity, snr, detection_counts and an area per file.

    Peaks are found on composite tracks, the sum over files per grid row and
    scan. Scans aren't aligned between files; see ``alignment`` for that.
    """
    mzml.register(spark)
    points = mzml.ms1_points(spark.read.format("mzml").load(path), p.min_intensity)
    found, cells = mass_tracks(points, p)
    grid = mass_grid(settled(found), p.ppm)
    rows = settled(cells.join(grid, ["file", "track"]).select("file", "row", "row_mz", "scan", "intensity"))
    sums = tracks.composite(rows, ["row", "row_mz", "scan"], "intensity")
    pairs = F.map_from_entries(F.collect_list(F.struct("scan", F.col("intensity").cast("double"))))
    vectors = sums.groupBy("row", "row_mz").agg(arrays.dense(pairs, F.max("scan") + 1).alias("v"))  # bounded by a run's scans
    peaks_ = evaluation.evaluated(vectors, "row", "v", p.limits).join(vectors.select("row", F.col("row_mz").alias("mz")), "row")
    features = settled(peaks_.withColumn("id_number", F.concat_ws("_", F.lit("F"), "row", "apex")))
    files = [f.rsplit("/", 1)[-1] for f in mzml.list_files(path)]
    own = rows.join(features.select("row", "id_number", "left_base", "right_base"), "row").where(F.col("scan").between(F.col("left_base"), F.col("right_base")))
    areas = tables.wide(own.withColumn("sample", F.regexp_extract("file", r"[^/]+$", 0)), "id_number", "sample", files, F.sum("intensity"))
    return tables.detection_counts(features.join(areas, "id_number"), [f"`{f}`" for f in files]).drop("row")


def export(features: DataFrame, path: str) -> None:
    """All features, and those found in some sample whose shape is better than 0.7, as tab-separated folders."""
    write_features(features, f"{path}/full")
    write_features(features.where((F.col("detection_counts") > 0) & (F.round("goodness", 2) > 0.7)), f"{path}/preferred")


def main(args: list[str] | None = None) -> None:
    """``python -m spectraflow.plans.lc FOLDER OUT [--ppm 5] [--parameters FILE] ...``"""
    import argparse

    parser = argparse.ArgumentParser(prog="spectraflow", description="A feature table from a folder of mzML files.")
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("--parameters", help="file of name: value lines")
    for f in fields(Parameters):
        parser.add_argument(f"--{f.name}")
    given = vars(parser.parse_args(args))
    spark = SparkSession.builder.appName("spectraflow").getOrCreate()
    listed = [r["value"] for r in spark.read.text(given["parameters"]).collect()] if given["parameters"] else []
    chosen = read_parameters(listed) | {f.name: given[f.name] for f in fields(Parameters) if given[f.name] is not None}
    export(process(spark, given["folder"], Parameters().with_text(chosen)), given["out"])


if __name__ == "__main__":
    main()
