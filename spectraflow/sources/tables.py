"""Feature tables as tab-separated files, and project lists of input files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraflow.sources.mzml import list_files

# The columns of a feature table that aren't samples.
ABOUT = "id_number mz rtime rtime_left_base rtime_right_base parent_masstrack_id peak_area cSelectivity goodness_fitting snr detection_counts".split()


def write_features(features: DataFrame, path: str) -> None:
    """A folder of tab-separated files with a header; a table of any size, by as many tasks as it has."""
    features.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)


def sample_columns(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in ABOUT]


def numbered(features: DataFrame, mz: str = "mz", rtime: str = "rtime") -> DataFrame:
    """id, mz and rtime of a feature table in its least form, for matching."""
    return features.select(F.col("id_number").alias("id"), F.col(mz).cast("double").alias("mz"), F.col(rtime).cast("double").alias("rtime"))


def project_files(spark: SparkSession, path: str, kind: str = ".mzML") -> list[str]:
    """Input files: of a folder, those of its ``kind``; of a text file, the paths listed in it. Names must differ."""
    found = [r["value"].strip() for r in spark.read.text(path).collect()] if path.endswith(".txt") else list_files(path, kind)
    found = [f for f in found if f and not f.startswith("#")]
    names = [f.rsplit("/", 1)[-1] for f in found]
    if len(set(names)) < len(names):
        raise ValueError("two input files have one name")
    return found
