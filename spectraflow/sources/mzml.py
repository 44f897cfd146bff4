"""Spark data source ``mzml``: one partition a file, one row a spectrum, read as a stream.

    register(spark)
    spectra = spark.read.format("mzml").load("/data/run")     # a file or a folder
    ms1_points(spectra, min_intensity=100)
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "file string, ordinal int, id string, ms_level int, rtime double, polarity string, precursor_mz double, "
    "acquisition_time string, mz array<double>, intensity array<double>"
)

# Accessions of the PSI-MS vocabulary.
MS_LEVEL, SCAN_START, POSITIVE, NEGATIVE, SELECTED_MZ = "MS:1000511", "MS:1000016", "MS:1000130", "MS:1000129", "MS:1000744"
FLOAT32, FLOAT64, ZLIB, MZ_ARRAY, INTENSITY_ARRAY = "MS:1000521", "MS:1000523", "MS:1000574", "MS:1000514", "MS:1000515"
MINUTE = "UO:0000031"


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def list_files(path: str, suffix: str = ".mzML") -> list[str]:
    """Files below a folder whose name ends with ``suffix``, sorted; a file is taken as it is."""
    from pyarrow import fs

    store, inner = _filesystem(path)
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    scheme = path[: len(path) - len(inner)] if "://" in path else ""
    return sorted(scheme + i.path for i in store.get_file_info(fs.FileSelector(inner)) if i.is_file and i.path.endswith(suffix))


def _values(array) -> tuple[str | None, np.ndarray]:
    kinds = {c.get("accession") for c in array.findall(".//{*}cvParam")}
    raw = base64.b64decode(array.findtext("{*}binary") or "")
    if ZLIB in kinds and raw:
        raw = zlib.decompress(raw)
    values = np.frombuffer(raw, "<f4" if FLOAT32 in kinds else "<f8").astype("float64")
    return next((k for k in (MZ_ARRAY, INTENSITY_ARRAY) if k in kinds), None), values


def parse(stream, file: str = "") -> Iterator[tuple]:
    """Rows of one mzML file; each spectrum is forgotten after it is read. A spectrum without peaks has empty arrays."""
    acquired, ordinal = None, 0
    for event, node in iterparse(stream, ("start", "end")):
        tag = node.tag.rpartition("}")[2]
        if event == "start":
            if tag == "run":
                acquired = node.get("startTimeStamp")
            continue
        if tag == "chromatogram":
            node.clear()
        if tag != "spectrum":
            continue
        params = {c.get("accession"): c for c in node.findall(".//{*}cvParam")}
        value = lambda name: params[name].get("value") if name in params else None
        time = value(SCAN_START)
        seconds = None if time is None else float(time) * (60.0 if params[SCAN_START].get("unitAccession") == MINUTE else 1.0)
        arrays = dict(_values(a) for a in node.findall(".//{*}binaryDataArray"))
        precursor = value(SELECTED_MZ)
        polarity = "pos" if POSITIVE in params else "neg" if NEGATIVE in params else None
        empty = np.empty(0)
        yield (
            file, ordinal, node.get("id"), int(value(MS_LEVEL) or 1), seconds, polarity, None if precursor is None else float(precursor),
            acquired, arrays.get(MZ_ARRAY, empty).tolist(), arrays.get(INTENSITY_ARRAY, empty).tolist(),
        )
        ordinal += 1
        node.clear()


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in list_files(self.path)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:
            return
        store, inner = _filesystem(partition.value)
        with store.open_input_stream(inner) as stream:
            yield from parse(stream, partition.value)


class MzmlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mzml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MzmlSource)


def ms1_points(spectra: DataFrame, min_intensity: float = 100.0) -> DataFrame:
    """file, scan (dense from 0 over a file's MS1 spectra), rtime, mz, intensity of MS1 peaks whose whole intensity is above the limit."""
    by = Window.partitionBy("file").orderBy("ordinal")
    headers = spectra.where("ms_level = 1").select("file", "ordinal").withColumn("scan", (F.row_number().over(by) - 1).cast("int"))
    peaks = spectra.where("ms_level = 1").select("file", "ordinal", "rtime", F.explode(F.arrays_zip("mz", "intensity")).alias("p"))
    whole = F.floor(F.col("p.intensity")).cast("long")
    kept = peaks.where(whole > min_intensity).select("file", "ordinal", "rtime", F.col("p.mz").alias("mz"), whole.alias("intensity"))
    return kept.join(headers, ["file", "ordinal"]).select("file", "scan", "rtime", "mz", "intensity")


def ms2_spectra(spectra: DataFrame, min_intensity: float = 100.0) -> DataFrame:
    """MS2 spectra with their peaks from ``min_intensity`` on that lie more than 1 below the precursor; those left empty go."""
    zipped = F.transform(F.arrays_zip("mz", "intensity"), lambda p: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity")))
    good = F.filter(zipped, lambda p: (p["intensity"] >= min_intensity) & (p["mz"] < F.col("precursor_mz") - 1))
    rows = spectra.where("ms_level = 2 AND precursor_mz IS NOT NULL").select("file", "ordinal", "precursor_mz", "rtime", good.alias("peaks"))
    return rows.where(F.size("peaks") > 0)


def polarity(spectra: DataFrame) -> DataFrame:
    """file and pos, neg or mixed; null where no spectrum tells."""
    seen = spectra.groupBy("file").agg(F.collect_set("polarity").alias("p"))
    return seen.select("file", F.when(F.size("p") > 1, "mixed").otherwise(F.get("p", F.lit(0))).alias("polarity"))
