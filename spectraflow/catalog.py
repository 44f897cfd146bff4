"""Queries of the engine over the driver's tables, with the same in DuckDB's SQL.

Events stand for chromatographic points: a user is a mass track, the hour a
scan, the value an intensity (in whole hundredths, so sums are exact).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraflow.functions import arrays, index, mass, text
from spectraflow.operators import bands, clusters, evaluation, indices, islands, matching, merge, pairing, peaks, sample_graph, spectra, tables, tracks


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("long")  # no time zone has a say
    return _read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("track"), scan.alias("scan"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("intensity"), "event_type", "value"
    )


POINTS = """points AS (SELECT event_id, user_id AS track, CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000e0) AS BIGINT) AS scan,
  CAST(floor(value * 100 + 0.5e0) AS BIGINT) AS intensity, event_type, value FROM events)"""
REGIONS = f"""{POINTS}, best AS (SELECT track, scan, max(intensity) AS i FROM points GROUP BY 1, 2),
  marked AS (SELECT *, CASE WHEN scan - lag(scan) OVER (PARTITION BY track ORDER BY scan) >= 3 THEN 1 ELSE 0 END AS fresh FROM best),
  runs AS (SELECT *, sum(fresh) OVER (PARTITION BY track ORDER BY scan ROWS UNBOUNDED PRECEDING) AS region FROM marked),
  regions AS (SELECT track, CAST(region AS BIGINT) AS region, min(scan) AS left_base, max(scan) AS right_base, arg_max(scan, i * 100000 - scan) AS apex,
    max(i) AS height, CAST(sum(i) AS BIGINT) AS peak_area, count(*) AS n_scans FROM runs GROUP BY 1, 2)"""


def roi_islands(spark, sf_dir):
    return tracks.regions(points(spark, sf_dir), "track", "scan", "intensity").withColumn("region", F.col("region").cast("long"))


def feature_table(spark, sf_dir):
    found = tracks.regions(points(spark, sf_dir), "track", "scan", "intensity")
    kept = found.where((F.col("n_scans") > 1) & (F.col("height") > 1000))
    return kept.select(F.concat(F.lit("F"), "track", F.lit("_"), "region").alias("id_number"), "left_base", "right_base", "apex", "height", "peak_area", "n_scans")


def mz_selectivity(spark, sf_dir):
    prices = _read(spark, sf_dir, "part").select(F.col("p_retailprice").alias("mz")).distinct()
    return pairing.selectivity(prices, "mz", 5.0, reach=1.0).select("mz", F.round("selectivity", 8).alias("selectivity"))


def paired_mapping(spark, sf_dir):
    a = _read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("k"))
    b = _read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("k"))
    return pairing.paired_mapping(a, b, "v", "k", 300.0, reach=5.0)


def band_join_all(spark, sf_dir):
    a = _read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    b = _read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal")
    return bands.ppm_join(a, b, "p_retailprice", "c_acctbal", 50.0, 1.0).select("p_partkey", "c_custkey")


def _halves(spark, sf_dir):
    e = points(spark, sf_dir).where("intensity > 0")
    a = e.where("event_id % 2 = 0").select(F.col("event_id").alias("left_id"), F.col("intensity").alias("left_mz"), F.col("scan").alias("left_rt"))
    b = e.where("event_id % 2 = 1").select(F.col("event_id").alias("right_id"), F.col("intensity").alias("right_mz"), F.col("scan").alias("right_rt"))
    near = matching.mz_rt_join(a, b, "left_mz", "right_mz", "left_rt", "right_rt", 1000.001, 5.0)
    return near.where(F.abs(F.col("left_mz") - F.col("right_mz")) * 1000 <= F.col("left_mz"))  # whole numbers: the limit itself counts


def match_features(spark, sf_dir):
    return _halves(spark, sf_dir).select("left_id", "right_id")


def mutual_best_match(spark, sf_dir):
    best = bands.mutual_best(_halves(spark, sf_dir), "left_id", "right_id", F.abs(F.col("left_mz") - F.col("right_mz")))
    return best.select("left_id", "right_id", F.abs(F.col("left_mz") - F.col("right_mz")).alias("apart"))


PAIRS = f"""{POINTS}, a AS (SELECT * FROM points WHERE intensity > 0 AND event_id % 2 = 0), b AS (SELECT * FROM points WHERE intensity > 0 AND event_id % 2 = 1),
  pairs AS (SELECT a.event_id AS left_id, b.event_id AS right_id, abs(a.intensity - b.intensity) AS apart FROM a JOIN b
    ON abs(a.intensity - b.intensity) * 1000 <= a.intensity AND abs(a.scan - b.scan) < 5)"""


def nearest_pairs(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long").alias("v"))
    a = p.select(F.col("p_partkey").alias("left_key"), (F.col("v") + 100).alias("target"))
    b = p.select(F.col("p_partkey").alias("right_key"), F.col("v").alias("found"))
    near = bands.nearest_within(a, b, "target", "found", 50.0, F.abs(F.col("target") - F.col("found")) < 20, "left_key", "right_key")
    return near.select("left_key", "right_key")


def mz_islands(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("mz"))
    binned = islands.mz_bins(rows, F.floor("mz"), 2, 5.0)
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("mz").alias("low"), F.max("mz").alias("high")).withColumn("bin", F.col("bin").cast("long"))


def consensus_mz(spark, sf_dir):
    return tracks.consensus_mz(points(spark, sf_dir), "track", "value", "intensity", "event_id").select("track", F.round("mz", 6).alias("mz"), "height", "n_points")


def composite_sum(spark, sf_dir):
    return tracks.composite(points(spark, sf_dir), ["track", "scan"], "intensity")


def area_sum_auc(spark, sf_dir):
    return tracks.areas(points(spark, sf_dir), ["track"], ["scan", "event_id"], "intensity")


def moving_mean_clamped(spark, sf_dir):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    months = _read(spark, sf_dir, "orders").groupBy("o_orderpriority", F.floor(day / 30).cast("long").alias("m")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = months.groupBy("o_orderpriority").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "n"))), lambda s: s["n"]).alias("v"))
    smooth = one.select("o_orderpriority", F.posexplode(arrays.moving_mean(F.col("v"), 9)).alias("i", "mean"))
    return smooth.select("o_orderpriority", F.col("i").cast("long").alias("i"), F.round("mean", 6).alias("mean"))


def noise_baseline(spark, sf_dir):
    found = tracks.noise(points(spark, sf_dir), "track", "intensity", 500.0)
    return found.select("track", F.round("baseline", 4).alias("baseline"), F.round("noise", 4).alias("noise"))


def detrend(spark, sf_dir):
    daily = points(spark, sf_dir).groupBy("event_type", F.floor(F.col("scan") / 24).cast("long").alias("day")).agg(F.sum("intensity").alias("total"))
    return tracks.detrended(daily, "event_type", "day", "total").select("event_type", "day", F.round("residual", 3).alias("residual"))


def quality_filter(spark, sf_dir):
    rows = tables.wide(_read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"], F.sum(F.col("l_quantity").cast("long")))
    counted = tables.detection_counts(rows, ["A", "N", "R"])
    return counted.where("detection_counts >= 2").select("l_orderkey", *[F.col(c).alias(f"sample_{c.lower()}") for c in "ANR"], "detection_counts")


def top_n_peaks(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return tables.top_n(rows, ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"], 3)


def jaccard_samples(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("sample"), "l_partkey")
    return tables.jaccard(rows, "sample", "l_partkey").withColumn("jaccard", F.round("jaccard", 8))


def pairwise_corr(spark, sf_dir):
    daily = points(spark, sf_dir).groupBy("event_type", F.floor(F.col("scan") / 24).cast("long").alias("day")).agg(F.sum("intensity").alias("total"))
    return tables.correlations(daily, "day", "event_type", "total").withColumn("r", F.round("r", 6))


def coelution_clusters(spark, sf_dir):
    found = tracks.coelution(points(spark, sf_dir), "event_id", "scan", 2, ("track",))
    return found.select("event_id", "track", F.col("cluster").cast("long").alias("cluster"), "size")


KNOTS = [(0.0, 800.0), (100.0, 900.0), (250.0, 1100.0), (400.0, 1250.0), (700.0, 1700.0)]


def interp_clamped(spark, sf_dir):
    rows = points(spark, sf_dir).select("event_id", F.col("scan").cast("double").alias("scan"))
    return tracks.interpolate(rows, "scan", KNOTS, "index").select("event_id", F.round("index", 6).alias("index"))


def lib_cosine(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    found = pairing.vector_similarities(v.where("vec_id % 50 = 0"), v, "vec_id", "v", "lib_id")
    return found.select("vec_id", "lib_id", F.round("cosine", 6).alias("cosine"), F.round("entropy", 6).alias("entropy"))


def detect_peaks(spark, sf_dir):
    sums = tracks.composite(points(spark, sf_dir), ["track", "scan"], "intensity")
    cells = F.map_from_entries(F.collect_list(F.struct("scan", F.col("intensity").cast("double"))))
    last = sums.agg((F.max("scan") + 1).alias("scans"))  # one row
    vectors = sums.groupBy("track").agg(cells.alias("cells")).crossJoin(last).select("track", arrays.dense(F.col("cells"), F.col("scans")).alias("v"))
    return peaks.detect(vectors, "track", "v").withColumns({c: F.round(c, 4) for c in ("width", "area", "goodness", "sigma")})


def judged_peaks(spark, sf_dir):
    sums = tracks.composite(points(spark, sf_dir), ["event_type", "scan"], "intensity")
    cells = F.map_from_entries(F.collect_list(F.struct("scan", F.col("intensity").cast("double"))))
    vectors = sums.groupBy("event_type").agg(arrays.dense(cells, F.max("scan") + 1).alias("v"))  # as many cells as hours
    limits = evaluation.Limits(low=500.0, height=5000.0, prominence=1500.0, timepoints=4)
    return evaluation.evaluated(vectors, "event_type", "v", limits).withColumns({c: F.round(c, 4) for c in ("goodness", "selectivity")})


def tic(spark, sf_dir):
    rows = points(spark, sf_dir)
    return rows.groupBy("scan").agg(F.sum("intensity").alias("tic"), F.max("intensity").alias("base_peak"))


def orphans(spark, sf_dir):
    used = _read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return bands.orphans(_read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), used, "c_custkey")


def theoretical_ions(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.explode(mass.ions(F.col("p_retailprice"), "pos")).alias("x"))
    return rows.select("p_partkey", "x.ion", F.round("x.ion_mz", 5).alias("ion_mz"))


def close_pairs(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("mz"))
    return clusters.close_pairs(rows, "mz", "o_orderkey", 5.0, reach=10.0).select("o_orderkey", "before")


def compact_tracks(spark, sf_dir):
    kept = clusters.compact(points(spark, sf_dir), ["track"], "scan", "intensity", 5, 60, 5000)
    return kept.groupBy("track").agg(F.count(F.lit(1)).alias("n"))


def extract_targets(spark, sf_dir):
    features = _read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal")
    found = matching.extract_targets(features, _read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "c_acctbal", "p_retailprice", "p_partkey", 100.0, 1.0)
    return found.select("p_partkey", "c_custkey", F.round("ppm_error", 4).alias("ppm_error"))


def annotate_ions(spark, sf_dir):
    features = _read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_acctbal").alias("mz"))
    found = matching.annotate(features, _read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "c_custkey", "mz", "p_partkey", "p_retailprice", "pos", 20.0, 1.0)
    return found.withColumn("ppm_error", F.round("ppm_error", 4))


def nearest_track(spark, sf_dir):
    tracks_ = _read(spark, sf_dir, "supplier").select("s_suppkey", F.floor(F.col("s_acctbal") * 100 + 0.5).cast("long").alias("mz"))
    targets = _read(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long").alias("target"))
    return matching.nearest_track(tracks_, targets, "mz", "target", "s_suppkey", "p_partkey", 2000.0).select("p_partkey", "s_suppkey")


def index_window(spark, sf_dir):
    a = _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a_index"))
    b = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("b_index"))
    return matching.near_index(a, b, "a_index", "b_index", 2.0).select("s_suppkey", "c_custkey")


SPIKES = [("one", 1000.0), ("two", 1200.5), ("three", 1201.0)]


def spike_ins(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("mz"), F.col("p_size").alias("intensity"))
    return matching.spike_ins(rows, SPIKES, "mz", "intensity", 5.0, 10).select("p_partkey", "target")


def best_spectrum(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("mz"), F.floor("l_quantity").cast("double").alias("intensity"))).alias("peaks"))
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    best = spectra.best_spectrum(lines.join(orders, "l_orderkey"), ["o_custkey"], order="l_orderkey")
    return best.select("o_custkey", "l_orderkey", spectra.total(F.col("peaks")).cast("long").alias("total"))


def richest_spectra(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"))).alias("peaks"))
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return spectra.richest(lines.join(orders, "l_orderkey"), ["o_custkey"], 2, order="l_orderkey").select("o_custkey", "l_orderkey", F.size("peaks").alias("n_peaks"))


def base_peaks(spark, sf_dir):
    peaks_ = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("at"), F.floor(F.col("l_quantity")).cast("long").alias("intensity"))))
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(peaks_.alias("peaks"))
    top = lines.withColumn("b", spectra.base_peak(F.col("peaks")))
    return top.select("l_orderkey", F.col("b.at").cast("int").alias("base"), F.size(spectra.above_share(F.col("peaks"), 0.5)).cast("long").alias("n_high"))


def html_escaped(spark, sf_dir):
    rows = _read(spark, sf_dir, "pages").select("page_id", text.html_escape(F.col("html")).alias("x"))
    return rows.select("page_id", F.md5(F.col("x").cast("binary")).alias("digest"), F.char_length("x").cast("long").alias("n_chars"))


def safe_filenames(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name"))


def human_sizes(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.human_size(F.floor(F.col("o_totalprice") * 1000).cast("long")).alias("size"))


def complete_mapping(spark, sf_dir):
    a = _read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("k"))
    b = _read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("k"))
    return matching.complete_mapping(a, b, "v", "k", 300.0, reach=3.0)


def merge_tables(spark, sf_dir):
    e = points(spark, sf_dir).where("intensity > 0")
    rows = e.select(F.concat(F.lit("t"), F.col("event_id") % 3).alias("table"), F.col("event_id").alias("id"), (F.col("intensity") / 10).alias("mz"), F.col("scan").cast("double").alias("rtime"))
    return merge.consensus(rows, 20.0, 3.0, reach=1.0).select("table", "id", F.round("group_mz", 6).alias("group_mz"), F.round("group_rtime", 6).alias("group_rtime"))


def mass_splits(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_retailprice") / 10).cast("long").alias("bin"), F.col("p_retailprice").alias("mz"))
    return clusters.split_wide(rows, ["bin"], "mz", 500.0).select("p_partkey", "bin", "part")


def spectrum_scores(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("l_partkey") % 97).cast("double").alias("mz"), F.col("l_quantity").cast("double").alias("intensity")))).alias("peaks"))
    totals = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("precursor_mz"), (F.col("o_orderkey") % 2).alias("half"))
    every = lines.join(totals, "id")
    found = spectra.search_library(every.where("half = 0"), every.where("half = 1"), 5.0, 0.5, 0.1)
    return found.select("spectrum_id", "library_id", F.round("cosine", 6).alias("cosine"), "n_matched", F.round("entropy", 6).alias("entropy"))


def match_counts(spark, sf_dir):
    return matching.matched_counts(match_features(spark, sf_dir), "left_id", "right_id")


def retention_index(spark, sf_dir):
    scans = points(spark, sf_dir).select("event_type", F.col("scan") + 0.25).distinct().toDF("event_type", "rtime")
    ladder = scans.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("i"))
    ladder = ladder.select("event_type", (F.col("i") * 50 - 1).alias("standard"), (F.col("i") + 8).alias("carbons"))
    return indices.retention_index(scans, ladder, "event_type", "rtime", "standard", "carbons").withColumn("ri", F.round("ri", 4))


LINES = [str(i) for i in range(1, 8)]


def _profiles(spark, sf_dir):
    """Each part's whole quantity by line number; 0 where it has none."""
    rows = _read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_linenumber").cast("string").alias("line"), F.col("l_quantity").cast("long").alias("q"))
    wide = tables.wide(rows, "l_partkey", "line", LINES, F.sum("q"))
    return wide.select("l_partkey", F.explode(F.array(*[F.struct(F.lit(v).alias("line"), F.col(v).alias("q")) for v in LINES])).alias("x")).select("l_partkey", "x.line", "x.q")


def distilled_features(spark, sf_dir):
    members = _read(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("l_partkey"))
    return indices.distilled(members, _profiles(spark, sf_dir), "p_brand", "l_partkey", "line", "q", 0.6123).withColumn("r", F.round("r", 6))


def penalised_neighbours(spark, sf_dir):
    features = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("ri"))
    found = indices.penalised_neighbours(features, features, _profiles(spark, sf_dir), "l_partkey", "ri", "line", "q", 0.255, 2.005, 0.5123)
    return found.select("seed", "l_partkey", F.round("score", 6).alias("score"))


def untangled_peaks(spark, sf_dir):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    rows = _read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), day.alias("apex"), "l_linenumber", "l_quantity")
    found = rows.select("l_suppkey", "id", "apex", (F.col("apex") - F.col("l_linenumber")).alias("left_base"), (F.col("apex") + F.floor("l_quantity") % 10).cast("long").alias("right_base"))
    return indices.untangled(found, "l_suppkey", "id")


def compound_features(spark, sf_dir):
    return indices.one_per_compound(_read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag")


def same_time_pairs(spark, sf_dir):
    tops = points(spark, sf_dir).groupBy("track").agg((-F.max(F.struct("intensity", (-F.col("scan")).alias("s")))["s"]).alias("apex"))
    pairs = tops.select(F.col("track").alias("left_track"), (F.col("track") + 1).alias("right_track"))
    return indices.same_time(pairs, tops, "left_track", "right_track", "track", "apex", 720).select("left_track", "right_track")


def upserted(spark, sf_dir):
    fresh = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return indices.upsert(_read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), fresh, ["c_custkey"])


def calibrated_mz(spark, sf_dir):
    rows = _read(spark, sf_dir, "part")
    return rows.select("p_partkey", F.round(index.calibrated(F.col("p_retailprice"), (F.col("p_size") - 25.5) * 1e-7), 6).alias("mz"))


def least_height(spark, sf_dir):
    return indices.least_height(_read(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", 100.0, 1000.0, 20.0)


def track_selectivity(spark, sf_dir):
    rows = points(spark, sf_dir)
    sums = tracks.composite(rows, ["track", "scan"], "intensity")
    cells = F.map_from_entries(F.collect_list(F.struct("scan", F.col("intensity").cast("double"))))
    last = sums.agg((F.max("scan") + 1).alias("scans"))  # one row
    vectors = sums.groupBy("track").agg(cells.alias("cells")).crossJoin(last).select("track", arrays.dense(F.col("cells"), F.col("scans")).alias("v"))
    high = tracks.regions(rows, "track", "scan", "intensity").where((F.col("n_scans") > 1) & (F.col("height") > 1000))
    lists = high.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("left_base", "right_base", "height"))).alias("p"))
    found = vectors.join(lists, "track").select("track", "p", index.selectivities(F.col("v"), F.col("p")).alias("s"))
    each = found.select("track", F.explode(F.arrays_zip("p", "s")).alias("x"))
    return each.select("track", "x.p.left_base", F.round("x.s", 8).alias("selectivity"))


def sample_tree(spark, sf_dir):
    samples = sorted(r[0] for r in _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey") % 20).distinct().collect())  # 20 at most
    return sample_graph.alignment_tree(spark, samples, jaccard_samples(spark, sf_dir))


def _ion_values() -> str:
    return ", ".join(f"('{k}', {mass.PROTON}e0, {d}e0)" for k, d in mass.POSITIVE_ADDUCTS.items())


def _knots_sql() -> str:
    steps = " ".join(f"WHEN scan <= {x1}e0 THEN {y0}e0 + (scan - {x0}e0) * {(y1 - y0) / (x1 - x0)!r}e0" for (x0, y0), (x1, y1) in zip(KNOTS, KNOTS[1:]))
    return f"CASE WHEN scan <= {KNOTS[0][0]}e0 THEN {KNOTS[0][1]}e0 {steps} ELSE {KNOTS[-1][1]}e0 END"


PROFILES = """c AS (SELECT k, line, CAST(coalesce(sum(CAST(trunc(l_quantity) AS BIGINT)), 0) AS BIGINT) AS q FROM (SELECT k, line FROM (SELECT DISTINCT l_partkey AS k FROM lineitem), (SELECT unnest(range(1, 8)) AS line))
  LEFT JOIN lineitem ON l_partkey = k AND l_linenumber = line GROUP BY 1, 2)"""
_DAILY = f"{POINTS}, daily AS (SELECT event_type, CAST(floor(scan / 24e0) AS BIGINT) AS day, CAST(sum(intensity) AS BIGINT) AS total FROM points GROUP BY 1, 2)"

ORACLE_SQL = {
    "match_counts": f"""WITH {PAIRS}, l AS (SELECT left_id, count(*) AS n FROM pairs GROUP BY 1), r AS (SELECT right_id, count(*) AS n FROM pairs GROUP BY 1)
      SELECT (SELECT count(*) FROM pairs) AS pairs, (SELECT count(*) FROM l) AS left_matched, (SELECT count(*) FROM l WHERE n = 1) AS left_unique,
        (SELECT count(*) FROM r) AS right_matched, (SELECT count(*) FROM r WHERE n = 1) AS right_unique""",
    "retention_index": f"""WITH {POINTS}, t AS (SELECT DISTINCT event_type, scan + 0.25e0 AS rtime FROM points), e AS (SELECT event_type, max(rtime) AS m FROM t GROUP BY 1),
      l AS (SELECT i * 50 - 1 AS s, i + 8 AS n FROM (SELECT unnest(range(15)) AS i)),
      b AS (SELECT t.event_type, rtime, max(m) AS m, max(s) FILTER (s < rtime) AS p, max(n) FILTER (s < rtime) AS n, min(s) FILTER (s >= rtime) AS q FROM t JOIN e ON t.event_type = e.event_type CROSS JOIN l GROUP BY 1, 2)
      SELECT event_type, rtime, round(100 * (n + (rtime - p) / (coalesce(CAST(q AS DOUBLE), m * 1.1e0) - rtime)), 4) AS ri FROM b""",
    "distilled_features": f"""WITH {PROFILES}, z AS (SELECT p_brand, c.* FROM c JOIN part ON k = p_partkey WHERE k IN (SELECT k FROM c GROUP BY k HAVING min(q) < max(q))),
      r AS (SELECT x.p_brand, x.k, y.k AS j, corr(x.q, y.q) AS r FROM z x JOIN z y ON x.p_brand = y.p_brand AND x.line = y.line GROUP BY 1, 2, 3),
      s AS (SELECT p_brand, k, round(sum(r), 9) AS s FROM r GROUP BY 1, 2), b AS (SELECT p_brand, k AS quant FROM s QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, k) = 1)
      SELECT b.p_brand, quant, j AS l_partkey, round(r, 6) AS r FROM b JOIN r ON r.p_brand = b.p_brand AND r.k = quant WHERE r > 0.6123e0""",
    "penalised_neighbours": f"""WITH {PROFILES}, v AS (SELECT c.*, p_retailprice AS ri FROM c JOIN part ON k = p_partkey WHERE k IN (SELECT k FROM c GROUP BY k HAVING min(q) < max(q))),
      s AS (SELECT x.k AS seed, y.k AS l_partkey, corr(x.q, y.q) * CASE WHEN abs(x.ri - y.ri) < 0.255e0 THEN 1e0 ELSE 2 / (1 + exp(exp(1e0) * abs(x.ri - y.ri) / 2.005e0)) END AS score
        FROM v x JOIN v y ON x.line = y.line AND abs(x.ri - y.ri) <= 2.005e0 GROUP BY x.k, y.k, x.ri, y.ri)
      SELECT seed, l_partkey, round(score, 6) AS score FROM s WHERE score >= 0.5123e0""",
    "untangled_peaks": """WITH p AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS id, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS apex, l_linenumber, l_quantity FROM lineitem),
      q AS (SELECT l_suppkey, id, apex, apex - l_linenumber AS l, apex + CAST(floor(l_quantity) AS BIGINT) % 10 AS r FROM p),
      n AS (SELECT *, lag(l) OVER w AS pl, lag(r) OVER w AS pr FROM q WINDOW w AS (PARTITION BY l_suppkey ORDER BY apex, id)),
      c AS (SELECT *, sum(CASE WHEN least(r, pr) - (CASE WHEN r > pr THEN l ELSE pl END) > 3 THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY apex, id ROWS UNBOUNDED PRECEDING) AS c FROM n),
      g AS (SELECT l_suppkey, c, list(struct_pack(id := id, apex := apex, l := l, r := r) ORDER BY apex, id) AS m, list(id ORDER BY r - l DESC, apex, id)[1] AS wid, list(apex ORDER BY r - l DESC, apex, id)[1] AS wapex,
        min(l) AS low, max(r) AS high FROM c GROUP BY 1, 2),
      h AS (SELECT *, len(m) AS n, list_sort([m[1].l, m[1].r, m[2].l, m[2].r]) AS s FROM g),
      o AS (SELECT l_suppkey, m[1].id AS id, m[1].apex AS apex, m[1].l AS left_base, m[1].r AS right_base FROM h WHERE n = 1 UNION ALL SELECT l_suppkey, wid, wapex, low, high FROM h WHERE n > 2
        UNION ALL SELECT l_suppkey, m[1].id, CASE WHEN s[1] < m[1].apex AND m[1].apex < s[2] THEN m[1].apex ELSE CAST(trunc((s[1] + s[2]) / 2e0) AS BIGINT) END, s[1], s[2] FROM h WHERE n = 2
        UNION ALL SELECT l_suppkey, m[2].id, CASE WHEN s[3] < m[2].apex AND m[2].apex < s[4] THEN m[2].apex ELSE CAST(trunc((s[3] + s[4]) / 2e0) AS BIGINT) END, s[3], s[4] FROM h WHERE n = 2)
      SELECT * FROM o""",
    "compound_features": """WITH b AS (SELECT l_suppkey, l_partkey, CASE WHEN count(*) OVER (PARTITION BY l_partkey) = 1 THEN 'singleton' ELSE l_returnflag END AS l_returnflag FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_discount DESC, l_suppkey, lineitem.l_returnflag) = 1)
      SELECT l_suppkey, l_partkey, l_returnflag FROM b QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey DESC, l_returnflag DESC) = 1""",
    "same_time_pairs": f"""WITH {POINTS}, t AS (SELECT track, arg_max(scan, intensity * 100000 - scan) AS apex FROM points GROUP BY 1)
      SELECT a.track AS left_track, b.track AS right_track FROM t a JOIN t b ON b.track = a.track + 1 WHERE abs(a.apex - b.apex) < 36""",
    "upserted": "SELECT coalesce(c_custkey, s_suppkey) AS c_custkey, coalesce(s_acctbal, c_acctbal) AS c_acctbal FROM customer FULL JOIN supplier ON c_custkey = s_suppkey",
    "calibrated_mz": """SELECT p_partkey, round(CASE WHEN abs((p_size - 25.5e0) * 1e-7) > 2e-6 THEN p_retailprice / (1 + (p_size - 25.5e0) * 1e-7) ELSE p_retailprice END, 6) AS mz FROM part""",
    "least_height": "WITH m AS (SELECT min(l_extendedprice) AS m FROM lineitem GROUP BY l_suppkey) SELECT greatest(floor(median(m) * 0.5e0), 100e0) AS least_height FROM m",
    "track_selectivity": f"""WITH {REGIONS}, k AS (SELECT * FROM regions WHERE n_scans > 1 AND height > 1000), s AS (SELECT track, scan, sum(intensity) AS x FROM points GROUP BY 1, 2),
      i AS (SELECT s.*, EXISTS (SELECT 1 FROM k WHERE k.track = s.track AND s.scan BETWEEN left_base AND right_base) AS inside FROM s)
      SELECT k.track, left_base, round(count(*) FILTER (inside) / CAST(count(*) AS DOUBLE), 8) AS selectivity FROM k JOIN i ON i.track = k.track AND x > height * 0.5e0 GROUP BY k.track, left_base""",
    "roi_islands": f"WITH {REGIONS} SELECT * FROM regions",
    "feature_table": f"WITH {REGIONS} SELECT 'F' || track || '_' || region AS id_number, left_base, right_base, apex, height, peak_area, n_scans FROM regions WHERE n_scans > 1 AND height > 1000",
    "mz_selectivity": """WITH p AS (SELECT DISTINCT p_retailprice AS mz FROM part),
      d AS (SELECT mz, 1e6 * (mz - lag(mz) OVER w) / lag(mz) OVER w AS a, 1e6 * (mz - lag(mz, 2) OVER w) / lag(mz, 2) OVER w AS b,
        1e6 * (lead(mz) OVER w - mz) / mz AS c, 1e6 * (lead(mz, 2) OVER w - mz) / mz AS d FROM p WINDOW w AS (ORDER BY mz)),
      f AS (SELECT mz, coalesce(CASE WHEN a > 100 THEN 1e0 WHEN a < 0.1e0 THEN 0e0 ELSE 1e0 - exp(-a / 5e0) END, 1e0) * 1e0 AS fa, b, c, d, a FROM d)
      SELECT mz, round((CASE WHEN a IS NULL OR a > 100 THEN 1e0 WHEN a < 0.1e0 THEN 0e0 ELSE 1e0 - exp(-a / 5e0) END) * (CASE WHEN b IS NULL OR b > 100 THEN 1e0 WHEN b < 0.1e0 THEN 0e0 ELSE 1e0 - exp(-b / 5e0) END)
        * (CASE WHEN c IS NULL OR c > 100 THEN 1e0 WHEN c < 0.1e0 THEN 0e0 ELSE 1e0 - exp(-c / 5e0) END) * (CASE WHEN d IS NULL OR d > 100 THEN 1e0 WHEN d < 0.1e0 THEN 0e0 ELSE 1e0 - exp(-d / 5e0) END), 8) AS selectivity FROM f""",
    "paired_mapping": """WITH u AS (SELECT c_acctbal AS v, 1 AS side, c_custkey AS k FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_acctbal, 2, s_suppkey FROM supplier WHERE s_acctbal > 0),
      n AS (SELECT *, lag(v) OVER w AS pv, lag(side) OVER w AS ps, lag(k) OVER w AS pk, lead(v) OVER w AS nv FROM u WINDOW w AS (ORDER BY v, side, k)),
      f AS (SELECT * FROM n WHERE side <> ps AND v - pv < v * (300e0 * 1e-6) AND coalesce(nv, 999999e0) - v > v * (300e0 * 1e-6))
      SELECT CASE WHEN side = 2 THEN pk ELSE k END AS left_key, CASE WHEN side = 2 THEN k ELSE pk END AS right_key, CASE WHEN side = 2 THEN pv ELSE v END AS left_value, CASE WHEN side = 2 THEN v ELSE pv END AS right_value FROM f""",
    "band_join_all": "SELECT p_partkey, c_custkey FROM part JOIN customer ON c_acctbal > 0 AND abs(p_retailprice - c_acctbal) < p_retailprice * (50e0 * 1e-6)",
    "match_features": f"WITH {PAIRS} SELECT left_id, right_id FROM pairs",
    "mutual_best_match": f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY apart, right_id) AS x, row_number() OVER (PARTITION BY right_id ORDER BY apart, left_id) AS y FROM pairs)
      SELECT left_id, right_id, apart FROM r WHERE x = 1 AND y = 1""",
    "nearest_pairs": """WITH p AS (SELECT p_partkey AS k, CAST(floor(p_retailprice * 100 + 0.5e0) AS BIGINT) AS v FROM part),
      j AS (SELECT a.k AS left_key, b.k AS right_key, row_number() OVER (PARTITION BY a.k ORDER BY abs(a.v + 100 - b.v), b.k) AS r FROM p a JOIN p b ON abs(a.v + 100 - b.v) < 20)
      SELECT left_key, right_key FROM j WHERE r = 1""",
    "mz_islands": """WITH c AS (SELECT CAST(floor(l_extendedprice) AS BIGINT) AS key FROM lineitem GROUP BY 1 HAVING count(*) >= 2),
      g AS (SELECT key, key - lag(key) OVER (ORDER BY key) AS gap FROM c),
      i AS (SELECT key, sum(CASE WHEN gap IS NULL OR gap = 1 OR gap < key * (5e0 * 1e-6) THEN 0 ELSE 1 END) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) AS bin FROM g)
      SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem JOIN i ON key = CAST(floor(l_extendedprice) AS BIGINT) GROUP BY 1""",
    "consensus_mz": f"WITH {POINTS} SELECT track, round(0.5e0 * (median(value) + arg_max(value, intensity * 10000000 - event_id)), 6) AS mz, max(intensity) AS height, count(*) AS n_points FROM points GROUP BY track",
    "composite_sum": f"WITH {POINTS} SELECT track, scan, CAST(sum(intensity) AS BIGINT) AS intensity FROM points GROUP BY 1, 2",
    "area_sum_auc": f"""WITH {POINTS}, m AS (SELECT *, greatest(intensity, coalesce(lag(intensity) OVER (PARTITION BY track ORDER BY scan, event_id), 0)) AS m FROM points)
      SELECT track, CAST(sum(intensity) AS BIGINT) AS area_sum, CAST(sum(m) AS BIGINT) AS area_auc FROM m GROUP BY track""",
    "moving_mean_clamped": """WITH c AS (SELECT o_orderpriority, CAST(floor(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) / 30e0) AS BIGINT) AS m, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2),
      r AS (SELECT o_orderpriority, n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS k FROM c),
      w AS (SELECT r.o_orderpriority, r.i, greatest(0, least(r.k - 1, r.i - 4 + o.d)) AS j FROM r, (SELECT unnest(range(9)) AS d) o)
      SELECT w.o_orderpriority, w.i, round(sum(r.n) / 9e0, 6) AS mean FROM w JOIN r ON r.o_orderpriority = w.o_orderpriority AND r.i = w.j GROUP BY 1, 2""",
    "noise_baseline": f"""WITH {POINTS}, q AS (SELECT track, quantile_cont(intensity, 0.25) AS q FROM points GROUP BY track)
      SELECT p.track, round(avg(intensity), 4) AS baseline, round(stddev_pop(intensity), 4) AS noise FROM points p JOIN q ON p.track = q.track WHERE intensity < q + 500 GROUP BY p.track""",
    "detrend": f"""WITH {_DAILY}, l AS (SELECT event_type, regr_slope(total, day) AS s, regr_intercept(total, day) AS c FROM daily GROUP BY 1)
      SELECT d.event_type, day, round(total - s * day - c, 3) AS residual FROM daily d JOIN l ON d.event_type = l.event_type""",
    "quality_filter": """WITH w AS (SELECT l_orderkey, coalesce(CAST(sum(trunc(l_quantity)) FILTER (l_returnflag = 'A') AS BIGINT), 0) AS sample_a, coalesce(CAST(sum(trunc(l_quantity)) FILTER (l_returnflag = 'N') AS BIGINT), 0) AS sample_n,
      coalesce(CAST(sum(trunc(l_quantity)) FILTER (l_returnflag = 'R') AS BIGINT), 0) AS sample_r FROM lineitem GROUP BY 1)
      SELECT *, CAST(sample_a > 1 AS INT) + CAST(sample_n > 1 AS INT) + CAST(sample_r > 1 AS INT) AS detection_counts FROM w WHERE CAST(sample_a > 1 AS INT) + CAST(sample_n > 1 AS INT) + CAST(sample_r > 1 AS INT) >= 2""",
    "top_n_peaks": "SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS INT) AS rank FROM lineitem QUALIFY rank <= 3",
    "jaccard_samples": """WITH s AS (SELECT DISTINCT l_suppkey % 20 AS sample, l_partkey FROM lineitem), n AS (SELECT sample, count(*) AS n FROM s GROUP BY 1),
      j AS (SELECT x.sample AS a, y.sample AS b, count(*) AS k FROM s x JOIN s y ON x.l_partkey = y.l_partkey AND x.sample < y.sample GROUP BY 1, 2)
      SELECT a, b, round(k / CAST(p.n + q.n - k AS DOUBLE), 8) AS jaccard FROM j JOIN n p ON p.sample = a JOIN n q ON q.sample = b""",
    "pairwise_corr": f"WITH {_DAILY} SELECT x.event_type AS a, y.event_type AS b, round(corr(x.total, y.total), 6) AS r FROM daily x JOIN daily y ON x.day = y.day AND x.event_type < y.event_type GROUP BY 1, 2",
    "coelution_clusters": f"""WITH {POINTS}, m AS (SELECT event_id, track, scan, CASE WHEN scan - lag(scan) OVER w >= 2 THEN 1 ELSE 0 END AS fresh FROM points WINDOW w AS (PARTITION BY track ORDER BY scan, event_id)),
      r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY track ORDER BY scan, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM m),
      c AS (SELECT event_id, track, cluster, count(*) OVER (PARTITION BY track, cluster) AS size FROM r) SELECT * FROM c WHERE size > 1""",
    "interp_clamped": f"WITH {POINTS} SELECT event_id, round({_knots_sql()}, 6) AS index FROM points",
    "tic": f"WITH {POINTS} SELECT scan, CAST(sum(intensity) AS BIGINT) AS tic, max(intensity) AS base_peak FROM points GROUP BY scan",
    "orphans": "SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "close_pairs": """WITH o AS (SELECT o_orderkey, o_totalprice AS mz, lag(o_orderkey) OVER w AS before, lag(o_totalprice) OVER w AS p FROM orders WINDOW w AS (ORDER BY o_totalprice, o_orderkey))
      SELECT o_orderkey, before FROM o WHERE mz - p < mz * (5e0 * 1e-6)""",
    "compact_tracks": f"""WITH {POINTS}, s AS (SELECT *, scan - lag(scan, 4) OVER (PARTITION BY track ORDER BY scan) AS span FROM points)
      SELECT track, count(*) AS n FROM s GROUP BY track HAVING max(intensity) >= 5000 AND (count(*) >= 20 OR min(span) <= 64)""",
    "extract_targets": """SELECT p_partkey, c_custkey, round((c_acctbal - p_retailprice) / p_retailprice * 1e6, 4) AS ppm_error FROM part LEFT JOIN customer
      ON c_acctbal > 0 AND abs(p_retailprice - c_acctbal) < p_retailprice * (100e0 * 1e-6)""",
    "annotate_ions": f"""WITH i AS (SELECT p_partkey, ion, p_retailprice + proton + d AS ion_mz FROM part, (VALUES {_ion_values()}) t(ion, proton, d))
      SELECT c_custkey, p_partkey, ion, round((c_acctbal - ion_mz) / ion_mz * 1e6, 4) AS ppm_error FROM customer JOIN i
      ON c_acctbal > 0 AND ion_mz > c_acctbal - c_acctbal * (20e0 * 1e-6) AND ion_mz <= c_acctbal + c_acctbal * (20e0 * 1e-6)""",
    "nearest_track": """WITH p AS (SELECT p_partkey, CAST(floor(p_retailprice * 100 + 0.5e0) AS BIGINT) AS v FROM part), s AS (SELECT s_suppkey, CAST(floor(s_acctbal * 100 + 0.5e0) AS BIGINT) AS v FROM supplier),
      j AS (SELECT p_partkey, s_suppkey, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p.v - s.v), s_suppkey) AS r FROM p JOIN s ON abs(p.v - s.v) < 2000) SELECT p_partkey, s_suppkey FROM j WHERE r = 1""",
    "index_window": "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) < 2e0",
    "spike_ins": f"SELECT p_partkey, target FROM part JOIN (VALUES {', '.join(f"('{n}', {m!r}e0)" for n, m in SPIKES)}) t(target, m) ON p_size > 10 AND abs(p_retailprice - m) < 5e0",
    "best_spectrum": """WITH s AS (SELECT o_custkey, l_orderkey, CAST(sum(floor(l_quantity)) AS BIGINT) AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
      SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY total DESC, l_orderkey) = 1""",
    "richest_spectra": """WITH s AS (SELECT o_custkey, l_orderkey, CAST(count(*) AS INT) AS n_peaks FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
      SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n_peaks DESC, l_orderkey) <= 2""",
    "base_peaks": """WITH m AS (SELECT l_orderkey, l_linenumber, floor(l_quantity) AS q, max(floor(l_quantity)) OVER (PARTITION BY l_orderkey) AS top FROM lineitem)
      SELECT l_orderkey, CAST(min(l_linenumber) FILTER (q = top) AS INT) AS base, count(*) FILTER (q >= top * 0.5e0) AS n_high FROM m GROUP BY 1""",
    "html_escaped": """WITH e AS (SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS x FROM pages)
      SELECT page_id, md5(x) AS digest, length(x) AS n_chars FROM e""",
    "safe_filenames": r"""SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '[. ]+$', '') AS name FROM pages""",
    "human_sizes": """WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice * 1000) AS BIGINT) AS n FROM orders)
      SELECT o_orderkey, CASE WHEN n < 1024 THEN printf('%.1fB', n / 1e0) WHEN n < 1048576 THEN printf('%.1fKiB', n / 1024e0) WHEN n < 1073741824 THEN printf('%.1fMiB', n / 1048576e0) ELSE printf('%.1fGiB', n / 1073741824e0) END AS size FROM n""",
    "theoretical_ions": f"SELECT p_partkey, ion, round(p_retailprice + proton + d, 5) AS ion_mz FROM part, (VALUES {_ion_values()}) t(ion, proton, d)",
}

QUERIES = {
    f.__name__: f
    for f in (
        feature_table, roi_islands, mz_selectivity, paired_mapping, band_join_all, match_features, mutual_best_match, nearest_pairs, mz_islands, consensus_mz, composite_sum,
        area_sum_auc, moving_mean_clamped, noise_baseline, detrend, quality_filter, top_n_peaks, jaccard_samples, pairwise_corr, coelution_clusters, interp_clamped, lib_cosine, detect_peaks, tic, orphans, theoretical_ions,
        close_pairs, compact_tracks, extract_targets, annotate_ions, nearest_track, index_window, spike_ins, best_spectrum, richest_spectra, base_peaks, html_escaped, safe_filenames, human_sizes,
        complete_mapping, merge_tables, mass_splits, spectrum_scores,
        match_counts, retention_index, distilled_features, penalised_neighbours, untangled_peaks, compound_features, same_time_pairs, upserted, calibrated_mz, least_height, track_selectivity, sample_tree,
        judged_peaks,
    )
}
