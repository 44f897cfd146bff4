"""Near-duplicates by SimHash and vantage-point trees.

Fingerprints at most ``radius`` bits apart are linked. The 64 bits are split
into bands; two linked fingerprints differ in at most radius // bands bits of
some band. Each band has a vantage-point tree over all distinct fingerprints:
its leaves are shards, a fingerprint is stored in one, and is looked for in
every shard that the triangle bound doesn't rule out, so across boundaries too.
Inside a shard a further tree of the same kind narrows down to small cells,
where the whole fingerprints are compared. A shard reports the links as a
spanning forest, so groups of any size give linear output.

A wide radius leaves no band nearly equal, and its exact search would compare
a fixed share of all pairs. There, further trees over random sets of bits take
the bands' place: texts that agree in one set meet in its tree. ``tree_plan``
gives more bits and more trees to more texts.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraflow.llm.common import batch_of, discard, materialise

#: Most fingerprints from which the trees are shaped (every one is then put into them), fingerprints planned for a shard, most
#: that one task gets from a side, most compared as one cell.
SAMPLE, TARGET, SHARD, CELL, DEPTH = 1_000_000, 8_000, 100_000, 512, 40
#: Least Jaccard similarity of two texts' five-word shingles where links are verified, as a fraction.
ALIKE = (4, 5)


def fingerprints(texts: list[str | None], size: int = 3, seed: int = 42, block: int = 100_000) -> np.ndarray:
    """64-bit SimHash of each text's word shingles, repeats included; 0 without words.

    A-Z in lower case, words split at ASCII white space, XXH64 of each shingle;
    a bit is set if it is in over half of them.
    """
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    hashes: list[int] = []
    ends: list[int] = []
    rows: list[int] = []
    weights = (np.uint64(1) << np.arange(64, dtype=np.uint64))

    def bits(values: np.ndarray) -> np.ndarray:
        return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")

    def flush() -> None:
        if not rows:
            return
        values, starts = np.array(hashes, dtype="<u8"), [0, *ends[:-1]]
        ones = np.add.reduceat(bits(values), starts, axis=0, dtype=np.int64)
        counts = np.diff([0, *ends])
        out[rows] = ((2 * ones > counts[:, None]) * weights).sum(axis=1, dtype=np.uint64)
        hashes.clear(), ends.clear(), rows.clear()

    for row, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        shingles = [b" ".join(s) for s in zip(*(words[k:] for k in range(size)))] if len(words) >= size else [b" ".join(words)]
        if len(shingles) > block:  # a very long text: its bits are counted in parts
            ones = np.zeros(64, dtype=np.int64)
            for at in range(0, len(shingles), block):
                ones += bits(np.array([xxh64_intdigest(s, seed) for s in shingles[at : at + block]], dtype="<u8")).sum(axis=0, dtype=np.int64)
            out[row] = ((2 * ones > len(shingles)) * weights).sum(dtype=np.uint64)
            continue
        hashes.extend([xxh64_intdigest(s, seed) for s in shingles])
        ends.append(len(hashes))
        rows.append(row)
        if len(hashes) > block:
            flush()
    flush()
    return out


def with_fingerprint(documents: DataFrame) -> DataFrame:
    """doc_id, ``hash`` (of the text) and ``fp`` (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints(batch.column("text").to_pylist()).view(np.int64)
            yield batch_of(["doc_id", "hash", "fp"], [batch.column("doc_id"), batch.column("hash"), (found, pa.int64())])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(run, "doc_id long, hash long, fp long")


def band_masks(bands: int) -> list[int]:
    """Disjoint bit masks of nearly equal width that cover 64 bits."""
    edges = [64 * k // bands for k in range(bands + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def random_masks(trees: int, bits: int, seed: int = 11) -> list[int]:
    """``trees`` bit masks of ``bits`` of the 64 bits each."""
    rng = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(trees)]


def tree_plan(n: int, radius: int, miss: float = 0.03) -> tuple[int, int]:
    """(trees, bits) with which a pair ``radius`` bits apart is missed with a chance of ``miss`` at most.

    Values that agree in ``bits`` bits are compared, 10 for up to 2 ** 18
    texts. Beyond, comparisons grow by N * N / 2 ** bits a tree and rows sent by
    the number of trees; a bit more per fourfold N shares out the growth.
    """
    bits = 10 + max(0, math.ceil((math.log2(max(n, 1)) - 18) / 2))
    meet = math.comb(64 - radius, bits) / math.comb(64, bits)
    return math.ceil(math.log(miss) / math.log(1 - meet)), bits


def _distance(values: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(values ^ np.uint64(point)).astype(np.int64)


def build_tree(values: np.ndarray, leaf: int, rng: np.random.Generator, depth: int = DEPTH):
    """[vantage point, radius, inner, outer] down to None where at most ``leaf`` values, or only equal ones, are left.

    The vantage point is the one of a few whose distances spread most; the
    radius is a value of those distances that splits them best.
    """
    if len(values) <= leaf or depth == 0:
        return None
    tried = rng.choice(values, size=min(5, len(values)), replace=False)
    distances = [_distance(values, int(p)) for p in tried]
    best = max(range(len(tried)), key=lambda k: distances[k].var())
    d = distances[best]
    if d.max() == d.min():
        others = np.unique(values)
        if len(others) == 1:
            return None
        tried, d = others[:1], _distance(values, int(others[0]))
        best = 0
    mu = int(np.median(d))
    if mu >= d.max():
        mu = int(d.max()) - 1
    inner = d <= mu
    return [int(tried[best]), mu, build_tree(values[inner], leaf, rng, depth - 1), build_tree(values[~inner], leaf, rng, depth - 1)]


def route(tree, values: np.ndarray, reach: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(leaf, positions stored there, positions that must be looked for there) of all leaves that any value reaches.

    With d the distance to the vantage point, a value within ``reach`` of
    another on the inner side (d <= mu) has d - reach <= mu, and on the outer
    side d + reach > mu: elsewhere the branch is pruned.
    """
    stack = [(tree, "", np.arange(len(values)), np.ones(len(values), dtype=bool))]
    while stack:
        node, name, at, home = stack.pop()
        if not len(at):
            continue
        if node is None:
            yield name, at[home], at
            continue
        point, mu, inner, outer = node
        d = _distance(values[at], point)
        go = d - reach <= mu
        stack.append((inner, name + "0", at[go], (home & (d <= mu))[go]))
        go = d + reach > mu
        stack.append((outer, name + "1", at[go], (home & (d > mu))[go]))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Each of n nodes' smallest linked node, by links a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Positions of links a - b among n nodes that connect all that the links connect; every component picks its first link outwards, until none is left."""
    label, at, picked = np.arange(n), np.arange(len(a)), [np.zeros(0, dtype=np.int64)]
    while True:
        at = at[label[a[at]] != label[b[at]]]
        if not len(at):
            return np.unique(np.concatenate(picked))
        ends = np.concatenate([label[a[at]], label[b[at]]])
        chosen = at[np.unique(np.unique(ends, return_index=True)[1] % len(at))]
        picked.append(chosen)
        label = forest(label[a[chosen]], label[b[chosen]], n)[label]


def shard_links(values: np.ndarray, stored: np.ndarray, asks: np.ndarray, radius: int, mask: int, reach: int, cell: int = CELL) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the values that ask and those ``stored`` in this shard.

    A tree over the band's bits leads to cells, in which whole fingerprints are
    compared in blocks; each block's links are reduced to their forest at once.
    """
    rng = np.random.default_rng(len(values))
    masked = values & np.uint64(mask)
    tree = build_tree(masked, cell, rng)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for _, home, look in route(tree, masked, reach):
        home, look = home[stored[home]], look[asks[look]]
        for at in range(0, len(home), 512):
            for to in range(0, len(look), 2048):
                block, other = home[at : at + 512], look[to : to + 2048]
                a, b = np.nonzero(np.bitwise_count(values[block][:, None] ^ values[other][None, :]) <= radius)
                keep = block[a] != other[b]
                if not keep.any():
                    continue
                own, inverse = np.unique(np.concatenate([block[a[keep]], other[b[keep]]]), return_inverse=True)
                half = len(inverse) // 2
                label = forest(inverse[:half], inverse[half:], len(own))
                moved = np.flatnonzero(label != np.arange(len(own)))
                left.append(own[moved])
                right.append(own[label[moved]])
    return np.concatenate(left), np.concatenate(right)


def deal(distinct: DataFrame, radius: int, bands: int, target: int, shard: int, trees: int, bits: int, others: tuple[str, ...] = ()) -> tuple[DataFrame, list[int], int]:
    """The rows of ``distinct`` (``fp`` and the columns ``others``) as the tasks (shard, i, j) get them, each band's mask, and the reach.

    With ``trees``, each band is searched with reach 0, and so are that many
    trees over ``bits`` random bits. Links of less than ``bands`` bits are then
    sure to be found; one of d bits is missed with a chance of at most
    (1 - C(64 - bits, d) / C(64, d)) ** trees, see ``tree_plan``.

    The trees' shape comes from a sample, a sixteenth in hash order and
    ``SAMPLE`` at most; every fingerprint goes into them. Shards are planned to
    hold ``target`` fingerprints. One with more than ``shard`` is split by hash
    on both sides, and every pair of parts is a task, so none is lost and no
    task grows.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    wanted = min(SAMPLE, max(1000, n // 16))
    picked = np.array([r["fp"] for r in distinct.orderBy(F.xxhash64("fp")).limit(wanted).collect()], dtype=np.int64).view(np.uint64)
    masks, reach = band_masks(bands) + random_masks(trees, bits), 0 if trees else radius // bands
    rng = np.random.default_rng(7)
    leaf = max(16, len(picked) * target // max(n, 1))
    shapes = [build_tree(picked & np.uint64(m), leaf, rng) for m in masks]
    packed = spark.sparkContext.broadcast(json.dumps(shapes))  # SAMPLE / 16 leaves a band at most, however many documents

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = json.loads(packed.value)
        for batch in batches:
            values = batch["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            for band, (tree, mask) in enumerate(zip(own, masks)):
                out = []
                for name, home, look in route(tree, values & np.uint64(mask), reach):
                    out.append(pd.DataFrame({"shard": f"{band}:{name}", "band": np.int32(band), "fp": values[look].view(np.int64), "stored": np.isin(look, home), **{c: batch[c].to_numpy()[look] for c in others}}))
                if out:
                    yield pd.concat(out, ignore_index=True)

    kinds = "".join(f", {c} {kind}" for c, kind in distinct.dtypes if c in others)
    routed = materialise(distinct.select("fp", *others).mapInPandas(send, "shard string, band int, fp long, stored boolean" + kinds), "simhash-shards")
    sizes = routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).cast("int").alias("parts")).where("parts > 1")
    dealt = routed.join(sizes, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own, every = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("stored").alias("in_shard"), F.lit(True).alias("asks")))
    asks = F.transform(every, lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("in_shard"), F.lit(True).alias("asks")))
    holds = F.transform(F.filter(every, lambda j: F.col("stored")), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("in_shard"), F.lit(False).alias("asks")))
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("parts") == 1, one).otherwise(F.concat(asks, holds)))).select("shard", "band", "fp", *others, "to.*")
    return dealt, masks, reach


def links(distinct: DataFrame, radius: int = 2, bands: int = 3, target: int = TARGET, shard: int = SHARD, trees: int = 0, bits: int = 14) -> DataFrame:
    """Edges (a, b) that connect what links at most ``radius`` bits wide connect. ``distinct`` has one row per ``fp``; see ``deal``."""
    dealt, masks, reach = deal(distinct, radius, bands, target, shard, trees, bits)

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("fp")  # rows arrive in any order, on which the shard's tree must not depend
        values = frame["fp"].to_numpy(dtype=np.int64)
        a, b = shard_links(values.view(np.uint64), frame["in_shard"].to_numpy(dtype=bool), frame["asks"].to_numpy(dtype=bool), radius, masks[int(frame["band"].iloc[0])], reach)
        return pd.DataFrame({"a": values[a], "b": values[b]})

    return dealt.groupBy("shard", "i", "j").applyInPandas(match, "a long, b long")


def shingle_sets(texts: list[str | None], size: int = 5, seed: int = 42) -> list[np.ndarray]:
    """Each text's distinct word shingles as sorted 64-bit hashes, words as in ``fingerprints``; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    out = []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        shingles = {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
        out.append(np.unique(np.array([xxh64_intdigest(s, seed) for s in shingles], dtype="<u8")))
    return out


def parities(values: np.ndarray) -> np.ndarray:
    """512 bits: is an odd number of hashes in each class? Two sets' bits differ in at most as many places as the sets do."""
    return np.packbits((np.bincount((values & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8))


def open_pairs(frame: pd.DataFrame, radius: int, masks: list[int], every: bool, cell: int = CELL) -> tuple[np.ndarray, np.ndarray]:
    """Keys of this shard's pairs at most ``radius`` bits apart that are not in one group yet and may be alike.

    Reach is 0. Sizes and parities only rule out what can't be alike. With
    ``every``, all pairs, but one that also agrees in an earlier tree's bits is
    left to that tree; else, of each block, pairs that span what they connect.
    """
    values, key, root, size = (frame[c].to_numpy(dtype=np.int64) for c in ("fp", "key", "root", "size"))
    values, band = values.view(np.uint64), int(frame["band"].iloc[0])
    parity = np.frombuffer(b"".join(frame["parity"]), dtype=np.uint64).reshape(-1, 8)
    stored, asks = frame["in_shard"].to_numpy(dtype=bool), frame["asks"].to_numpy(dtype=bool)
    masked = values & np.uint64(masks[band])
    p, q = ALIKE
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for _, home, look in route(build_tree(masked, cell, np.random.default_rng(len(values))), masked, 0):
        home, look = home[stored[home]], look[asks[look]]
        for at in range(0, len(home), 512):
            for to in range(0, len(look), 512):
                a, b = np.nonzero(np.bitwise_count(values[home[at : at + 512]][:, None] ^ values[look[to : to + 512]][None, :]) <= radius)
                a, b = home[at : at + 512][a], look[to : to + 512][b]
                keep = (key[a] < key[b]) & (root[a] != root[b]) & (q * np.minimum(size[a], size[b]) >= p * np.maximum(size[a], size[b]))
                a, b = a[keep], b[keep]
                keep = (q + p) * np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1, dtype=np.int64) <= (q - p) * (size[a] + size[b])
                for mask in masks[:band] if every else ():
                    keep &= (values[a] ^ values[b]) & np.uint64(mask) != 0
                a, b = key[a[keep]], key[b[keep]]
                if not every and len(a):
                    own, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
                    picked = spanning(inverse[: len(a)], inverse[len(a) :], len(own))
                    a, b = a[picked], b[picked]
                left.append(a)
                right.append(b)
    return np.concatenate(left), np.concatenate(right)


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose shingle sets have a Jaccard similarity of ``ALIKE`` or more."""
    p, q = ALIKE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(q * shared >= p * (len(x) + len(y) - shared))
            yield batch.loc[np.array(good, dtype=bool), ["a", "b"]]

    sized = sets.select("key", "size")
    near = pairs.join(sized.toDF("a", "m"), "a").join(sized.toDF("b", "n"), "b").where(q * F.least("m", "n") >= p * F.greatest("m", "n")).select("a", "b")
    both = near.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    return both.mapInPandas(run, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node with an edge; root is the component's smallest node.

    Alternates large-star and small-star steps: a node's neighbours, first the
    larger and then the smaller ones, are linked to its least neighbour, until
    nothing changes. Minima are pre-aggregated, joins can be split by key, and
    every round is written to the shared folder; nothing is collected.
    """
    state = None
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    spark = now.sparkSession
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        last, now = now, materialise(small, name)
        discard(spark, last, large)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen


def near_duplicates(documents: DataFrame, radius: int = 2, bands: int = 2, trees: int = 0, bits: int = 14) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) and ``hash`` (of the text) of every row.

    By default two bands of 32 bits are searched with reach 1, so a fingerprint
    is looked for in every shard within a bit of its own.

    Texts without words have fingerprint zero and are linked like others; rows
    with a null doc_id take part, and a component of only such has a null id.
    Repeated rows and equal texts share one fingerprint, which is compared
    once. An empty table gives an empty one. Other columns aren't read.
    ``trees`` is for a wide radius, see ``links``.
    """
    marked = materialise(with_fingerprint(documents), "simhash")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(distinct, radius, bands, trees=trees, bits=bits), "simhash-components")
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "hash")


def verified_duplicates(documents: DataFrame, radius: int = 12, bands: int = 3, trees: int | None = None, bits: int = 10, first_trees: int = 6) -> DataFrame:
    """Like ``near_duplicates``, but links are only candidates: two texts are joined if their five-word shingles are alike, too.

    Shingles are made of the texts that have a link; those with one shingle set
    are one node, its ``key``. First, of the pairs that the bands and the first
    ``first_trees`` trees find and that sizes and parities don't rule out, as
    many are verified as span them. One that fails may stand for others that
    hold, so all trees are then searched for all pairs that are still in two
    groups, and these are verified as well: the groups are those of all
    candidate pairs. ``trees`` and ``bits`` come from ``tree_plan`` unless
    ``trees`` is given. Nulls, empty texts, repeated rows
    and empty tables are as in ``near_duplicates``.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("hash", F.xxhash64("text"))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        names = ["hash", "fp", "key", "size", "parity", "shingles"]
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist())
            keys = np.array([xxh64_intdigest(s.tobytes(), 42) for s in sets], dtype=np.uint64).view(np.int64)
            sizes, parity = [len(s) for s in sets], [parities(s).tobytes() for s in sets]
            yield batch_of(names, [batch.column("hash"), batch.column("fp"), (keys, pa.int64()), (sizes, pa.int32()), (parity, pa.binary()), ([s.tobytes() for s in sets], pa.binary())])

    marked = materialise(with_fingerprint(documents), "simhash")
    ident = F.coalesce("doc_id", "hash")  # one row of each text is read again
    texts = materialise(marked.groupBy("fp", "hash").agg(F.min("doc_id").alias("first_id"), F.min(ident).alias("id")), "simhash-texts")
    if trees is None:
        trees, bits = tree_plan(texts.count(), radius)
    if not trees:
        raise ValueError("open_pairs needs reach 0, so trees")
    edges = materialise(links(texts.select("fp").distinct(), radius, bands, trees=trees, bits=bits), "simhash-links")
    several = texts.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    wanted = edges.select(F.col("a").alias("fp")).unionByName(edges.select(F.col("b").alias("fp"))).unionByName(several).distinct()
    found = rows.select(ident.alias("id"), "hash", "text").join(texts.join(wanted, "fp").select("id", "hash", "fp"), ["id", "hash"])
    known = materialise(found.mapInArrow(shingle, "hash long, fp long, key long, size int, parity binary, shingles binary"), "simhash-shingles")
    keys = known.select("hash", "key").distinct()
    sets = materialise(known.dropDuplicates(["key"]).select("key", "size", "parity", "shingles"), "simhash-sets")
    members = materialise(known.select("fp", "key").distinct(), "simhash-members")

    sized = materialise(members.join(sets.select("key", "size", "parity"), "key"), "simhash-sized")
    carried = ("key", "root", "size", "parity")

    def search(nodes: DataFrame, trees: int, every: bool) -> DataFrame:
        dealt, masks, _ = deal(nodes, radius, bands, TARGET, SHARD, trees, bits, carried)

        def match(frame: pd.DataFrame) -> pd.DataFrame:
            a, b = open_pairs(frame.sort_values(["fp", "key"]), radius, masks, every)  # see links
            return pd.DataFrame({"a": a, "b": b})

        return materialise(dealt.groupBy("shard", "i", "j").applyInPandas(match, "a long, b long").distinct(), "simhash-pairs")

    sure = materialise(alike(search(sized.withColumn("root", F.col("key")), min(first_trees, trees), False), sets), "simhash-sure")
    roots = components(sure, "simhash-components")
    grouped = sized.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    pairs = search(materialise(grouped, "simhash-grouped"), trees, True)
    # groups so far take part as stars, so only the new pairs add edges
    roots = components(roots.toDF("a", "b").unionByName(alike(pairs, sets)), "simhash-components").withColumnRenamed("node", "key")
    classes = texts.join(keys, "hash", "left").join(roots, "key", "left").select("hash", "first_id", F.coalesce("root", "key", "hash").alias("root"), F.col("key").isNotNull().alias("keyed"))
    least = classes.groupBy("root", "keyed").agg(F.min("first_id").alias("component_id"))
    named = classes.join(least, ["root", "keyed"]).select("hash", "component_id")
    return marked.join(named, "hash").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "hash")


def one_of_each(documents: DataFrame, verified: bool = False, **options) -> DataFrame:
    """The documents whose doc_id is their component's; all columns, whatever their names.

    A row goes by its doc_id and text: another text under the doc_id of a copy
    stays. Rows that repeat a kept doc_id stay, null doc_ids too.
    """
    search = verified_duplicates if verified else near_duplicates
    others = search(documents, **options).where("doc_id != component_id").select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).distinct()
    return documents.join(others, (documents["doc_id"] == F.col("__id")) & (F.xxhash64(documents["text"]) == F.col("__hash")), "left_anti")
