"""The pipeline against plain stages, on a small table whose toxic, poor and copied texts are planted."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from spectraflow.llm import mixing, packing, quality, simhash, toxicity
from spectraflow.llm.encoding import public_path

BYTE = public_path("byte_bpe_50k.json")


def test_run(spark, tmp_path):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)] + ["the", "of", "and", "to", "in"] * 12
    draw = lambda: [rng.choice(vocabulary) for _ in range(200)]

    def edited(words, n):
        out = list(words)
        for k in rng.sample(range(len(out)), n):
            out[k] = rng.choice(vocabulary)
        return out

    plain = [draw() for _ in range(240)]
    near, similar = [edited(t, 2) for t in plain[:60]], [edited(t, 10) for t in plain[60:180]]
    toxic = []
    for _ in range(80):
        words = draw()
        for k in rng.sample(range(200), 6):
            words[k] = rng.choice(["vilewordx", "vilewordy"])
        toxic.append(words)
    poor = [["spam", "###"] * rng.randint(40, 60) for _ in range(40)] + [draw()[:4] for _ in range(20)]
    texts = [(" ".join(t), kind) for kind, part in (("good", plain), ("good", near), ("good", similar), ("good", plain[200:220]), ("toxic", toxic), ("poor", poor)) for t in part]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, (t, _) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(kind != "poor"), int(kind == "toxic")) for i, (_, kind) in enumerate(texts) if i % 4]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    good = [i for i, (_, kind) in enumerate(texts) if kind == "good"]
    fps = dict(zip(good, simhash.fingerprints([texts[i][0] for i in good])))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i in good for w in [texts[i][0].split()]}
    root, apart = {i: i for i in good}, 0
    for i in good:
        for j in good:
            if i < j and np.bitwise_count(fps[i] ^ fps[j]) <= 12:
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    a, b = sorted((root[i], root[j]))
                    root = {k: a if r == b else r for k, r in root.items()}
                else:
                    apart += 1
    left = [r for r in rows if root.get(r[0]) == r[0]]
    assert apart > 40 and len(left) < len(good) - 60  # unlike candidates stay, copies go
    documents = spark.createDataFrame(left, "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter(r["doc_id"] for r in mixing.mix(documents).collect())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == want
    assert all(len(r["ids"]) == r["length"] and r["ids"][-1] == 2 for r in got)


CLASHES = "severity grade toxic kept quality votes n_words size source_size target taken occurrences segments model shard slot sequence_id offset position key fp hash component_id host blocks".split()


def test_stages_take_awkward_tables(spark):
    """Nulls, empty and repeated rows, empty tables, and columns named like the operators' own."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)] + ["the", "of"] * 20
    texts = [". ".join(" ".join(rng.choice(vocabulary) for _ in range(9)) for _ in range(12)) for _ in range(40)] + [None, "", " "]
    big = 2**53 + 1
    rows = [(big + 2 * i, t, None if i % 5 == 0 else "ab"[i % 2], *[f"own {i}"] * len(CLASHES)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[0], None, *[None] * len(CLASHES)), (None, None, None, *[None] * len(CLASHES))]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema).repartition(3)
    labels = spark.createDataFrame([(big, 1, 0)], "doc_id long, quality int, toxic int")
    known = Counter(rows)
    for table, n in ((docs, len(rows)), (docs.limit(0), 0)):
        for name, result in (
            ("toxicity", toxicity.clean(table, labels)), ("quality", quality.good(table)), ("near_duplicates", corpus_pipeline.distinct(spark, table, "")), ("mixing", mixing.mix(table)),
        ):
            got = [tuple(r) for r in result.collect()]
            assert result.columns == docs.columns and set(got) <= set(known), name
            if name in ("toxicity", "near_duplicates"):
                assert not Counter(got) - known and len(got) >= n - (1 + 2 * (name == "near_duplicates")), name
            elif n:
                assert len(got) >= 40, name
    assert {r["severity"] for r in toxicity.clean(docs, labels).collect()} > {"own 3"}


def test_packing_keeps_the_written_order(spark, tmp_path):
    spark.createDataFrame([(i, f"w{i} " * 30) for i in range(3000)], "doc_id long, text string").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    placed = {r["doc_id"]: r["__position"] for r in packing.written_order(docs).collect()}
    assert placed == {i: i for i in range(3000)}
    pieces = packing.cut(packing.written_order(docs), BYTE, position="__position")
    got = packing.pack(pieces, group_rows=500, position="position").collect()
    assert len(got) == 3000
    for r in got:
        assert r["sequence_id"] >> 40 == r["doc_id"] // 500
