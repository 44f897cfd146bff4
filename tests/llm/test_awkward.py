"""Cases that once went wrong: large ids beside nulls, copies and mirrors, deep pages, ties."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from spectraflow.llm import html_extract, media, mixing, packing, sharding, simhash, token_codes, toxicity
from spectraflow.llm.encoding import Encoder, public_path

BYTE, WORD = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")
LARGE = 2**53 + 1
IDS = [LARGE, LARGE + 2, None, 5, -(2**62) - 1]


def test_large_ids_beside_nulls(spark):
    """Every operator that runs Python gives back the very ids, with a null in the same batch."""
    docs = spark.createDataFrame([(i, f"text number {i} of a few words") for i in IDS], "doc_id long, text string").coalesce(1)
    marks = spark.createDataFrame([(LARGE, 1, 0)], "doc_id long, quality int, toxic int")
    key = lambda ids: sorted(ids, key=lambda i: (i is None, i or 0))
    for result in (
        packing.pack_documents(docs, BYTE), token_codes.encode_documents(docs, WORD), media.media_columns(docs), simhash.near_duplicates(docs),
        simhash.verified_duplicates(docs), toxicity.detect(docs, marks),
    ):
        assert key(r["doc_id"] for r in result.collect()) == key(IDS)


def test_one_of_each_goes_by_text_too(spark):
    a, b = "one two three four five six seven", "quite another text with words of its own here"
    docs = spark.createDataFrame([(1, a), (3, a), (3, b)], "doc_id long, text string")
    for verified in (False, True):
        assert sorted(tuple(r) for r in simhash.one_of_each(docs, verified).collect()) == [(1, a), (3, b)]


def test_rows_of_one_id_are_placed_alike_in_every_run(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text {i}", "s") for i in range(300)], "doc_id long, text string, source string")
    for run in (lambda d: sharding.assign(d).collect(), lambda d: [r.asDict() | {"occurrences": str(r["occurrences"])} for r in mixing.plan(d).collect()]):
        one, two = ({r["text"]: (dict(r.asDict()) if hasattr(r, "asDict") else r) for r in run(docs.repartition(n))} for n in (2, 7))
        assert one == two
    assert Counter(r["size"] for r in mixing.plan(docs).collect()) == {2: 300}


def test_sharding_is_the_plain_one(spark):
    rng = random.Random(1)
    rows = [(i, f"t{rng.randint(0, 99)}", rng.choice(["a", "a", "b", None])) for i in range(500)]
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, source string"), 24).collect()}
    digest = {d: hashlib.md5(f"shard:{d}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest() for d, t, _ in rows}
    strata = defaultdict(list)
    for d, _, s in rows:
        strata["null" if s is None else "=" + s].append(d)
    order = sorted(((k + 0.5) / len(ids), s, digest[d], d) for s, ids in strata.items() for k, d in enumerate(sorted(ids, key=lambda d: digest[d])))
    want, used = {}, Counter()
    for place, (*_, d) in enumerate(order):
        shard = place * 24 // len(order)
        want[d] = (shard, used[shard])
        used[shard] += 1
    assert got == want


def test_packing_needs_fewer_sequences_than_best_fit(spark):
    rng = random.Random(6)
    lengths = [rng.randint(260, 620) for _ in range(1500)]
    pieces = spark.createDataFrame([(i, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, length long, salt long")
    got = packing.pack(pieces).collect()
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and sorted(r["length"] for r in got) == sorted(lengths)
    assert packing.least_bins(lengths, 1024) <= len(fill) < len(packing.best_fit(lengths, 1024))


def test_encoder_on_generated_strings():
    rng = random.Random(3)
    alphabet = list("abcABCéÉßñõŽ 012'.,;:!?-_()“”…\n\t") + ["  ", " \n", "'s", "'ll", "ª", "\u00ad", "\u200b", "漢", "ж", "\x1c", "\u00a0", "İ"]
    for path in (BYTE, WORD):
        own = Encoder(path)
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25)))
            assert own.encode(text) == own.whole(text), repr(text)


def test_words_alike_in_their_beginning_are_apart():
    long = "a" * 64
    assert toxicity.features(long + "x", ()) != toxicity.features(long + "y", ())


def test_ordinal_fit_is_the_plain_one():
    """Gradients against finite differences of the plain likelihood; the fit is near the optimum of the same loss."""
    rng = np.random.default_rng(2)
    n, k = 60, 5
    x = rng.random((n, k)) < 0.4
    at, col = np.nonzero(x)
    grade = rng.integers(0, 3, n)

    def loss(w, theta):
        cut = np.concatenate([[-np.inf], theta, [np.inf]])
        sigmoid = lambda z: 1 / (1 + np.exp(-z))
        s = x @ w
        return -np.mean(np.log(sigmoid(cut[grade + 1] - s) - sigmoid(cut[grade] - s)))

    w, theta, h = rng.normal(size=k), np.array([-0.3, 0.9]), 1e-6
    g_w, g_theta = toxicity.gradients(w, theta, at, col, grade)
    for i in range(k):
        assert abs(g_w[i] - (loss(w + h * np.eye(k)[i], theta) - loss(w - h * np.eye(k)[i], theta)) / (2 * h)) < 1e-6
    for i in range(2):
        assert abs(g_theta[i] - (loss(w, theta + h * np.eye(2)[i]) - loss(w, theta - h * np.eye(2)[i])) / (2 * h)) < 1e-6


def test_template_is_found_by_recurrence_alone(spark):
    """Hosts without telling elements or names: only counting can find the template; against a plain count."""
    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do"]) + str(rng.randint(0, 999)) for _ in range(n))
    pages, want, page = [], {}, 0
    for site in ("a.example", "b.example"):
        top, side, foot = (f"<div><ul><li>{words(3)}</li><li>{words(2)}</li></ul></div>" for _ in range(3))
        for i in range(40):
            body = [words(30) for _ in range(3)]
            html = f"<div>{top}<div><h2>{words(3)}</h2>" + "".join(f"<p>{b}</p>" for b in body) + f"</div>{side if i % 3 else ''}{foot}</div>"
            title = html.split("<h2>")[1].split("</h2>")[0]
            pages.append((page, f"http://{site}/{i}", html))
            want[page] = "\n".join([title, *body])
            page += 1
        rare = f"<div><p>{words(6)}</p></div>"  # on fewer pages than make a template
        for i in range(5):
            body = words(20)
            pages.append((page, f"http://{site}/r{i}", f"<div>{rare}<div><p>{body}</p></div></div>"))
            want[page] = rare[8:-10] + "\n" + body
            page += 1
    mirrored = f"<div><div><p>{words(40)}</p></div><div><p>{words(5)}</p></div></div>"
    for i in range(30):  # one text under many addresses, and one row many times
        pages.append((page, "http://m.example/" + ("same" if i < 15 else str(i)), mirrored))
        want[page] = "\n".join(x.split("</p>")[0] for x in mirrored.split("<p>")[1:])
        page += 1
    shared = f"<div><p>{words(8)}</p></div>"
    for i in range(12):  # unrelated pages without a host
        body = words(20)
        pages.append((page, None, f"<div>{shared}<div><p>{body}</p></div></div>"))
        want[page] = shared[8:-10] + "\n" + body
        page += 1
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    assert {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()} == want


def test_deep_pages():
    """Elements nested deeper than any recursion limit: a menu inside is left out, text inside is kept."""
    html = "<div>" * 5000 + "<nav><ul><li>Menu</li></ul></nav><p>Deep text" + "</div>" * 5000 + "<p>After"
    assert [line for line, _ in html_extract.blocks_of(html_extract.parse(html))] == ["Deep text", "After"]


def test_media_tables_are_packed(spark):
    """Hex digests are half entropy, and payloads are compressed as zlib does by default."""
    import zlib

    import pyarrow.parquet as pq

    from spectraflow.llm import media

    samples = media.payload("a rather plain text, with words and more words of it, again and again " * 9)[1]
    rows = b"".join(b"\0" + samples[k : k + media.WIDTH] for k in range(0, len(samples), media.WIDTH))
    assert zlib.compress(rows, 6) in media.to_png(samples) and media.from_png(media.to_png(samples)) == samples
    stored = media.store(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), media.fresh_dir(spark, "media"))
    found = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in stored.inputFiles()]
    assert {m.row_group(0).column(0).compression for m in found if m.num_rows} == {"ZSTD"}
