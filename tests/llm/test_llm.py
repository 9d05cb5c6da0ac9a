"""The training-data operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from test_near import brute
from tidemark.llm import bpe, components, exact, html_text, neighbours, packing, quality, queries, repeats, secrets, simhash, util, warc

SCHEMA = "doc_id bigint, text string, kept string, n_chars bigint, same string, row int"


def docs(spark, texts):
    """texts: (doc_id, text) pairs, with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", len(t or ""), "y", 0) for i, t in texts], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


def sample_texts(n=60, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "Ande", "bre", "cat", "É", "ß", "dog,", "a", "secret=", "AKIA", "ea", "haus"]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 90))) for _ in range(n)]
    extra = [None, "", " ", "x", base[3], base[3].upper(), base[4], base[5] + " tail", "long " * 9000, "y" * 30000]
    return list(enumerate(base + extra))


def lower(text):
    return (text or "").encode().lower().decode()


def check_exact(spark, pairs):
    got = sorted(rows(exact.classify(docs(spark, pairs))), key=str)
    groups = collections.defaultdict(list)
    for i, t in pairs:
        groups[lower(t)].append(i)
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"] and r["doc_id"] in g)
        assert r["group_size"] == len(own)
        assert r["keep_id"] == max((i for i in own if i is not None), default=None)
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert all(n == 1 for n in kept.values()) and len(kept) == len(groups)
    assert len(got) == len(pairs)
    assert sorted(lower(r["text"]) for r in rows(exact.dedup(docs(spark, pairs)))) == sorted(groups)


def test_exact(spark):
    check_exact(spark, [*sample_texts(), (7, "x"), (7, "x"), (None, None), (None, "alone")])


def test_exact_lowers_ascii_only(spark):
    """Every character that has a lower case stands against it: only A-Z is the same text."""
    pairs = [(i, c) for i, c in enumerate(c for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000 for c in {chr(k), chr(k).lower()} if chr(k).lower() != chr(k))]
    got = spark.createDataFrame(pairs, "doc_id bigint, text string").select("doc_id", util.lower_ascii(F.col("text")).alias("low")).collect()
    assert {r["doc_id"]: r["low"] for r in got} == {i: lower(c) for i, c in pairs}
    check_exact(spark, list(enumerate("\U00010570 \U00010597 \u2c2f \u2c5f A a".split())))


def test_exact_hot_and_empty(spark):
    check_exact(spark, [(i, "Same Text" if i % 3 else f"own {i}") for i in range(300)])
    assert exact.classify(docs(spark, [])).count() == 0 == exact.dedup(docs(spark, [])).count()


def test_exact_verifies_identifiers(spark, monkeypatch):
    """With every chunk under one identifier the texts still come out apart."""
    monkeypatch.setattr(exact, "chunk_id", lambda c: F.struct(F.length(c).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    check_exact(spark, [(1, "abc"), (2, "abd"), (3, "ABC"), (4, "longer"), (5, "abd")])


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        off = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                off[i : i + length] = [True] * length
        kept = bytes(b for b, o in zip(d, off) if not o)
        out.append((len(d), sum(off), sum(o and not p for o, p in zip(off, [False, *off])), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(spark):
    rng = random.Random(5)
    letter = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    shared = [letter(n) for n in (199, 200, 201, 260, 420, 900)]
    texts = [None, "", "short", letter(200), "ab" * 300, "z" * 450, "z" * 201]
    for _ in range(40):
        texts.append("".join(rng.choice([letter(rng.randint(0, 300)), rng.choice(shared)]) for _ in range(rng.randint(1, 5))))
    texts += [texts[10], texts[10], texts[11], shared[1], shared[2][:-1], letter(150) + shared[4][100:330] + letter(99)]
    got = {r["doc_id"]: r for r in rows(repeats.prune(docs(spark, list(enumerate(texts)))))}
    for i, want in enumerate(brute_repeats(texts, 200)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == want[3]
    assert repeats.digest(docs(spark, [])).count() == 0


def test_repeats_in_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 500)
    rng = random.Random(6)
    letter = lambda n: bytes(rng.choices(b"abcdefgh", k=n))
    part = letter(1200)
    texts = [letter(700) + part + letter(10), part[100:900] + letter(1500), letter(450) + part[300:700]]
    every = collections.defaultdict(set)
    for k, at, n, _, rank, _ in repeats.runs(texts):
        for i in range(at, at + n):
            every[k].add(i)
    assert all(every[k] == set(range(len(t) - 199)) for k, t in enumerate(texts))
    by = collections.defaultdict(set)
    for k, at, n, _, rank, _ in repeats.runs(texts):
        for i in range(at, at + n):
            by[texts[k][i : i + 200]].add(rank)
    assert all(len(ranks) == 1 for ranks in by.values())


def test_repeats_of_a_line_in_every_text(spark, monkeypatch):
    """One line stands in all texts, with other words around it each time; null doc_id, long texts in several segments, small slices."""
    for name, value in (("SLICE", 3000), ("ROWS", 150), ("SEGMENT", 1500)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(9)
    letter = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    line, other = letter(320), letter(250)
    texts = [letter(rng.randint(0, 120)) + line + letter(rng.randint(0, 120)) + (other if k % 4 == 0 else "") for k in range(70)]
    texts += [letter(6000) + other + letter(5000) + line, texts[3], texts[3] + "x", None, "", line, other[:-1]]
    pairs = [(None if i % 20 == 0 else i, t) for i, t in enumerate(texts)]
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(repeats.digest(docs(spark, pairs).repartition(3))))
    assert got == sorted((i or -1, *w) for (i, _), w in zip(pairs, brute_repeats(texts, 200), strict=True))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_texts")]


def test_neighbours(spark, sf):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[5] = x[6] = x[40] = x[20]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [1.0] * 3), (906, [float("inf")] * 16)]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    want = x.astype(np.float64) @ x.astype(np.float64).T
    for share, least in ((1.0, 1.0), (neighbours.SHARE, 0.9)):
        got = collections.defaultdict(list)
        for r in neighbours.search(df, F.col("vec_id") % 20 == 0, share=share, shard=250).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert sorted(got) == list(range(0, 600, 20))
        hits = 0
        for q, found in got.items():
            best = sorted((i for i in range(600) if i != q), key=lambda i: (-want[q, i], i))[:20]
            hits += len(set(best) & {i for i, _ in found})
            assert len(found) == 20
            assert all(abs(s - want[q, i]) < 1e-9 for i, s in found)
            assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert hits / len(got) / 20 >= least
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame(data[:5], df.schema)
    assert neighbours.search(few, F.col("vec_id") % 20 == 0).count() == 4


def test_neighbours_of_other_dimensions_and_extra_columns(spark):
    """Vectors of a rarer dimension are searched among themselves; columns named like the operator's own are not read."""
    rng = np.random.default_rng(4)
    data = [(i, rng.standard_normal(8 if i % 3 else 5).tolist(), "x", 1, 2) for i in range(90)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, row string, shard int, asked int").repartition(4)
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=5, share=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q in range(0, 90, 20):
        v = {i: np.array(x) for i, x, *_ in data if len(x) == len(data[q][1]) and i != q}
        assert got[q] == sorted(v, key=lambda i: (-(v[i] * np.array(data[q][1])).sum(), i))[:5]


def test_neighbours_of_a_very_common_vector(spark):
    """A third of the rows hold the same vector: ties go to the smaller ids, in every shard."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 16))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(5)
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 60 == 0, shard=200).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    nearer = [i for i in range(900) if i % 3 and x[i] @ x[0] > x[0] @ x[0]]
    for q, found in got.items():
        assert not nearer and found == [i for i in range(0, 900, 3) if i != q][:20]


@pytest.mark.parametrize(("spread", "shard"), [(0.0, 16_384), (0.0, 300), (0.5, 700), (1.0, 16_384)])
def test_neighbours_recall(spark, sf, spread, shard):
    """Against brute force on all of sf0.1, with one and several shards, for vectors of equal and very unequal lengths."""
    df = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    pdf = df.toPandas()
    x, ids = np.stack(pdf["embedding"]).astype(float), pdf["vec_id"].to_numpy()
    x *= np.exp(spread * np.random.default_rng(2).standard_normal(len(x)))[:, None]
    scaled = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}))
    got = neighbours.search(scaled, F.col("vec_id") % 20 == 0, shard=shard).toPandas().groupby("query_id")["vec_id"].agg(set)
    hits = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(found & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hits / 20 / len(got) >= 0.93


def test_neighbours_share_scored(spark, sf):
    pdf = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet").toPandas()
    x = np.stack(pdf["embedding"]).astype(float)
    found = [len(c) for _, c in neighbours.Forest(x).candidates(x[::20], int(neighbours.SHARE * len(x)))]
    assert len(found) == 100 and max(found) <= neighbours.SHARE * len(x) + 5


def test_bpe(spark):
    tokenizers = pytest.importorskip("tokenizers")
    coder = tokenizers.Tokenizer.from_file(queries.WORD_BPE)
    rng = random.Random(2)
    texts = [t for _, t in sample_texts(20)] + ["Hello<|endoftext|> World's 12", "aaaa" * 50 + " b", "x\x1cy\x85z​q", "İ ΑΣ ΣΑΣ ﬁ 😀", "é é"]
    texts += ["".join(rng.choices("abé日本 '1.!\n\x1c", k=70)) for _ in range(200)]
    got = {r["doc_id"]: r for r in rows(bpe.digest(docs(spark, list(enumerate(texts))), queries.WORD_BPE))}
    full = {r["doc_id"]: r for r in rows(bpe.tokenize(docs(spark, list(enumerate(texts))), queries.WORD_BPE, batch_chars=500))}
    for i, text in enumerate(texts):
        ids = coder.encode(text or "", add_special_tokens=False).ids
        said = coder.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
        assert full[i]["ids"] == ids and full[i]["decoded"] == said


def test_bpe_edges(spark):
    """Empty table, repeated rows, null doc_id and text, a very long word, more words than are remembered."""
    given = [(1, "some words"), (1, "some words"), (None, None), (2, ""), (3, "ab" * 40_000), (4, " ".join(f"w{k}x" for k in range(3000)))]
    table = docs(spark, given)
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in bpe.digest(table, queries.WORD_BPE).collect())
    want = collections.Counter((r["doc_id"], len(r["ids"])) for r in bpe.tokenize(table, queries.WORD_BPE, batch_chars=10).collect())
    assert got == want == collections.Counter((r["doc_id"], r["total"]) for r in bpe.count(table, queries.WORD_BPE, "doc_id").collect())
    assert got[None, 0] == got[2, 0] == 1 and sum(got.values()) == 6
    assert bpe.digest(table.limit(0), queries.WORD_BPE).count() == 0
    coder = bpe.Encoder(queries.WORD_BPE)
    bpe.REMEMBERED, before = 100, bpe.REMEMBERED
    try:
        again = [coder.encode([f"w{k}x w{k}y"]) for k in range(80) for _ in range(2)]
    finally:
        bpe.REMEMBERED = before
    assert again == [bpe.encoder(queries.WORD_BPE).encode([f"w{k}x w{k}y"]) for k in range(80) for _ in range(2)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">The ad of the day is in the box for all of you and it was here.</div>
<article><h1>Title&amp;more</h1><p><b>The first of the   paragraphs is long enough to be decided by its words and it is in the article.<br><p>Short one.</p>
<form><p>The form of the page is for all of you and it was here in the box.</p></form></article>
<aside><p>The aside of the page is for all of you and it was here in the box, it is long.</p></aside>
<div id="comments"><p>I was here and it is the best of all that I have seen in the world so far.</p></div><footer>&copy; x</footer>"""


def test_html(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 1), (None, "u", "", 1), (4, "u", "<p>x", 1), (4, "u", "<div>" * 5000 + "t", 1)], "page_id bigint, url string, html string, text int")
    got = {(r["page_id"], r["url"]): r for r in rows(html_text.main_text(df))}
    want = "Title&more\n\nThe first of the paragraphs is long enough to be decided by its words and it is in the article.\n\nShort one."
    assert got[1, "u"]["text"] == want and got[1, "u"]["n_chars"] == len(want)
    assert got[2, None]["text"] == "" == got[None, "u"]["text"]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_html_on_pages(spark, sf):
    for r in html_text.main_text(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = [" ".join(html_text.html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        assert r["text"] == "\n\n".join(p for p in parts if p)


def test_quality(spark, sf):
    d, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(d, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (got.held_out == [quality.held_out(i) for i in got.doc_id]).all()
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.97
    assert held[held.quality == 1].predicted.mean() > 0.99
    assert got.score.between(0, 1).all()


def least_squares_rising(y):
    """The rising sequence nearest to y by the min-max formula over all intervals."""
    n = len(y)
    sums = np.r_[0, np.cumsum(y)]
    mean = lambda a, b: (sums[b + 1] - sums[a]) / (b - a + 1)
    return np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_quality_against_a_direct_solution(spark, sf):
    """All training rows in one array: the same weights, and a curve as near as its bins allow to the exact isotonic fit."""
    d, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    chosen = quality.sample(d, labels)
    model = quality.train(quality.measure(d).join(chosen.labels, "doc_id").repartition(5), chosen)
    rows_ = d.select("doc_id", "text").join(labels, "doc_id").where("quality IN (0, 1)").toPandas()
    fold = np.array([zlib.crc32(str(i).encode()) % 4 for i in rows_.doc_id])
    x, y = np.array([quality.statistics(t) for t in rows_.text]), rows_.quality.to_numpy(float)
    fit, calibrate = (fold != quality.HELD_OUT) & (fold != quality.CALIBRATE), fold == quality.CALIBRATE
    mean, scale = x[fit].mean(axis=0), np.maximum(x[fit].std(axis=0), 1e-6)
    z = quality.fourier((x - mean) / scale)
    share = y[fold != quality.HELD_OUT].mean()
    weight = np.where(y[fit] > 0.5, 0.5 / share, 0.5 / (1 - share))
    a = z[fit].T @ (z[fit] * weight[:, None])
    direct = np.linalg.solve(a + quality.RIDGE * np.trace(a) / len(a) * np.eye(len(a)), z[fit].T @ (weight * y[fit]))
    assert np.allclose(direct, model.weights, atol=1e-6)
    raw = z @ direct
    order = np.argsort(raw[calibrate], kind="stable")
    exact = least_squares_rising(y[calibrate][order])
    assert (np.diff(model.curve) >= 0).all() and np.abs(model.score(x[calibrate][order]) - exact).mean() < 0.02
    assert np.allclose(quality.isotonic(y[calibrate][order].tolist(), [1] * int(calibrate.sum())), exact)


def test_quality_of_a_very_long_text(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int")
    texts = docs(spark, [(1, "The good text of it. " * 200_000), (2, "!!! ### $$$"), (9, "x" * 3_000_000)])
    assert all(0 <= r["score"] <= 1 for r in rows(quality.classify(texts, labels)))


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    texts = docs(spark, [(1, "The good text of it."), (2, "!!! ### $$$"), (5, None), (None, ""), (5, None)])
    got = rows(quality.classify(texts, labels))
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 1.0 for r in rows(quality.classify(texts, labels.limit(0))))
    assert quality.classify(texts.limit(0), labels).count() == 0
    assert quality.accept(texts, labels.limit(0)).columns == texts.columns
    assert quality.isotonic([1, 0, 2], [1, 1, 1]).tolist() == [0.5, 0.5, 2]


def test_warc(spark):
    evil = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nfiledesc://x 0.0.0.0\nX-Page-Id: 9\r\n" + "z" * 100
    pages = [(1, "http://a/x y", "p" * 100), (2, "http://b", "p" * 100), (3, None, "q" * 99), (4, "", "q" * 99), (5, "é", None), (6, "u", ""), (7, "u", evil), (8, "u", evil), (None, "u", "p" * 100), (1, "u", "p" * 100), (9, "u", "ü" * 50), (10, "u", "ü" * 50 + "\n\n")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id bigint, url string, html string, n int").repartition(3)
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(warc.round_trip(df)))
    want = collections.Counter()
    for i, _, h in pages:
        body = (h or "").encode()
        first = min((j for j, _, g in pages if (g or "").encode() == body and j is not None), default=None)
        again = len(body) >= 100 and first is not None and first != i
        want[i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_of_a_foreign_archive(spark, tmp_path):
    """Bare line feeds, other types, bytes that are no text, a gzip member per record, and a payload of megabytes."""
    import gzip
    import io

    fields = {v: " ".join(f) for v, f in warc.ARC_FIELDS.items()}
    opening = f"1 0 Other Crawler\n{fields[1]}\n\n".encode()
    big = b"<p>\xff\x00big" + b"x" * 3_000_000
    bodies = [b"HTTP/1.0 200 OK\nServer: x\n\n" + big, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + big, b"1.2.3.4", b"HTTP/1.1 204 No Content\r\nX: y"]
    urls = ["http://a/1", "http://b/2", "dns:a", "http://c/3"]
    parts = [f"filedesc://old.arc 0.0.0.0 20010203040506 text/plain {len(opening)}\n".encode() + opening]
    parts += [f"{u} 1.2.3.4 2001020304050{k} text/html {len(c)}\n".encode() + c + b"\n" for k, (u, c) in enumerate(zip(urls, bodies, strict=True))]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "old.arc.gz").write_bytes(b"".join(gzip.compress(x) for x in parts))
    warc.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    got = [x for r in warc.files(spark, f"file://{tmp_path}/warc").collect() for x in warc.read_warc(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(bytes(r["content"])))))]
    heads = {h.get("warc-target-uri", h.get("warc-filename")): (h, block) for h, block in got}
    assert {u: h["warc-type"] for u, (h, _) in heads.items()} == {"old.arc": "warcinfo", urls[0]: "response", urls[1]: "response", urls[2]: "resource", urls[3]: "resource"}
    assert heads[urls[0]][1] == bodies[0] and heads[urls[2]][1] == bodies[2] and heads["old.arc"][1] == opening
    assert heads[urls[0]][0]["warc-payload-digest"] == f"sha256:{hashlib.sha256(big).hexdigest()}" and heads[urls[0]][0]["warc-date"] == "2001-02-03T04:05:00Z"
    assert sorted(r["payload_bytes"] for r in warc.index(spark, f"file://{tmp_path}/warc").collect()) == [len(big)] * 2


def test_warc_revisits_name_their_response(spark, tmp_path):
    import gzip
    import io

    df = spark.createDataFrame([(k, f"http://h/{k}", "same " * 50) for k in (5, 3, 9)], "page_id bigint, url string, html string")
    warc.write_arc(df, f"{tmp_path}/arc", 2)
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    got = [h for r in warc.files(spark, f"{tmp_path}/warc").collect() for h, _ in warc.read_warc(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(bytes(r["content"])))))]
    first = next(h for h in got if h["warc-type"] == "response")
    assert first["x-page-id"] == "3"
    again = [h for h in got if h["warc-type"] == "revisit"]
    assert len(again) == 2 and all(h["warc-refers-to"] == first["warc-record-id"] and h["warc-refers-to-target-uri"] == "http://h/3" and h["warc-refers-to-date"] == first["warc-date"] for h in again)


CAPACITIES = (64, 128, 256, 4096)


def test_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    coder = tokenizers.Tokenizer.from_file(queries.WORD_BPE)
    encode = lambda t: coder.encode(t or "", add_special_tokens=False).ids
    texts = [*sample_texts(), (3, "w " * 9001), (4, "w " * 4096), *[(100 + i, "tie " * 7) for i in range(500)], (None, "a b"), (7, "twice"), (7, "twice"), (7, "twice too")]
    df = docs(spark, texts)
    got = pd.DataFrame(rows(packing.pack(df.repartition(3), queries.WORD_BPE, CAPACITIES)))
    own = lambda i: -1 if i is None or i != i else int(i)
    want = collections.Counter((own(i), len(encode(t))) for i, t in texts)
    assert sum(n * k for (_, n), k in want.items()) == got.n_tokens.sum()
    bins = got[got.n_tokens > 0]
    assert (got[got.n_tokens == 0].bin_id.isna()).all() and bins.bin_id.notna().all()
    for _, b in bins.groupby("bin_id"):
        b = b.sort_values("bin_offset")
        assert b.bin_capacity.nunique() == 1
        assert (b.bin_offset.to_numpy() == np.r_[0, np.cumsum(b.n_tokens)[:-1]]).all()
        used, cap = b.n_tokens.sum(), b.bin_capacity.iloc[0]
        assert used <= cap and not any(used <= c < cap for c in CAPACITIES)
    # Unpacked, the sequences give every document's ids back, each row as often as it is there.
    made = packing.sequences(df.repartition(5), queries.WORD_BPE, CAPACITIES).collect()
    parts = collections.defaultdict(list)
    for r in made:
        assert r["n_tokens"] == len(r["ids"]) <= r["bin_capacity"] and r["doc_ids"] == [p["doc_id"] for p in r["pieces"]]
        at = 0
        for p in r["pieces"]:
            parts[own(p["doc_id"]), p["start"]].append(tuple(r["ids"][at : at + p["n_tokens"]]))
            at += p["n_tokens"]
        assert at == len(r["ids"])
    expected = collections.defaultdict(list)
    for i, t in texts:
        ids = encode(t)
        for start in range(0, len(ids), 4096):
            expected[own(i), start].append(tuple(ids[start : start + 4096]))
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in expected.items()}
    # Bins are the same however the rows are split.
    again = pd.DataFrame(rows(packing.pack(df.repartition(2), queries.WORD_BPE, CAPACITIES)))
    keyed = lambda d: sorted(map(tuple, d.fillna(-1).astype(int).to_numpy().tolist()))
    assert keyed(got) == keyed(again)
    assert packing.pack(docs(spark, []), queries.WORD_BPE).count() == 0 == packing.sequences(docs(spark, []), queries.WORD_BPE).count()


def test_packing_plan_is_best_fit():
    """Against the plain loop over single items."""
    rng = random.Random(4)
    for _ in range(200):
        sizes = sorted(rng.sample(range(5, 40), 3))
        items = sorted((rng.randint(1, sizes[-1]) for _ in range(rng.randint(0, 60))), reverse=True)
        open_bins = []
        for x in items:
            fits = [b for b in open_bins if b[0] >= x]
            if not fits:
                cap = min((c for c in sizes if c >= x), key=lambda c: ((c + 3) / (c // x), -c))
                fits = [[cap, 0]]
                open_bins += fits
            b = min(fits, key=lambda b: (b[0], -b[1]))
            b[0] -= x
            b[1] += x
        plan = packing.plan(dict(collections.Counter(items)), sizes, 3)
        used = collections.Counter()
        for length, low, high, each, first, _, _ in plan:
            for rank in range(low, high):
                used[first + (rank - low) // each] += length
        assert sorted(used.values()) == sorted(b[1] for b in open_bins)


def brute_secrets(text):
    found = []
    for k, p in enumerate((secrets.RULES[0].pattern, r"AKIA[A-Z0-9]+", r"[0-9a-f]+")):
        for m in re.finditer(p, text or ""):
            if len(m[2] if k == 0 else m[0]) >= (12, 18, 16)[k]:
                found.append((m.start(), k, m.end()))
    return ",".join(f"{secrets.RULES[k].kind}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets(spark):
    rng = random.Random(1)
    parts = ["password", "Secret", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ab12", "deadbeef", "ABCDEF12", "-", "é", "\n", "passwd"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(800)]
    texts += [None, "", "secret=token: abcdefghijklmnop", "x" * 50000 + "deadbeefdeadbeef", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9]
    got = {r["doc_id"]: r for r in rows(secrets.digest(docs(spark, list(enumerate(texts)))))}
    for i, text in enumerate(texts):
        want = brute_secrets(text)
        base = [s for s in got[i]["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert ",".join(base) == want
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[i]["n_hex"] == want.count("hex:") and got[i]["n_assign"] == want.count("assign:")
    assert got[len(texts) - 2]["spans"] == "pem:0:31" and got[len(texts) - 1]["spans"].startswith("github:0:40")
    clean = {r["doc_id"]: r["text"] for r in rows(secrets.redact(docs(spark, list(enumerate(texts)))))}
    assert all(not brute_secrets(t) for t in clean.values())
    assert all(clean[i] == t for i, t in enumerate(texts) if not got[i]["spans"])


def test_secrets_edges(spark):
    """Empty table, repeated rows, null doc_id, a column of the operator's own name, long runs of half a match, other tokens."""
    table = docs(spark, [(1, "x"), (1, "x"), (None, "token: abcdefghijklmnop"), (2, None)]).withColumnRenamed("same", "found")
    got = secrets.scan(table)
    assert got.columns == [*table.columns, "found_"] and secrets.scan(table.limit(0)).count() == 0 == secrets.digest(table.limit(0)).count()
    assert collections.Counter((r["doc_id"], len(r["found_"]), r["found"]) for r in got.collect()) == {(1, 0, "y"): 2, (None, 1, "y"): 1, (2, 0, "y"): 1}
    assert [(k, e) for _, k, e in secrets.find(("password" + " " * 300_000 + "=").encode() * 3)] == []
    for text, kind in (("AIza" + "x" * 35, "google"), ("xoxb-" + "1a" * 12, "slack"), ("sk_live_" + "Z9" * 12, "stripe"), ("eyJ" + "a" * 20 + ".eyJ" + "b" * 20 + ".c-_", "jwt")):
        assert [(s, secrets.RULES[k].kind, e) for s, k, e in secrets.find(f"see {text} here".encode()) if k >= secrets.BASE] == [(4, kind, 4 + len(text))]


def test_secrets_of_many_spans():
    """Offsets of many spans in a long text, with characters of several bytes, in time linear in it."""
    rng = random.Random(5)
    words = ["é", "deadbeefdeadbeef ", "ghp_" + "a1B2" * 9 + " ", "日本", "AKIA" + "A1" * 9 + "é"]
    text = "".join(rng.choices(words, k=120_000))
    start = time.monotonic()
    data = text.encode()
    found = secrets.find(data)
    place = secrets.code_points(data, found)
    assert time.monotonic() - start < 15 and len(found) > 70_000
    assert [(place[s], place[e]) for s, k, e in found if k == 2] == [m.span() for m in re.finditer(r"[0-9a-f]{16,}", text)]
    assert [(place[s], place[e]) for s, k, e in found if k == 3] == [m.span() for m in re.finditer(r"gh[pousr]_[A-Za-z0-9]{36,}", text)]


def test_rules_parser():
    """Automata of generated patterns, forwards and backwards, against the regex engine."""
    rng = random.Random(13)

    def pattern(depth):
        atoms = ["a", "b", "[ab]", "[b-d]", r"\x61", r"\.", "[^"[:1] + "c-]"]
        out = "".join((f"({pattern(depth - 1)}|{pattern(depth - 1)})" if depth and rng.random() < 0.4 else rng.choice(atoms)) + rng.choice(["", "", "?", "*", "+", "{2}", "{1,}", "{0,2}"]) for _ in range(rng.randint(1, 3)))
        return out

    def accepts(rows, data):
        at = 0
        for b in data:
            at = rows[at][b]
        return bool(rows[at][256])

    for _ in range(50):
        p = pattern(2)
        ahead, back = secrets.compile_table([p], True, False), secrets.compile_table([p], True, True)
        for _ in range(25):
            text = "".join(rng.choices("abcd.-", k=rng.randint(0, 6)))
            want = bool(re.fullmatch(p, text))
            assert accepts(ahead, text.encode()) == want == accepts(back, text[::-1].encode()), (p, text)


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_simhash(spark):
    texts = [t for _, t in sample_texts(80)]
    texts += [texts[70 % 80] + " one", *(f"{texts[9]} {k}" for k in range(6)), None, "\x0b", "a\xa0b c d"]
    got = {r["doc_id"]: r for r in rows(simhash.classify(docs(spark, list(enumerate(texts)))))}
    fps = [brute_simhash(t) for t in texts]
    roots = brute_components(fps)
    for i in range(len(texts)):
        assert got[i]["fingerprint"] == f"{fps[i]:016x}"
        assert got[i]["component_id"] == roots[i]
    assert sorted(r["doc_id"] for r in rows(simhash.dedup(docs(spark, [*enumerate(texts), (0, texts[0])])))) == sorted(set(roots))
    assert simhash.classify(docs(spark, [])).count() == 0
    assert simhash.dedup(docs(spark, [])).count() == 0


def test_simhash_dedup_keeps_every_component(spark):
    """Rows that share a doc_id, or lack one, are told apart by their texts; one row of each component stays."""
    a, b, c = "alpha beta gamma delta", "one two three four five", "six seven eight nine"
    given = [(5, a), (5, b), (7, b), (5, a), (None, c), (None, c), (None, a), (None, "only null"), (8, None), (9, "")]
    kept = rows(simhash.dedup(docs(spark, given)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(False, 5, a), (False, 5, b), (True, 0, c), (True, 0, "only null"), (False, 8, "")])
    assert kept[0].keys() == {"doc_id", "text", "kept", "n_chars", "same", "row"}


@pytest.mark.parametrize("node", [4, 8192])
def test_simhash_links(spark, monkeypatch, node):
    """Planted chains and a dense ball; small nodes send rows down every level of the index."""
    monkeypatch.setattr(simhash, "NODE", node)
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:25]:
        for _ in range(8):
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    ball = rng.getrandbits(64)
    fps |= {ball ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = components.components(simhash.links(df)).toPandas().set_index("node")["root"].to_dict()
    group = [found.get(s, s) for s in signed]
    roots = brute_components(fps)
    assert len(set(zip(group, roots))) == len(set(group)) == len(set(roots))


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{sf}/documents.parquet")
    stages = []
    for _, stage in p.STAGES:
        stages.append(d := stage(spark, d, sf).cache())
    first, second, third, fourth, last = (x.toPandas() for x in stages)
    base = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert list(first.columns) == list(base.columns) == list(fourth.columns)
    scores = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    assert set(first.doc_id) == set(scores[scores.predicted == 1].doc_id)
    want = first.assign(key=first.text.map(lower)).groupby("key").doc_id.max()
    assert sorted(second.doc_id) == sorted(want)
    assert sorted((False, i) for i in third.doc_id) == brute(list(zip(second.doc_id.tolist(), second.text.tolist(), strict=True)))
    assert sorted(fourth.doc_id) == sorted(third.doc_id) and not fourth.text.map(brute_secrets).any()
    coder = bpe.encoder(queries.WORD_BPE)
    want = {i: len(x[0]) // 4 for i, x in zip(fourth.doc_id.tolist(), coder.encode([t or "" for t in fourth.text]), strict=True)}
    have = collections.Counter()
    for pieces in last.pieces:
        for piece in pieces:
            have[piece["doc_id"]] += piece["n_tokens"]
    assert dict(have) == {i: n for i, n in want.items() if n}
    ran = p.run(spark, sf).toPandas()
    assert len(ran) == len(last) and ran.n_tokens.sum() == last.n_tokens.sum()


def test_pipeline_stages_edges(spark, sf):
    """Nulls, empty tables, repeated rows with other text and extra columns with clashing names, stage by stage."""
    import corpus_pipeline as p

    good = " ".join(r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select("text").limit(3).collect())
    given = [(1, good), (1, good + " and more of it"), (1, good), (None, good.upper()), (None, None), (5, ""), (6, None), (7, "password=abcdefghijkl012345"), (8, "w " * 30000)]
    table = docs(spark, given).withColumnsRenamed({"same": "found", "row": "key"}).withColumn("__nth", F.lit(1)).withColumn("digest", F.lit("d")).withColumn("label", F.lit(0))
    for name, stage in p.STAGES:
        out = stage(spark, table, sf)
        empty = stage(spark, table.limit(0), sf)
        assert empty.count() == 0 and empty.columns == out.columns
        if name == "packing":
            assert sum(r["n_tokens"] for r in out.collect()) > 30000
            continue
        assert out.columns == table.columns
        got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
        if name == "exact dedup":
            assert got == {(1, good): 1, (1, good + " and more of it"): 1, (6, None): 1, (7, given[7][1]): 1, (8, given[8][1]): 1}
        if name == "near dedup":
            assert got == {(1, min(good, good + " and more of it", key=lambda t: hashlib.md5(t.encode()).digest())): 1, (5, ""): 1, (7, given[7][1]): 1, (8, given[8][1]): 1}
        if name == "secret scans":
            assert sum(got.values()) == len(given) and (7, given[7][1]) not in got and got[1, good] == 2 and got[6, None] == 1
