"""Spelling variants against brute force: damage, edits of all kinds, hot chunks, chains, odd texts."""

import collections
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest

from tidemark.llm import oracles, queries, spelling


def brute_words(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def edits(word, alphabet):
    out = {word[:k] + word[k + 1 :] for k in range(len(word))}
    out |= {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in alphabet}
    out |= {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in alphabet}
    return out - {word}


def brute(docs):
    words = brute_words(docs)
    alphabet = {c for w in words for c in w}
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [x for x in edits(w, alphabet) if x in words]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def found(df):
    got = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and len({r["word"] for r in got}) == len(got)
    return {r["word"]: tuple(r)[1:] for r in got}


def sample():
    rng = random.Random(6)
    stems = ["planet", "aaaaaa", "baaaaab", "überaus", "straßen", "réponse", "x×y÷zé", "commission", "tionción", "ABCDEFGH"]
    counts = {}
    for s in stems:
        counts[s] = 700
        for v in sorted(edits(s.lower(), "abé"))[:: rng.choice([1, 2, 3])]:
            counts[v] = rng.choice([1, 4, 5, 6, 30, 31, 139, 140, 141, 700])
    for k in range(300):  # a common half
        counts["common" + "".join(rng.choices("abcd", k=rng.choice([4, 5, 6])))] = rng.choice([5, 9, 50])
    counts |= {"chainxa": 5, "chainxb": 30, "chainxbc": 160, "chainxbcd": 900}
    tokens = [w for w, n in counts.items() for _ in range(n)]
    rng.shuffle(tokens)
    docs = [(i, " ".join(tokens[k : k + 97]) + rng.choice([".", " 日本 ", "Ѐ", ""])) for i, k in enumerate(range(0, len(tokens), 97))]
    long = "y" * 5_000
    return docs + [(None, None), (None, "planet " * 9), (7, ""), (7, "Planet-PLANET_planet1planet"), (8, " ".join([long] * 6)), (9, " ".join([long + "z"] * 40)), (-3, "À" * 6 + " " + "à" * 6)]


@pytest.mark.parametrize(("bound", "piece"), [(1_024, 8 << 20), (1, 200)])
def test_spelling(spark, monkeypatch, bound, piece):
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (bound,))
    monkeypatch.setattr(spelling, "PIECE", piece)
    docs = sample()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, word string, n int").repartition(3)
    want = brute(docs)
    assert found(spelling.group(df)) == want
    assert sum(f is not None for f, *_ in want.values()) > 50 and any(r != f and f for f, r, *_ in want.values()) and max(k for _, _, _, k, _ in want.values()) > 10


def test_tally():
    rng = random.Random(2)
    texts = ["".join(rng.choices(["a", "B", "é", "Ü", "ß", "日", " ", "word", "x" * 70], k=rng.randint(0, 300))) for _ in range(300)] + ["", "ééé" * 3]
    ids = [str(rng.randint(0, 10**6)) for _ in texts]
    got = collections.Counter()
    for a, b in ((0, 302), (5, 200)):
        got.clear()
        for r in spelling.tally(ids[a:b], pa.array(texts, pa.string())[a:b]).to_pylist():
            got[r["values"]] += r["counts"]
        want = collections.Counter()
        for i, t in zip(ids[a:b], texts[a:b], strict=True):
            for w in re.findall("[A-Za-zÀ-ÿ]+", t):
                w = "".join(c.lower() if c.isascii() else c for c in w)
                h = zlib.crc32(f"{i}:{w}".encode())
                k = h % len(w)
                want[w[:k] + w[k + 1 :] if h % 199 == 0 else w] += 1
        assert got == {w: n for w, n in want.items() if len(w) >= 6}


def test_empty_and_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert spelling.group(docs.limit(0)).count() == 0
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert found(queries.op12_spelling(spark, sf)) == want


def test_sql_of_the_contract(sf):
    folder = sf.replace("0.001", "0.01")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = {r[0]: tuple(r[1:]) for r in duck.sql(oracles.SPELLING).fetchall()}
    assert got == brute(duck.sql("SELECT doc_id, text FROM documents").fetchall())
