"""BPE encoding and decoding by batched numpy merge rounds.

A batch's new words are laid out as one flat array of symbol ids. A round looks every adjacent pair up by binary
search in the sorted pair keys, takes each word's lowest rank, merges it in all words at once and packs the array;
rounds go on until no pair of any word has a rank. Words are encoded once per task and remembered.

Defined cases: null and empty texts have no tokens; their digests are those of no bytes. The special strings inside a
text become their own ids, as the tokenizers library has it. A text of any length is encoded whole. Null doc_id and
repeated rows are kept as they are.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NO_RANK = np.iinfo(np.int64).max
#: Chunks and words that a task remembers before it starts anew, with their ids or with their sizes alone.
REMEMBERED, REMEMBERED_SIZES = 400_000, 1_000_000
#: Unicode's White_Space characters.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Encoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.size = model["vocab"], 1 << 17
        self.names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: Bytes that hold any id.
        self.width = 2 if max(self.names) < 1 << 16 else 4
        self.end = model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int64)
        left = np.array([vocab[a] for a, _ in model["merges"]], np.int64)
        right = np.array([vocab[b] for _, b in model["merges"]], np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys, self.ranks, self.made = (left * self.size + right)[order], order.astype(np.int64), made
        # A merge whose product has a merge of lower rank must be done one place at a time.
        least = np.full(self.size, NO_RANK)
        np.minimum.at(least, left, np.arange(len(left)))
        np.minimum.at(least, right, np.arange(len(left)))
        self.alone = least[made] < np.arange(len(made))
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        # str.split() also splits at these four, which are no white space to the tokenizer.
        self.odd, self.space = re.compile("[\x1c-\x1f]"), re.compile(f"[{SPACE}]+")
        self.ids: dict[str, bytes] = {}
        self.said: dict[str, str] = {}
        self.sizes: dict[str, int] = {}

    def rank(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    def pair_ranks(self, at: np.ndarray, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that begin at places."""
        out = np.full(len(at), NO_RANK)
        inside = at < len(symbols) - 1
        inside[inside] = word[at[inside]] == word[at[inside] + 1]
        first = at[inside]
        out[inside] = self.rank(symbols[first] * self.size + symbols[first + 1])
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one word after the other, and where each word begins (and the last one ends). None may be empty."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw)), lengths)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        ranks = self.pair_ranks(np.arange(len(symbols)), symbols, word)
        done_words, done_symbols = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(ranks, starts)
            counts = np.diff(np.r_[starts, len(symbols)])
            done = lowest == NO_RANK
            if done.any():  # finished words leave the array
                stay = np.repeat(~done, counts)
                done_words.append(word[~stay])
                done_symbols.append(symbols[~stay])
                symbols, word, ranks = symbols[stay], word[stay], ranks[stay]
                lowest, counts = lowest[~done], counts[~done]
                if not len(symbols):
                    break
            best = np.repeat(lowest, counts)
            hit = self.apart(np.flatnonzero(ranks == best), symbols, word, best)
            symbols[hit] = self.made[best[hit]]
            keep, changed = np.ones(len(symbols), bool), np.zeros(len(symbols), bool)
            keep[hit + 1] = False
            # Only pairs with a merged symbol have other ranks than before.
            changed[hit] = changed[np.maximum(hit - 1, 0)] = True
            symbols, word, ranks, changed = symbols[keep], word[keep], ranks[keep], np.flatnonzero(changed[keep])
            ranks[changed] = self.pair_ranks(changed, symbols, word)
        if not done_words:
            return np.empty(0, np.int64), np.zeros(1, np.int64)
        word, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        return symbols[np.argsort(word, kind="stable")], np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]

    def apart(self, hit: np.ndarray, symbols: np.ndarray, word: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Of overlapping places in a run such as aaaa every second one; of a merge to be done alone a word's first."""
        fresh = np.r_[True, np.diff(hit) != 1]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
        alone = self.alone[best[hit]]
        if alone.any():
            hit = hit[~alone | np.r_[True, np.diff(word[hit]) != 0]]
        return hit

    def learn(self, chunks: set[str], known: dict[str, str] | dict[str, bytes] | dict[str, int]) -> None:
        """Encode the chunks not yet known. No word crosses white space, so a chunk between white space is a unit.

        known says what is wanted of a chunk: its tokens' names (said) and ids, its ids alone, or how many they are (sizes).
        """
        decode = known is self.said
        if len(known) > (REMEMBERED_SIZES if known is self.sizes else REMEMBERED):
            known.clear()
            if decode:
                self.ids.clear()
        # Letters only: one word.
        words = {c: [c] if c.isalpha() else self.words.findall(c) for c in chunks - known.keys()}
        # A word that has been a chunk of its own is known as well.
        fresh = list(dict.fromkeys(w for found in words.values() for w in found if w not in known))
        flat, starts = self.encode_words(fresh)
        if known is self.sizes:
            known.update(zip(fresh, np.diff(starts).tolist(), strict=True))
            known.update((chunk, sum([known[w] for w in found])) for chunk, found in words.items() if len(found) > 1)
            return
        raw, bounds = flat.astype("<u4").tobytes(), starts.tolist()
        spans = list(zip(bounds[:-1], bounds[1:], strict=True))
        self.ids.update((w, raw[4 * a : 4 * b]) for w, (a, b) in zip(fresh, spans, strict=True))
        self.ids.update((chunk, b"".join([self.ids[w] for w in found])) for chunk, found in words.items() if len(found) > 1)
        if decode:
            names = list(map(self.names.__getitem__, flat.tolist()))
            known.update((w, " ".join(names[a:b])) for w, (a, b) in zip(fresh, spans, strict=True))
            known.update((chunk, " ".join([known[w] for w in found])) for chunk, found in words.items() if len(found) > 1)

    def pieces(self, text: str) -> list[tuple[list[str], int | None]]:
        """Runs of chunks, each followed by a special id or None."""
        parts = self.split.split(text) if "<|" in text else [text]
        out = []
        for k in range(0, len(parts), 2):
            part = parts[k] if unicodedata.is_normalized("NFC", parts[k]) else unicodedata.normalize("NFC", parts[k])
            low = (part.replace("Σ", "σ") if "Σ" in part else part).lower()
            chunks = self.space.split(low) if self.odd.search(low) else low.split()
            out.append(([c for c in chunks if c] if "" in chunks else chunks, self.special[parts[k + 1]] if k + 1 < len(parts) else None))
        return out

    def known_pieces(self, texts: list[str], known: dict) -> list[list[tuple[list[str], int | None]]]:
        pieces = [self.pieces(t) for t in texts]
        collecting = gc.isenabled()
        gc.disable()  # millions of strings are made here, and no cycles
        try:
            self.learn(set().union(*(words for text in pieces for words, _ in text)), known)
        finally:
            if collecting:
                gc.enable()
        return pieces

    def count(self, texts: list[str]) -> list[int]:
        """How many ids each text has."""
        pieces = self.known_pieces(texts, self.sizes)
        return [sum(sum(map(self.sizes.__getitem__, words)) + (special is not None) for words, special in text) for text in pieces]

    def encode(self, texts: list[str], decode: bool = True) -> list[tuple[bytes, str]]:
        """Of each text the ids as little-endian 32-bit integers, and if decode the decoded text."""
        pieces = self.known_pieces(texts, self.said if decode else self.ids)
        out = []
        for text in pieces:
            ids, said = [], []
            for words, special in text:
                ids += map(self.ids.__getitem__, words)
                if decode:
                    said += map(self.said.__getitem__, words)
                if special is not None:
                    ids.append(special.to_bytes(4, "little"))
                    said.append(self.names[special])
            out.append((b"".join(ids), " ".join(said) if decode else ""))
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenize(docs: DataFrame, vocabulary: str, batch_chars: int = 2_000_000) -> DataFrame:
    """doc_id, ids ARRAY<INT>, decoded STRING of every text. vocabulary: the tokenizer file's path on every executor."""
    whole = lambda coder, texts: [(np.frombuffer(ids, "<u4").astype(np.int32), said) for ids, said in coder.encode(texts)]
    return _each(docs, ["doc_id"], vocabulary, batch_chars, "ids array<int>, decoded string", whole, [pa.list_(pa.int32()), pa.string()])


def encode(docs: DataFrame, vocabulary: str, *keep: str, width: int = 4, batch_chars: int = 2_000_000) -> DataFrame:
    """The columns to keep and ids BINARY of every text, the ids as little-endian unsigned integers of width bytes. Nothing is decoded."""
    said = f"<u{width}"
    ids = lambda coder, texts: [(np.frombuffer(x, "<u4").astype(said).tobytes(),) for x, _ in coder.encode(texts, decode=False)]
    return _each(docs, list(keep), vocabulary, batch_chars, "ids binary", ids, [pa.binary()])


def count(docs: DataFrame, vocabulary: str, *keep: str, batch_chars: int = 2_000_000) -> DataFrame:
    """The columns to keep and total INT, the number of ids of every text."""
    return _each(docs, list(keep), vocabulary, batch_chars, "total int", lambda coder, texts: [(n,) for n in coder.count(texts)], [pa.int32()])


def digest(docs: DataFrame, vocabulary: str, batch_chars: int = 2_000_000) -> DataFrame:
    """The contract's row for each document."""
    sha = lambda data: hashlib.sha256(data).hexdigest()
    rows = lambda coder, texts: [(len(ids) // 4, sha(ids), sha(said.encode())) for ids, said in coder.encode(texts)]
    return _each(docs, ["doc_id"], vocabulary, batch_chars, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", rows, [pa.int64(), pa.string(), pa.string()])


def _each(docs: DataFrame, keep: list[str], vocabulary: str, batch_chars: int, columns: str, rows, types) -> DataFrame:
    docs = docs.select(*keep, "text")
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        coder = encoder(vocabulary)
        for batch in batches:
            start, size, texts = 0, 0, []
            for k, text in enumerate(batch["text"], 1):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= batch_chars or k == batch.num_rows:
                    cols = zip(*rows(coder, texts), strict=True)
                    kept = [batch[c].slice(start, k - start) for c in keep]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [*keep, *names])
                    start, size, texts = k, 0, []

    kind = lambda c: docs.schema[c].dataType.simpleString()
    return docs.mapInArrow(run, ", ".join([*(f"{c} {kind(c)}" for c in keep), columns]))
