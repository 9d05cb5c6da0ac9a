"""Spelling variant grouping: words one edit apart by asymmetric chunks, and each word's chain of more frequent forms.

Words are counted in tasks, over arrays of a batch's bytes: runs of letters, their checksums a byte position at a time, and
the batch's distinct words with their counts, which Spark adds up.

Of two words that differ by one inserted, deleted or replaced character the longer one (of equal lengths either) gives two
disjoint chunks, its halves. The edit lies in one half, so the other one stands in the second word, at its place or
shifted by one. The second word therefore gives its positional grams of those lengths: for each length that the first word
may have, the one at its front and the one at its end. Both meet in a join on chunk, half and length, and candidates are
verified. Where more candidates than BOUND would meet in a chunk, the same argument holds for the half with the edit: it
is halved again, and the part without the edit joins the chunk, round by round until a place of one character is left,
where every meeting pair is a result (two words of one alphabet have few characters to differ in). So no chunk, however
common, makes all pairs of its words, and none is dropped.

A pair is met once: of the places where deleting one of several equal characters gives the second word the first counts.

Defined cases: null texts hold no words; a null doc_id counts as empty in the checksum. Letters are A-Z, a-z and U+00C0 to
U+00FF; only A-Z are lower-cased. Repeated rows count each. Texts and words of any length are whole. An empty table has
no words. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import cut

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
DAMAGE = 199
#: Candidates in a chunk beyond which it is divided; bytes of texts that a task works on at a time.
BOUND, PIECE = 1_024, 8 << 20
#: Beyond so many bytes a run's checksum is taken by itself.
LONG = 64
#: Counts of forms grow by TIMES a step, so a chain of longs has fewer steps than 2 to this.
ROUNDS = 5

CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALPHA = np.zeros(256, bool)
ALPHA[65:91] = ALPHA[97:123] = ALPHA[0xC3] = True


def checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of each run of data, going on from that of what stands before it."""
    order = np.argsort(-sizes, kind="stable")
    at, size, crc = starts[order], sizes[order], ~before[order]
    many = int(np.searchsorted(-size, -LONG))
    for k in range(many):
        crc[k] = ~np.uint32(zlib.crc32(data[at[k] : at[k] + size[k]].tobytes(), int(before[order[k]])))
    at, size, part = at[many:], size[many:], crc[many:]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j))  # those of more than j bytes come first
        part[:n] = CRC[(part[:n] ^ data[at[:n] + j]) & 255] ^ (part[:n] >> 8)
    out = np.empty_like(crc)
    out[order] = ~np.r_[crc[:many], part]
    return out


def tally(ids: list[str], texts: pa.StringArray) -> pa.StructArray:
    """The distinct words of texts after damage, with their counts."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds -= bounds[0]
    low, letter, wide = LOWER[raw], ALPHA[raw], raw == 0xC3
    letter[1:] |= wide[:-1]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    first[inner] = letter[inner]
    last[inner - 1] = letter[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    twice = np.r_[0, np.cumsum(wide, dtype=np.int32)]
    length = ends - starts - (twice[ends] - twice[starts])
    enough = length >= LEAST_LENGTH
    starts, ends, length = starts[enough], ends[enough], length[enough]
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = checksums(low, starts, ends - starts, before[np.searchsorted(bounds, starts, "right") - 1])
    spoiled = h % DAMAGE == 0
    # Runs and what lies between them are the items of one array over the same bytes.
    edges = np.stack([starts, ends], 1).ravel().astype(np.int32)
    items = pa.StringArray.from_buffers(max(0, len(edges) - 1), pa.py_buffer(edges if len(edges) else np.zeros(1, np.int32)), pa.py_buffer(low))
    words = items.take(pa.array(2 * np.flatnonzero(~spoiled)))
    shorter = []
    for k in np.flatnonzero(spoiled & (length > LEAST_LENGTH)).tolist():
        word, place = low[starts[k] : ends[k]].tobytes().decode(), int(h[k] % length[k])
        shorter.append(word[:place] + word[place + 1 :])
    return pa.concat_arrays([words, pa.array(shorter, pa.string())]).value_counts()


def pieces(texts: pa.StringArray, size: int):
    """Ranges of rows of at most size bytes together, longer texts alone."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, int(bounds[at]) + size, "right")) - 1)
        yield at, end
        at = end


def count(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): word, n."""
    size = PIECE

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch["doc_id"], batch["text"].fill_null("")
            for at, end in pieces(texts, size):
                got = tally(ids[at:end].to_pylist(), texts[at:end])
                yield pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], ["word", "n"])

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return named.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def chunk() -> list[Column]:
    """What a row's word holds outside the part with the edit, and the part's bounds in a word of the row's length l."""
    i, j = (F.floor(part * F.col("l") / F.pow(F.lit(2.0), F.col("level"))).cast("int") for part in (F.col("part"), F.col("part") + 1))
    shift = F.char_length("word") - F.col("l")
    rest = F.col("word").substr(j + shift + 1, F.char_length("word"))
    return [F.concat_ws(":", "l", "level", "part", F.col("word").substr(F.lit(1), i), rest).alias("chunk"), i.alias("i"), (j - i).alias("width")]


def near_pairs(words: DataFrame, bound: int = BOUND) -> DataFrame:
    """words(word, n), each word once: a, b, a_n, b_n for each two words that differ by exactly one edit, once."""
    size = F.char_length("word")
    sides = [(True, size), (False, size), (False, size + 1)]
    halves = F.explode(F.array(F.lit(0), F.lit(1)))
    pending = words.select("word", "n", F.explode(F.array(*[F.struct(F.lit(a).alias("longer"), n.alias("l")) for a, n in sides])).alias("s")).select("word", "n", "s.*", F.lit(1).alias("level"), halves.alias("part"))
    found = None
    while True:
        keyed = cut(pending.select("*", *chunk()).where("width > 0"), "chunks", "zstd")
        met = keyed.groupBy("chunk").agg((F.count_if("longer") * F.count_if(~F.col("longer"))).alias("candidates"), F.max("width").alias("widest"))
        hot = cut(met.where((F.col("candidates") > bound) & (F.col("widest") > 1)).select("chunk"), "hot-chunks")
        some = not hot.isEmpty()
        cold = keyed.join(hot, "chunk", "left_anti") if some else keyed
        a = cold.where("longer").select("chunk", "i", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = cold.where("NOT longer").select("chunk", F.col("word").alias("b"), F.col("n").alias("b_n"))
        same = F.char_length("a") == F.char_length("b")
        # Deleting the character before the part gives b, too: an earlier part has the pair.
        earlier = ~same & (F.col("i") > 0) & (F.concat(F.expr("substring(a, 1, i - 1)"), F.expr("substring(a, i + 1)")) == F.col("b"))
        pairs = a.join(b, "chunk").where((~same | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1) & ~earlier).select("a", "b", "a_n", "b_n")
        found = pairs if found is None else found.unionByName(pairs)
        if not some:
            return found
        pending = keyed.join(hot, "chunk", "left_semi").select("word", "n", "longer", "l", (F.col("level") + 1).alias("level"), F.explode(F.array(F.col("part") * 2, F.col("part") * 2 + 1)).alias("part"))


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form): word, root, the last form of each chain. Steps double from round to round."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return now


def group(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): word, form, root, n, n_near, form_n of every word."""
    words = cut(count(docs), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.m") >= TIMES * F.col("n"), F.col("best.other")).alias("form"), F.when(-F.col("best.m") >= TIMES * F.col("n"), -F.col("best.m")).alias("form_n"))
    told = cut(told, "forms")
    last = roots(told.where("form IS NOT NULL").select("word", "form"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
