"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Each text is reduced to a fixed list of statistics. Random Fourier features of the standardised statistics approximate
a Gaussian kernel; every partition of the training rows adds up its own normal equations, whose sum is solved for a
ridge score. Scores of a fold that the fit has not seen, counted in a fixed number of bins, give an isotonic curve
that turns a score into a probability.

Training rows are a bounded sample (max_rows, by hash of doc_id, so the same rows whatever the partitioning); the
statistics and scores are of all texts, whole. doc_id, labels, lang and source are no input of a score.

Defined cases: null text counts as empty and is scored from its statistics like any other. Without a label on either
side every score is the mean of the labels there are (1.0 without any). Labels other than 0 and 1, null ones and those
of null doc_id train nothing; a doc_id with both labels trains both. Null doc_id is not held out. Repeated rows are
scored each for itself.
"""

from __future__ import annotations

import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import cut

FEATURES, WIDTH, RIDGE, SEED = 256, 1.0, 1e-2, 7
MAX_ROWS, TRAIN_TASKS, BINS = 60_000, 8, 512
#: Fold of crc32(doc_id) mod 4 that is held out, and the one that calibrates.
HELD_OUT, CALIBRATE = 2, 3
THRESHOLD = 0.7
NAMES = (
    "log_words word_length word_spread distinct top_share repeats repeat_pairs line_words lines_distinct upper_words "
    "symbol_words bang_words bars symbols digits upper letters spaces non_ascii stops commas short long entropy"
).split()


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n, chars = len(words), len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    top = max(counts.values())
    raw = np.frombuffer(text.encode(), np.uint8)
    seen = np.bincount(raw, minlength=256)
    of = lambda s: sum(int(seen[ord(c)]) for c in s) / chars
    lines = [x for x in text.split("\n") if x.strip()]
    share = seen[seen > 0] / len(raw)
    last = Counter(w[-1] for w in words)
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.std()),
        len(counts) / n**0.9,
        top / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,  # noqa: B905
        1 - len(set(zip(words, words[1:]))) / max(1, n - 1),  # noqa: B905
        float(np.log1p(n / max(1, len(lines)))),
        len(set(lines)) / max(1, len(lines)),
        sum(map(str.isupper, words)) / n,
        sum(last[c] for c in "*#$%&~^_=+<>") / n,
        last["!"] / n,
        counts["|"] / n,
        of("*#$%&@~^_=+<>{}[]\\/"),
        of("0123456789"),
        sum(int(seen[c]) for c in range(65, 91)) / chars,
        sum(int(seen[c]) for c in range(97, 123)) / chars,
        of(" \n\t"),
        1 - sum(int(seen[c]) for c in range(128)) / len(raw),
        sum(last[c] for c in ".?") / n,
        last[","] / n,
        float((lengths <= 2).mean()),
        float((lengths >= 15).mean()),
        float(-(share * np.log2(share)).sum()),
    ]


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, stats of every text. Narrow: no shuffle."""
    keep = ("doc_id", *keep)
    docs = docs.select(*keep, "text")

    def run(batches):
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(stats, pa.list_(pa.float64()))], [*keep, "stats"])

    return docs.mapInArrow(run, ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep), "stats array<double>"]))


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    """Of the Fourier features and a constant."""
    edges: np.ndarray
    curve: np.ndarray
    """Probability at edges, a rising curve over scores."""

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.curve), 0.0, 1.0)


def fourier(z: np.ndarray) -> np.ndarray:
    """Random features whose inner products approximate a Gaussian kernel of width WIDTH * sqrt(dimensions)."""
    rng = np.random.default_rng(SEED)
    d = z.shape[1]
    w = rng.standard_normal((d, FEATURES)) / (WIDTH * np.sqrt(d))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(np.clip(z, -8, 8) @ w + b), np.ones((len(z), 1))])


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


class Sample(NamedTuple):
    """The labelled rows that may train, and which of them do."""

    labels: DataFrame
    """doc_id, y, fold."""
    n: int
    ones: float
    chosen: Column
    """The condition on doc_id of a share of rows that comes to max_rows at most, about."""

    def only(self) -> float | None:
        """The score of every text where one side has no label."""
        return None if 0 < self.ones < self.n else self.ones / self.n if self.n else 1.0


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Sample:
    """Of docs only doc_id is read."""
    valid = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("y")).distinct().withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD_OUT)
    n, ones = docs.select("doc_id").join(valid, "doc_id").agg(F.count("*"), F.sum("y")).first()
    share = min(1.0, max_rows / n) if n else 1.0
    return Sample(valid, n, ones or 0.0, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * share))


def train(rows: DataFrame, chosen: Sample) -> Model | float:
    """rows(doc_id, stats, y, fold) of a sample. A number instead of a model where one side has no label."""
    if (only := chosen.only()) is not None:
        return only
    rows = cut(rows.select("doc_id", "stats", "y", "fold"), "train")
    n, ones = chosen.n, chosen.ones
    width = len(NAMES)
    moments = [f(F.col("stats")[k]) for k in range(width) for f in (F.avg, F.stddev_pop)]
    got = np.array(rows.where(F.col("fold") != CALIBRATE).agg(*moments).first(), dtype=float).reshape(width, 2)
    got = np.nan_to_num(got)
    mean, scale = got[:, 0], np.maximum(got[:, 1], 1e-6)

    def sums(batches):
        a, c = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            if batch.num_rows:
                x = fourier((np.array(batch["stats"].to_pylist()) - mean) / scale)
                y = batch["y"].to_numpy()
                weight = np.where(y > 0.5, 0.5 / share_one, 0.5 / (1 - share_one))
                a += x.T @ (x * weight[:, None])
                c += x.T @ (weight * y)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["a", "c"])

    share_one = ones / n
    # TRAIN_TASKS sums of fixed size reach the driver, whatever the number of rows.
    parts = rows.where(F.col("fold") != CALIBRATE).select("stats", "y").repartition(TRAIN_TASKS).mapInArrow(sums, "a binary, c binary").collect()
    a = sum(np.frombuffer(p["a"]).reshape(FEATURES + 1, -1) for p in parts)
    c = sum(np.frombuffer(p["c"]) for p in parts)
    ridge = RIDGE * np.trace(a) / len(a) * np.eye(len(a))
    weights = np.linalg.solve(a + ridge, c)
    plain = Model(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def scored(batches):
        for batch in batches:
            raw = plain.raw(np.array(batch["stats"].to_pylist()).reshape(-1, width))
            bins = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch["y"]], ["bin", "y"])

    # At most BINS rows.
    curve = rows.where(F.col("fold") == CALIBRATE).select("stats", "y").mapInArrow(scored, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect()
    if not curve:
        return plain
    bins = sorted((r["bin"], r["n"], r["ones"]) for r in curve)
    edges = (np.array([b for b, _, _ in bins]) + 0.5) / BINS * 2 - 0.5
    return plain._replace(edges=edges, curve=isotonic([o / n for _, n, o in bins], [n for _, n, _ in bins]))


def isotonic(values: list[float], weights: list[float]) -> np.ndarray:
    """The rising sequence nearest to values in weighted squares, by pooling adjacent violators."""
    pools: list[list[float]] = []  # mean, weight, places
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools])


def score(stats: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, score from stats(doc_id, stats). Narrow: no shuffle."""

    def run(batches):
        for batch in batches:
            x = np.array(batch["stats"].to_pylist()).reshape(-1, len(NAMES))
            s = model.score(x) if isinstance(model, Model) else np.full(len(x), float(model))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s, pa.float64())], ["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    stats, chosen = cut(measure(docs), "stats"), sample(docs, labels)
    return score(stats, train(stats.where(chosen.chosen).join(chosen.labels, "doc_id"), chosen)).select(
        "doc_id",
        (F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) == HELD_OUT)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score at or above the threshold, with all columns. Training measures its sample only, then each text is measured once."""
    chosen = sample(docs, labels)
    labelled = docs.select("doc_id", "text").where(chosen.chosen & (fold(F.col("doc_id")) != HELD_OUT)).join(chosen.labels, "doc_id")
    model = train(measure(labelled, "y", "fold"), chosen)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t.as_py()) for t in batch.column(at)])
                s = model.score(x) if isinstance(model, Model) else np.full(len(x), float(model))
                yield batch.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == HELD_OUT
