"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled text. Text
compresses better with the dictionary of its kind: the difference of both compressed sizes
over the plain size, with the size that no dictionary gives, goes through a logistic curve
fitted to labelled documents that the dictionaries have not seen.
"""

from __future__ import annotations

import random
from dataclasses import astuple, dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerspark.llm.texts import bounded_ids, empty, map_texts

#: Bytes compressed at a time; a text is the sum of its blocks, so every part counts alike.
BLOCK = 2048
#: Labelled documents of each class that the model is fitted on at most, and blocks taken
#: from one of them for a dictionary at most. They bound what reaches the driver.
DOCUMENTS = 2_000
DOCUMENT_BLOCKS = 8
DICTIONARY = 48 << 10
LEVEL = 3
RIDGE = 1e-3
STEPS = 60
SEED = 7

SIZES = T.StructType([T.StructField(n, T.LongType()) for n in ("raw", "plain", "good", "bad")])
SAMPLE = T.StructType([T.StructField("blocks", T.ArrayType(T.BinaryType()))])
SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def blocks_of(text: str | None) -> list[bytes]:
    data = empty(text).encode("utf-8", "surrogatepass")
    return [data[at:at + BLOCK] for at in range(0, len(data), BLOCK)]


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on all samples. Where they are too few to train one they count several times."""
    for times in (1, 4, 16, 64, 256):
        try:
            return zstandard.train_dictionary(DICTIONARY, samples * times, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            continue
    return b""


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.of = []
        for data in (good, bad):
            ready = zstandard.ZstdCompressionDict(data) if data else None
            if ready is None:
                self.of.append(self.plain)
                continue
            ready.precompute_compress(level=LEVEL)
            self.of.append(zstandard.ZstdCompressor(dict_data=ready, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str | None) -> tuple[int, int, int, int]:
        """Bytes of the text, and compressed plainly and with either dictionary."""
        blocks = blocks_of(text)
        return (sum(map(len, blocks)), *[sum(len(c.compress(b)) for b in blocks) for c in (self.plain, *self.of)])


def features(sizes: np.ndarray) -> np.ndarray:
    """Normalised difference, its square, and plain size; zeros for an empty text."""
    raw = np.maximum(sizes[:, 0], 1)
    difference = (sizes[:, 3] - sizes[:, 2]) / raw
    plain = np.where(sizes[:, 0] > 0, sizes[:, 1] / raw, 1.0)
    return np.column_stack([difference, difference * np.abs(difference), plain])


@dataclass(frozen=True)
class Model:
    """What scores a text: two dictionaries and the calibration of their features."""

    good: bytes
    bad: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, sizes: np.ndarray) -> np.ndarray:
        x = (features(sizes) - self.centre) / self.scale
        x[sizes[:, 0] == 0] = 0.0                            # nothing to judge: the average document
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights, the constant first, of a weighted ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge = RIDGE * weight.sum() * np.diag([0.0, *np.ones(x.shape[1] - 1)]) + 1e-9 * np.eye(x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(bend, slope)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """(id, text, label, part) of at most ``most`` labelled documents of each class.

    Half of them, by hash, are part 0 and half part 1. The ids are bounded, so they can be
    broadcast and no text is shuffled.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label")).dropna()
    ids = None
    for value in (0, 1):
        some = bounded_ids(known.filter(F.col("label") == value).select("_id"), most, f"{label}{value}")
        some = some.withColumn("label", F.lit(value))
        ids = some if ids is None else ids.unionByName(some)
    part = F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(2)).cast("int")
    return docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text")).join(
        F.broadcast(ids), F.col("_doc") == F.col("_id")).select("_id", "text", "label", part.alias("part"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", most: int = DOCUMENTS) -> Model | None:
    """Fit dictionaries and calibration; None where a class has no labelled text."""
    known = labelled(docs, labels, doc_id, text, label, most)

    def sample():
        def step(texts: list) -> list[tuple]:
            out = []
            for t in texts:
                blocks = blocks_of(t)
                chosen = random.Random(f"{SEED}:{len(blocks)}").sample(range(len(blocks)), min(len(blocks), DOCUMENT_BLOCKS))
                out.append(([blocks[i] for i in sorted(chosen)],))
            return out
        return step

    rows = map_texts(known.filter("part = 0"), "text", "sample", SAMPLE, sample, ["_id", "label"]).collect()
    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for row in sorted(rows, key=lambda r: r["_id"]):
        samples[row["label"]] += [bytes(b) for b in row["sample"]["blocks"]]
    if not samples[0] or not samples[1]:
        return None
    good, bad = dictionary(samples[1]), dictionary(samples[0])
    rows = with_sizes(known.filter("part = 1"), good, bad, "text", ["_id", "label"]).collect()
    rows = sorted(rows, key=lambda r: r["_id"])
    sizes = np.array([list(r["sizes"]) for r in rows], dtype=float).reshape(-1, 4)
    y = np.array([r["label"] for r in rows], dtype=float)
    # Classes were sampled; weights bring back how often each occurs.
    totals = {r["label"]: r["n"] for r in labels.select(F.col(label).cast("int").alias("label")).dropna().groupBy(
        "label").agg(F.count("*").alias("n")).collect()}
    weight = np.where(y == 1, totals.get(1, 0) / max(1, y.sum()), totals.get(0, 0) / max(1, (1 - y).sum()))
    x = features(sizes)
    centre = x.mean(axis=0) if len(x) else np.zeros(3)
    scale = np.maximum(x.std(axis=0), 1e-9) if len(x) else np.ones(3)
    if len(set(y)) < 2:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        weights = np.array([np.log(share / (1 - share)), 1.0, 0.0, 0.0])
    else:
        weights = logistic((x - centre) / scale, y, weight * len(y) / weight.sum())
    return Model(good, bad, centre, scale, weights)


def with_sizes(df: DataFrame, good: bytes, bad: bytes, text: str, keep: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((good, bad))

    def start():
        sizes = Compressors(*shared.value).sizes
        return lambda texts: [sizes(t) for t in texts]

    return map_texts(df, text, "sizes", SIZES, start, keep)


def with_quality(df: DataFrame, model: Model | None, text: str = "text", into: str = "quality",
                 keep: list[str] | None = None) -> DataFrame:
    """Add struct ``into`` with ``score``, from 0 to 1, higher for good text.

    Whole texts are compressed, block by block. A null or empty text gets the score of an
    average document; without a model every text gets 0.5. Rows are independent, so repeated
    rows get equal scores and an empty table stays empty. ``keep`` names the columns to pass
    on, all by default; a column called ``into`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model and astuple(model))

    def start():
        if shared.value is None:
            return lambda texts: [(0.5,) for _ in texts]
        ready = Model(*shared.value)
        sizes = Compressors(ready.good, ready.bad).sizes

        def step(texts: list) -> list[tuple]:
            measured = np.array([sizes(t) for t in texts], dtype=float).reshape(-1, 4)
            return [(float(s),) for s in ready.score(measured)]
        return step

    return map_texts(df, text, into, SCORE, start, keep)
