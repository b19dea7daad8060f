"""Toxicity of texts whose words may be disguised.

A noisy channel turns words into leetspeak, letters set apart, and letters repeated. Each
suspicious token becomes a lattice of what its characters may stand for; the Viterbi path
under a character language model, counted on the whole corpus, is the restored word. Restored
words are scored by how much more often they, or their beginnings, stand in documents
labelled toxic; a text's strongest words go through a fitted logistic curve.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerspark.llm.compression import labelled, logistic
from fingerspark.llm.texts import empty, map_texts, slices

# Letters that digits and signs stand for, and signs put between letters.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
            "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
SEPARATORS = " .-_*/\\'~,:;+|​­"
EDGES = ".,;:!?\"'()[]{}<>|*#&%$-_/"

#: Symbols of the language model: 0 ends words, 1 to 26 are a to z, the rest share 37 by code.
SYMBOLS = 64
OTHER = 27
#: Weight of the shorter context in the model, and costs of a reading and of what is skipped.
BACKOFF = 5.0
READING, SKIP, REPEAT = -1.0, -0.3, -0.3
#: Labelled documents of each class that are learned from at most.
DOCUMENTS = 8_000
#: Beginnings of words that count as features; how sure and how telling a feature must be.
PREFIXES = (4, 5, 6, 7)
LEAST_DOCUMENTS, DEVIATIONS, LEAST_WEIGHT = 3, 1.5, 2.0
#: Features kept, the most telling first.
MOST_FEATURES = 50_000
CACHE = 200_000
STRONGEST = 3

TRIPLE = re.compile(r"(.)\1\1")
SIGN = rf"[\w{re.escape(''.join(READINGS))}]"
SPACED = re.compile(rf"(?<!\S)(?:{SIGN} ){{2,}}{SIGN}(?!\S)")
PART = re.compile(r"[^\W\d_]+")
FOUND = T.StructType([T.StructField("features", T.ArrayType(T.StringType()))])
EVIDENCE = T.StructType([T.StructField("strongest", T.ArrayType(T.DoubleType())), T.StructField("count", T.LongType()),
                         T.StructField("words", T.LongType())])
SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("strongest", T.ArrayType(T.StringType()))])


def symbol_table() -> np.ndarray:
    """Symbol of each code below 0x10000; letters have one, all else ends a word."""
    codes = np.zeros(0x10000, np.int64)
    for code in range(0x10000):
        letter = chr(code)
        if "a" <= letter <= "z":
            codes[code] = code - 96
        elif code >= 0x80 and letter.isalpha():
            codes[code] = OTHER + code % (SYMBOLS - OTHER)
    return codes


def symbols_of(text: str, table: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return table[np.where(codes < 0x10000, codes, 0)]


def count_characters(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts of all three-letter sequences in all texts: (sequence, n).

    A task adds up its texts in one array and emits it once, so what is shuffled is bounded
    by tasks times sequences.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = symbol_table(), np.zeros(SYMBOLS ** 3, np.int64)
        for batch in batches:
            for part in slices(batch):
                read = symbols_of("  " + "  ".join([empty(t) for t in part.column(0).to_pylist()]).lower() + "  ", table)
                if len(read) > 2:
                    three = (read[:-2] * SYMBOLS + read[1:-1]) * SYMBOLS + read[2:]
                    counts += np.bincount(three[(read[1:-1] > 0) | (read[2:] > 0)], minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["sequence", "n"])

    parts = df.select(text).mapInArrow(run, "sequence bigint, n bigint")
    return parts.groupBy("sequence").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """Log probability of the third symbol after the first two, flat; at most SYMBOLS³ rows are read."""
    n = np.zeros(SYMBOLS ** 3)
    for row in counts.collect():
        n[row["sequence"]] = row["n"]
    three = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + BACKOFF * p1) / (two.sum(axis=1, keepdims=True) + BACKOFF)
    p3 = (three + BACKOFF * p2[None]) / (three.sum(axis=2, keepdims=True) + BACKOFF)
    return np.log(p3).astype(np.float32).ravel()


def letters_of(path: tuple | None) -> list[str]:
    """The letters of a chain, which has the last one outside."""
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return letters[::-1]


class Decoder:
    """Restores words by the best path through their lattices."""

    def __init__(self, model: np.ndarray):
        self.cost = model.tolist()
        self.table = symbol_table()

    def symbol(self, letter: str) -> int:
        code = ord(letter)
        return int(self.table[code]) if code < 0x10000 else 0

    def options(self, token: str, ends: bool = False) -> Iterator[list[tuple[str, float]]]:
        """For each character what it may stand for, an empty string for nothing, with log weights.

        With ``ends`` a space may also end a word.
        """
        before = ""
        for c in token:
            if c.isalpha():
                here = [(c, 0.0)]
                if c == before:
                    here.append(("", REPEAT))
            else:
                here = [(r, READING) for r in READINGS.get(c, "")]
                if c in SEPARATORS or not here:
                    here.append(("", SKIP))
                elif c == before:
                    here.append(("", REPEAT))
                if ends and c == " ":
                    here.append((" ", 0.0))
            yield here
            before = c

    def restore(self, token: str, ends: bool = False) -> str:
        """The likeliest word behind a token, under the language model; with ``ends``, words.

        A path is a chain of its letters, so that a step costs the same at any length; where
        all paths meet in one state, what they have so far is settled.
        """
        cost, n = self.cost, SYMBOLS
        settled: list[str] = []
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for here in self.options(token, ends):
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            read = [(letter, weight, self.symbol(letter) if letter else 0) for letter, weight in here]
            for (a, b), (total, path) in paths.items():
                for letter, weight, s in read:
                    if letter:
                        key, sum_, longer = (b, s), total + weight + cost[(a * n + b) * n + s], (path, letter)
                    else:
                        key, sum_, longer = (a, b), total + weight, path
                    if key not in following or sum_ > following[key][0]:
                        following[key] = sum_, longer
            paths = following
            if len(paths) == 1:
                [(key, (total, path))] = paths.items()
                settled += letters_of(path)
                paths = {key: (total, None)}
        best = max(((total + cost[(a * n + b) * n], path) for (a, b), (total, path) in paths.items()), key=lambda p: p[0])
        return "".join(settled + letters_of(best[1]))

    def words(self, token: str) -> list[str]:
        """The words a lower-cased token may hold: itself, or its parts and what is restored of it."""
        if token.isalpha() and not TRIPLE.search(token):
            return [token]
        bare = token.rstrip(EDGES).lstrip(EDGES.replace("$", "").replace("*", ""))
        if bare.isalpha() and not TRIPLE.search(bare):
            return [bare]
        parts = PART.findall(bare)
        return [*parts, self.restore(bare)] if parts else parts

    def apart(self, token: str) -> list[str]:
        """The words that a token of letters set apart by spaces may hold, if its spaces also end words."""
        bare = token.rstrip(EDGES).lstrip(EDGES.replace("$", "").replace("*", ""))
        return self.restore(bare, ends=True).split() if " " in bare and PART.search(bare) else []


def tokens_of(text: str | None) -> list[str]:
    """Lower-cased tokens, letters set apart by spaces brought together into one more."""
    split = empty(text).lower().split()
    together = SPACED.findall(" ".join(split))
    return [*split, *together]


def features_of(word: str) -> list[str]:
    """A word, and the beginnings of longer ones."""
    return [word, *[f"{word[:n]}~" for n in PREFIXES if len(word) > n]]


@dataclass(frozen=True)
class Model:
    """Language model, weights of features, and the calibration."""

    characters: np.ndarray
    lexicon: dict[str, float]
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


class Scorer:
    def __init__(self, characters: np.ndarray, lexicon: dict[str, float]):
        self.decoder, self.lexicon = Decoder(characters), lexicon
        self.starts = {f.rstrip("~")[:min(PREFIXES)] for f in lexicon}
        self.cache: dict[str, list[tuple[float, str]]] = {}

    def strongest(self, words: list[str]) -> list[tuple[float, str]]:
        """The largest weight of a feature of the words, and that word; nothing if none has one."""
        best = (0.0, "")
        for word in words:
            if word[:min(PREFIXES)] in self.starts:
                best = max([best, *[(self.lexicon.get(f, 0.0), word) for f in features_of(word)]])
        return [best] if best[0] > 0 else []

    def weigh(self, token: str) -> list[tuple[float, str]]:
        """The telling words of a token with their weights: one at most, but for letters set apart."""
        several = [found for word in sorted(set(self.decoder.apart(token))) for found in self.strongest([word])]
        return several or self.strongest(self.decoder.words(token))

    def evidence(self, text: str | None) -> tuple[list[tuple[float, str]], int, int]:
        """The strongest different words, the number of telling tokens, and of all tokens."""
        tokens = tokens_of(text)
        cache, found, count = self.cache, {}, 0
        if len(cache) > CACHE:
            cache.clear()
        for token in set(tokens):
            seen = cache.get(token)
            if seen is None:
                seen = cache[token] = self.weigh(token)
            count += len(seen)
            found.update((word, weight) for weight, word in seen)
        return sorted(((w, word) for word, w in found.items()), reverse=True)[:STRONGEST], count, len(tokens)


def measures(strongest: list[list[float]], count: list[int]) -> np.ndarray:
    most = np.array([s[0] if s else 0.0 for s in strongest])
    return np.column_stack([most, np.array([sum(s) for s in strongest]), np.log1p(np.array(count, dtype=float))])


def learn_lexicon(known: DataFrame, characters: np.ndarray, text: str, label: str = "label") -> dict[str, float]:
    """Weights of the features that toxic documents have far more often.

    A feature's weight is the log of the ratio of its document rates, taken as low as chance
    may explain, so that rare features weigh little.
    """
    shared = known.sparkSession.sparkContext.broadcast(characters)

    def start():
        decoder = Decoder(shared.value)

        def features(t: str | None) -> tuple[list[str]]:
            words = {w for token in set(tokens_of(t)) for w in (*decoder.words(token), *decoder.apart(token))}
            return (sorted({f for w in words for f in features_of(w)}),)
        return lambda texts: [features(t) for t in texts]

    each = map_texts(known, text, "found", FOUND, start, [label])
    totals = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return {}
    counted = each.select(label, F.explode("found.features").alias("feature")).groupBy("feature").agg(
        F.sum(label).alias("t"), F.sum(1 - F.col(label)).alias("c")).filter(F.col("t") >= LEAST_DOCUMENTS)
    low = F.col("t") - DEVIATIONS * F.sqrt("t") + 0.5
    high = F.col("c") + DEVIATIONS * F.sqrt("c") + 2.0
    weight = F.log(low / toxic) - F.log(high / clean)
    rows = counted.select("feature", weight.alias("w")).filter(F.col("w") > LEAST_WEIGHT).orderBy(
        F.desc("w"), "feature").limit(MOST_FEATURES).collect()
    return {r["feature"]: r["w"] for r in rows}


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", most: int = DOCUMENTS) -> Model | None:
    """Count the language model on all documents; learn words on half of the labelled ones,
    and the calibration on the other half. None where a class has no labelled text."""
    characters = language_model(count_characters(docs, text))
    known = labelled(docs, labels, doc_id, text, label, most)
    lexicon = learn_lexicon(known.filter("part = 0"), characters, "text")
    shared = known.sparkSession.sparkContext.broadcast((characters, lexicon))

    def start():
        evidence = Scorer(*shared.value).evidence

        def one(t):
            strongest, count, words = evidence(t)
            return [w for w, _ in strongest], count, words
        return lambda texts: [one(t) for t in texts]

    rows = map_texts(known.filter("part = 1"), "text", "evidence", EVIDENCE, start, ["_id", "label"]).collect()
    rows = sorted(rows, key=lambda r: r["_id"])
    y = np.array([r["label"] for r in rows], dtype=float)
    totals = {r["label"]: r["n"] for r in labels.select(F.col(label).cast("int").alias("label")).dropna().groupBy(
        "label").agg(F.count("*").alias("n")).collect()}
    if len(set(y)) < 2:
        return None
    x = measures([r["evidence"]["strongest"] for r in rows], [r["evidence"]["count"] for r in rows])
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (1 - y).sum())
    return Model(characters, lexicon, centre, scale, logistic((x - centre) / scale, y, weight * len(y) / weight.sum()))


def with_toxicity(df: DataFrame, model: Model | None, text: str = "text", into: str = "toxicity",
                  keep: list[str] | None = None) -> DataFrame:
    """Add struct ``into`` with ``score``, from 0 to 1, and the strongest restored words.

    Whole texts are read. A null or empty text has no telling words and gets the lowest
    score; without a model every text gets 0. Rows are independent, so repeated rows get
    equal scores and an empty table stays empty. ``keep`` names the columns to pass on, all
    by default; a column called ``into`` is replaced.
    """
    parts = model and (model.characters, model.lexicon, model.centre, model.scale, model.weights)
    shared = df.sparkSession.sparkContext.broadcast(parts)

    def start():
        if shared.value is None:
            return lambda texts: [(0.0, []) for _ in texts]
        characters, lexicon, centre, scale, weights = shared.value
        scorer = Scorer(characters, lexicon)

        def step(texts: list) -> list[tuple]:
            found = [scorer.evidence(t) for t in texts]
            x = (measures([[w for w, _ in s] for s, _, _ in found], [c for _, c, _ in found]) - centre) / scale
            scores = 1 / (1 + np.exp(-np.clip(x @ weights[1:] + weights[0], -30, 30)))
            return [(float(p), [word for _, word in s]) for p, (s, _, _) in zip(scores, found)]
        return step

    return map_texts(df, text, into, SCORE, start, keep)
