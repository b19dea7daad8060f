"""The learned operators against plain recomputation: best paths of short lattices, scores by compression."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from fingerspark.llm import compression, toxicity


def test_restored_words_are_the_best_of_all_paths():
    """Every path of the lattices of short tokens, scored letter by letter."""
    rng, draw = np.random.default_rng(3), random.Random(3)
    model = np.log(rng.dirichlet(np.full(toxicity.SYMBOLS, 0.3), toxicity.SYMBOLS ** 2) + 1e-9).astype(np.float32).ravel()
    decoder, n = toxicity.Decoder(model), toxicity.SYMBOLS
    for _ in range(400):
        token = "".join(draw.choice("ab1$@3. *6xx") for _ in range(draw.randrange(1, 7)))
        ends = draw.random() < 0.5
        scores: dict[str, float] = {}
        for path in itertools.product(*decoder.options(token, ends)):
            total, a, b = 0.0, 0, 0
            for letter, weight in path:
                total += weight
                if letter:
                    s = decoder.symbol(letter)
                    total, a, b = total + decoder.cost[(a * n + b) * n + s], b, s
            total += decoder.cost[(a * n + b) * n]
            word = "".join(letter for letter, _ in path)
            scores[word] = max(scores.get(word, -math.inf), total)
        assert scores[decoder.restore(token, ends)] == pytest.approx(max(scores.values()), abs=1e-4), token


@pytest.fixture(scope="module")
def labelled_texts(spark):
    draw = random.Random(5)
    good = ["harbour", "granite", "meadow", "lantern", "orchard", "pebble", "window", "river"]
    bad = ["click", "buy", "now", "win$$", "free!!", "cheap", "offer", "prize"]
    rows = [(i, " ".join(draw.choice(good if i % 3 else bad) for _ in range(draw.randrange(20, 90)))) for i in range(600)]
    rows += [(900, None), (901, ""), (902, "buy now " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    return docs, labels


def test_quality_is_that_of_sizes_compressed_by_hand(spark, labelled_texts):
    docs, labels = labelled_texts
    model = compression.train(docs, labels)
    ready = []
    for data in (model.good, model.bad):
        dictionary = zstandard.ZstdCompressionDict(data)
        ready.append(lambda b, d=dictionary: len(zstandard.ZstdCompressor(
            level=compression.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(b)))
    plain = zstandard.ZstdCompressor(level=compression.LEVEL, write_content_size=False)
    scored = {r.doc_id: r for r in compression.with_quality(docs.withColumn("quality", F.lit("clash")), model).collect()}
    assert len(scored) == docs.count()
    for i in (0, 1, 2, 450, 451, 599, 902):
        data = scored[i].text.encode()
        blocks = [data[k:k + compression.BLOCK] for k in range(0, len(data), compression.BLOCK)]
        sizes = [len(data), sum(len(plain.compress(b)) for b in blocks), *[sum(map(f, blocks)) for f in ready]]
        difference = (sizes[3] - sizes[2]) / sizes[0]
        x = (np.array([difference, difference * abs(difference), sizes[1] / sizes[0]]) - model.centre) / model.scale
        want = 1 / (1 + math.exp(-(model.weights[0] + x @ model.weights[1:])))
        assert scored[i].quality.score == pytest.approx(want, abs=0.02), i
    held = [scored[i] for i in range(400, 600)]
    right = sum((r.quality.score >= 0.5) == (r.doc_id % 3 > 0) for r in held)
    assert right >= 0.95 * len(held)
    assert scored[900].quality.score == scored[901].quality.score


def test_a_dictionary_comes_of_few_samples():
    for samples in ([b"abc"], [b"hello world " * 10], [b"text %d" % i for i in range(20)]):
        assert len(compression.dictionary(samples)) > 0
