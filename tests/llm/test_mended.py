"""Cases that once went wrong: word ends, many marks, many short items, ids of other types, groups of copies."""

from __future__ import annotations

import random
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from fingerspark.llm import decontamination, jaccard, mixing, rules, secrets


def test_words_before_line_ends_of_other_kinds(spark):
    texts = ["a  ", "a \u0085", "a b  ", "a ", "   ", " ", "a \n", "\v a\u0085 ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select("text", mixing.word_count(F.col("text")).alias("n"), F.size(rules.words_of(F.col("text"))).alias("m")).collect()
    for r in got:
        want = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert (r.n, r.m) == (want, want), ascii(r.text)


def test_a_text_full_of_marks_is_scanned_in_one_pass():
    for mark in ("-----BEGIN PRIVATE KEY-----\n", "-----END PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----MII\n"):
        text = mark * (1_000_000 // len(mark))
        start = time.perf_counter()
        counts = secrets.find(text, "x")
        assert time.perf_counter() - start < 5 and "pem" not in counts[4]


def test_marks_pair_with_their_nearest_neighbour():
    text = ("-----BEGIN A PRIVATE KEY-----one-----BEGIN B PRIVATE KEY-----two-----END B PRIVATE KEY-----"
            "-----END B PRIVATE KEY----------BEGIN C PRIVATE KEY-----th!ree-----END C PRIVATE KEY-----")
    assert [body for _, _, body in secrets.labelled_blocks(text)] == ["two"]


def test_no_block_of_items_has_more_words_than_letters(spark):
    draw = random.Random(1)
    for words in (1, 5, 12, 13, 14, 300):
        for size in (1, 13, 50):
            text = " ".join(f"w{draw.random()}".replace(".", "") for _ in range(words))
            for piece, room in decontamination.pieces_of(text, size, 40):
                assert len(piece.split()) <= decontamination.WORDS_A_WINDOW * room
    most = decontamination.WORDS_A_WINDOW * decontamination.MOST_WINDOWS
    assert most < decontamination.LAST - decontamination.FIRST
    items = [(str(i), " ".join(f"i{i}w{k}" for k in range(12))) for i in range(400)]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, (_, t) in enumerate(items)], "doc_id int, text string")
    listed = spark.createDataFrame(items, "item_id string, text string")
    blocks = list(decontamination.blocks(listed.withColumnRenamed("item_id", "item"), 13, 100))
    assert len(blocks) > 1 and sum(map(len, blocks)) == 400
    hits = decontamination.benchmark_hits(docs, listed, most_windows=100).collect()
    assert {(str(r.doc_id), *r.hits["items"]) for r in hits} == {(i, i) for i, _ in items}


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(texts):
    """Members of each class by comparing all pairs."""
    sets = {i: grams(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    out = defaultdict(set)
    for i in ids:
        out[root(i)].add(i)
    return sorted(map(sorted, out.values()))


def test_groups_of_near_copies_by_any_id(spark):
    """Chains, stars and a group whose members link with few of each other; ids are texts."""
    draw = random.Random(7)

    def changed(text, times):
        words = text.split()
        for _ in range(times):
            words[draw.randrange(len(words))] = f"c{draw.randrange(10**6)}"
        return " ".join(words)

    base = " ".join(f"w{draw.randrange(3000)}" for _ in range(150))
    texts = [changed(base, draw.randrange(5)) for _ in range(150)]           # many link with some others only
    chain = " ".join(f"v{draw.randrange(3000)}" for _ in range(120))
    for _ in range(25):
        texts.append(chain)
        chain = changed(chain, 2)
    shared = " ".join(f"s{k}" for k in range(40))                              # a passage that many share
    texts += [f"{shared} " + " ".join(f"u{draw.randrange(10**6)}" for _ in range(60)) for _ in range(80)]
    texts += [" ".join(f"p{draw.randrange(10**5)}" for _ in range(draw.randrange(1, 30))) for _ in range(40)] + ["", None]
    texts.append(" ".join(f"q{draw.randrange(9000)}" for _ in range(60_000)))
    named = {f"id-{i:04d}": t for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t, 1) for i, t in named.items()], "doc_id string, text string, entity int").repartition(6)
    got = defaultdict(set)
    for r in jaccard.with_components(df).collect():
        got[r.component_id].add(r.doc_id)
        assert r.n_shingles == len(grams(named[r.doc_id]))
    assert all(min(members) == label for label, members in got.items())
    assert sorted(map(sorted, got.values())) == classes(named)
