"""The operators against brute force, and on nulls, empty and long texts, ties and clashing names."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerspark.llm import (compression, decontamination, jaccard, licences, mixing, rules, secrets, texts, toxicity,
                             urls, warc)

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TOKENS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(draw, n, words=400):
    return " ".join(f"w{draw.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Odd rows: nulls in any column, empty and very long texts, repeated rows, near copies."""
    draw = random.Random(3)
    base = [prose(draw, 60) for _ in range(40)]
    out = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    for i, t in enumerate(base[:12]):                        # one word changed, then exact copies
        words = t.split()
        words[30] = "changed"
        out.append((100 + i, " ".join(words), "en", "s1", 1))
        out.append((200 + i, t.upper(), None, None, None))
    out += [(300, None, "en", "s0", 0), (301, "", None, "s0", 0), (302, " \t\n ", "en", None, 4), (None, "no id here " * 8, "en", "s2", 1),
            (None, None, None, None, None), (303, "tiny", "en", "s2", 4), (303, "tiny", "en", "s2", 4),
            (304, prose(draw, 60_000, 5_000), "en", "s3", 1), (305, "ünïcödé 😀 words " * 30, "de", "s3", 1),
            (306, "\n".join(["same line of words here"] * 9), "en", "s3", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words_are_those_of_the_patterns():
    draw = random.Random(1)
    for _ in range(3000):
        text = "".join(chr(draw.choice([draw.randrange(128), draw.randrange(0x300), 0x130, 0x212A, 0x1F600])) for _ in range(30))
        assert [w.decode() for w in texts.tokens_of(text)] == TOKENS.findall(lower(text))
        assert [m.span() for m in decontamination.WORDS.finditer(text)] == [m.span() for m in TOKENS.finditer(lower(text))]


# --- quality rules

def expected_rules(text):
    text = text or ""
    words = SPACED.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
            len(words) < 10 or 100 * len(repeated) > 20 * len(words))


def test_rules_count_as_brute_force(spark, docs, rows):
    found = rules.with_rules(docs, docs.filter("doc_id < 20").select("doc_id")).select("text", "rules.*").collect()
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == expected_rules(r["text"])
        assert r["kept"] == (not r["base_failed"] and r["log_ratio"] >= rules.THRESHOLD)


def test_log_ratio_is_that_of_the_two_multinomials(spark, docs):
    import zlib
    trusted = {r["doc_id"] for r in docs.filter("doc_id < 20").collect()}
    raw, target = Counter(), Counter()

    def grams(text):
        crc = [zlib.crc32(w.encode()) for w in SPACED.findall(text or "")]
        return [c % rules.BUCKETS for c in crc] + [(a * rules.PAIR_FACTOR + b) % rules.BUCKETS for a, b in zip(crc, crc[1:])]

    for r in docs.collect():
        raw.update(grams(r["text"]))
        if r["doc_id"] in trusted:
            target.update(grams(r["text"]))
    n, m = sum(raw.values()), sum(target.values())
    for r in rules.with_rules(docs, docs.filter("doc_id < 20").select("doc_id")).select("text", "rules.log_ratio").collect():
        g = grams(r["text"])
        exact = np.mean([np.log((target[b] + rules.PRIOR) / (raw[b] * m / n + rules.PRIOR)) for b in g]) if g else 0.0
        assert abs(r["log_ratio"] - exact) < 1e-4


@pytest.mark.parametrize("threshold", ["10m", "-1"])        # broadcast, and not
def test_all_trusted_documents_are_counted(spark, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = spark.range(21_000).select(F.col("id").alias("doc_id"), F.format_string("w%d x", F.col("id") % 7).alias("text"))
        trusted = df.filter("doc_id < 20500").select("doc_id")
        got = rules.bucket_counts(df, trusted.unionByName(trusted.limit(9))).agg(F.sum("raw"), F.sum("target")).first()
        assert tuple(got) == (3 * 21_000, 3 * 20_500)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rules_reject_what_trusted_text_never_has(spark):
    draw = random.Random(5)
    good = [(i, prose(draw, 80, 60), "en", "s", 1) for i in range(120)]
    bad = [(1000 + i, " ".join(f"w{draw.randrange(60)}###" for _ in range(80)), "en", "s", 1) for i in range(12)]
    df = spark.createDataFrame(good + bad, DOCS)
    kept = {r["doc_id"] for r in rules.kept_by_rules(df, df.filter("doc_id < 60").select("doc_id")).collect()}
    assert kept == {i for i, *_ in good}


def test_rules_without_trusted_documents_or_rows(spark, docs, none):
    found = rules.with_rules(docs, none.select("doc_id")).select("rules.*").collect()
    assert all(r["log_ratio"] == 0 and r["kept"] != r["base_failed"] for r in found)
    assert rules.with_rules(none, none.select("doc_id")).count() == 0


# --- decontamination

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (2, "Short ITEM"), (3, None),
         (None, "item without an id at all"), (2, "second row of item two"), (4, "")]


def brute_hits(text, items, size=13):
    words = TOKENS.findall(lower(text))
    hit, names = set(), set()
    for name, body in items:
        own = TOKENS.findall(lower(body))
        for i in range(max(1, len(own) - size + 1)) if own else ():
            window = own[i:i + size]
            for at in range(len(words) - len(window) + 1):
                if words[at:at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    names.add("" if name is None else str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("most", [100_000, 1])
def test_hits_are_those_of_brute_force(spark, docs, most):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    extra = [(400, "x " + ITEMS[0][1].upper() + " y short-item " + " z" * 40, "en", "s", 1), (401, "short item", "en", "s", 1),
             (402, "beta " + " ".join(ITEMS[0][1].split()[1:14]), "en", "s", 1), (403, "row of item two second row of item two", "en", "s", 1)]
    df = docs.filter("doc_id is null or doc_id <> 304").unionByName(spark.createDataFrame(extra, DOCS)).withColumn("item", F.lit(1)).withColumn("hits", F.lit("old"))
    found = decontamination.benchmark_hits(df, items, most_windows=most).withColumn("n", decontamination.hit_words())
    found = found.withColumn("digest", decontamination.items_digest()).withColumn("bad", decontamination.contaminated()).collect()
    assert len(found) == df.count()
    for r in found:
        n, hit, names = brute_hits(r["text"], ITEMS)
        assert (r["hits"]["n_words"], r["n"], r["hits"]["items"]) == (n, hit, names)
        assert r["digest"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r["bad"] == (hit > 0 and 20 * hit >= n)
        for (a, b), (s, e) in zip(zip(r["hits"]["ranges"][::2], r["hits"]["ranges"][1::2]), zip(r["hits"]["offsets"][::2], r["hits"]["offsets"][1::2])):
            assert TOKENS.findall(lower(r["text"][s:e])) == TOKENS.findall(lower(r["text"]))[a:b]


def test_items_of_any_size_come_block_by_block(spark):
    draw = random.Random(21)
    texts_ = [prose(draw, n, 5000) for n in (1, 12, 13, 14, 40, 300, 7, 90)] + [None, "", "y" * 5000, "y" * 9000]
    items = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts_)], "item string, text string")
    for most in (1, 25, 1000):
        got = list(decontamination.blocks(items, 13, most))
        found, expected = defaultdict(list), defaultdict(list)
        for block in got:
            sizes = [len(decontamination.windows_of(decontamination.tokens_of(t), 13)) for _, t in block]
            assert sum(sizes) <= most
            for i, t in block:
                found[i] += decontamination.windows_of(decontamination.tokens_of(t), 13)
        for i, t in enumerate(texts_):
            expected[str(i)] += decontamination.windows_of(decontamination.tokens_of(t), 13)
        assert {i: sorted(w) for i, w in found.items()} == {i: sorted(w) for i, w in expected.items() if w}


def test_more_items_than_once_were_allowed(spark):
    long = " ".join(["z" * 1_000_000] * 12)                 # three of them exceed 32 Mi characters
    items = spark.createDataFrame([(1, long + " a"), (2, long + " b"), (3, long + " c"), (4, "short item")], "item_id bigint, text string")
    df = spark.createDataFrame([(1, "a short item"), (2, "none"), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["hits"]["items"] for r in decontamination.benchmark_hits(df, items).collect()}
    assert got == {1: ["4"], 2: [], 3: []}


def test_no_items_hit_nothing(spark, docs, none):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.uncontaminated(docs, items).count() == docs.count()
    assert decontamination.uncontaminated(none, items).columns == none.columns


# --- secrets

def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def numbers(*values):
    return [der(2, v.to_bytes(v.bit_length() // 8 + 1, "big")) for v in values]


RSA = der(0x30, *numbers(0, 2**511 + 9, 65537, 2**510 + 3, 2**255 + 1, 2**255 + 5, 2**254, 2**254 + 1, 2**253))
PKCS8 = der(0x30, *numbers(0), der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), der(5)), der(4, RSA))
EC = der(0x30, *numbers(1), der(4, bytes(range(32))))


def wire(*parts):
    return b"".join(struct.pack(">I", len(p)) + p for p in parts)


SSH = secrets.OPENSSH_MAGIC + wire(b"none", b"none", b"") + struct.pack(">I", 1) + wire(b"public" * 5, b"private!" * 8)


def token(header, payload, signature):
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return ".".join([url(json.dumps(header).encode()), url(json.dumps(payload).encode()), url(signature)])


def test_structures_confirm_or_refuse():
    assert secrets.is_der_key(RSA) and secrets.is_der_key(PKCS8) and secrets.is_der_key(EC) and secrets.is_openssh_key(SSH)
    for whole in (RSA, PKCS8, EC, SSH):
        for broken in (whole[:-1], whole + b"\0", whole[:4] + whole[5:], b""):
            assert not secrets.is_key(broken)
    assert secrets.is_signed_token(token({"alg": "HS256"}, {"sub": 1}, b"x" * 32))
    for bad in (token({"alg": "HS256"}, {"sub": 1}, b"x" * 31), token({"typ": "JWT"}, {}, b"x" * 32), token([1], {}, b"x" * 32), "eyJhbGciOiJIUzI1NiJ9.e30.x"):
        assert not secrets.is_signed_token(bad)


def brute_secrets(text):
    """The base by single steps: regular expressions without the shortcuts of the operator."""
    text, spans = text or "", []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 12:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(spans)


def test_base_spans_are_those_of_the_patterns():
    draw = random.Random(9)
    pieces = ["password", "Token", "api_key", "APIKEY", "secret=", ": ", "=", '"', " ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "zz", "é", "K", "ſecret:",
              "abcdefghijkl", "token=secret=", "-._/+"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 14)))
        assert sorted(secrets.base_spans(text)) == brute_secrets(text)


def test_secrets_are_found_and_replaced(spark, docs, none):
    b64 = base64.b64encode(PKCS8).decode()
    pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(b64[i:i + 64] for i in range(0, len(b64), 64)) + "\n-----END PRIVATE KEY-----"
    jwt = token({"alg": "HS256", "typ": "JWT"}, {"sub": "x"}, b"s" * 32)
    text = f"é {pem} und {base64.b64encode(SSH).decode()} then {RSA.hex()} or {base64.b64encode(EC).decode()} {jwt} password = hunter2hunter2 ende"
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "nothing", "en", "s", 7), (3, None, None, None, None)], DOCS)
    found = {r["doc_id"]: r for r in secrets.find_secrets(df).select("doc_id", "secrets.*").collect()}
    kinds = Counter(s.split(":")[0] for s in found[1]["spans"].split(","))
    assert kinds == {"pem": 1, "ssh": 1, "der": 2, "jwt": 1, "assign": 1, "hex": 1}
    for span in found[1]["spans"].split(","):
        kind, start, end = span.split(":")
        assert {"pem": pem, "jwt": jwt, "assign": "password = hunter2hunter2"}.get(kind, text[int(start):int(end)]) == text[int(start):int(end)]
    assert found[2]["spans"] == found[3]["spans"] == "" and found[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r for r in secrets.without_secrets(df).collect()}
    assert clean[1]["text"] == "é [secret] und [secret] then [secret] or [secret] [secret] [secret] ende" and clean[1]["n_chars"] == len(clean[1]["text"])
    assert clean[2] == df.filter("doc_id = 2").first() and clean[3]["text"] is None
    assert secrets.without_secrets(none).columns == none.columns and secrets.find_secrets(docs).count() == docs.count()


# --- licences

def longest_runs(text, sequence, least):
    """(end, length, places) of the runs that a text shares with a sequence and that go on neither way."""
    best = [max(n for n in range(e + 1) if text[e - n:e] in sequence) for e in range(len(text) + 1)]
    out = []
    for e in range(1, len(text) + 1):
        if best[e] >= least and (e == len(text) or best[e + 1] != best[e] + 1):
            run = text[e - best[e]:e]
            out.append((e, best[e], {i + best[e] for i in range(len(sequence)) if sequence.startswith(run, i)}))
    return out


def test_matches_are_the_longest_runs():
    draw = random.Random(2)
    sequences = ["abcab", "bcbca", "aabb", "cab", "abcabcab"]
    automaton = licences.SuffixAutomaton(sequences)
    for _ in range(2000):
        text = "".join(draw.choice("abc") for _ in range(draw.randrange(12)))
        found = [(k, e, n, automaton.ends[state][k]) for k, e, n, state in automaton.matches(text, 2)]
        for k, sequence in enumerate(sequences):
            assert sorted((e, n, ends) for j, e, n, ends in found if j == k) == longest_runs(text, sequence, 2), (text, sequence)


def test_chains_are_the_heaviest(monkeypatch):
    """Against all ways to chain, over texts that repeat, drop and insert words of a template that repeats itself."""
    monkeypatch.setattr(licences, "MOST_GAP", 3)
    draw = random.Random(3)

    def heaviest(matches):
        best = {}
        for m in sorted(matches):
            best[m] = max([m[1], *[best[o] + min(m[1], m[0] - o[0], m[2] - o[2]) for o in best
                                   if o[0] < m[0] and o[2] < m[2] and m[0] - m[1] - o[0] <= 3]])
        return max(best.values())

    for _ in range(400):
        template = "".join(draw.choice("abcd") for _ in range(draw.randrange(3, 14)))
        text = "".join(draw.choice([template[i:i + 4], "x", "zz"]) for i in [draw.randrange(len(template)) for _ in range(8)])
        matches = [(e, n, p) for e, n, ends in longest_runs(text, template, 2) for p in ends]
        if not matches:
            continue
        chains = [c for group in licences.apart(matches) for c in licences.best_chains(group)]
        assert max(c[2] for c in chains) == heaviest(matches), (text, template)
        assert all(a[1] <= b[0] for a, b in zip(sorted(chains), sorted(chains)[1:]))
        assert all(c[2] <= min(len(template), c[1] - c[0]) for c in chains)


def test_each_notice_gives_its_own_label():
    scan = licences.Scanner().scan
    for label, notice in licences.TEMPLATES:
        if len(notice.split()) < licences.LEAST_MATCH:          # a base phrase says as much
            continue
        *_, labels, score, spans = scan(f"Some words before it. {notice} And some words after that.")
        others = {"gpl", "cc-by", "reserved"}                  # labels of base phrases
        assert label in labels.split(",") and score == 1.0 and set(labels.split(",")) - others <= {label}, (label, labels)
        assert {s["label"] for s in spans} == {label}
    assert scan("This work is licensed under a Creative Commons Attribution 4.0 International License")[5] == "cc-by"
    notice = licences.TEMPLATES[1][1]
    many = scan(" ".join([notice] * 2_000))
    assert len(many[7]) == 2_000 and {s["cover"] for s in many[7]} == {1.0}


def test_licences(spark, docs, none):
    grant = licences.TEMPLATES[1][1]
    cut = grant.replace("including without limitation the", "foo bar")
    df = spark.createDataFrame([(1, f"Intro. {grant} End.", "en", "s", 1), (2, f"CC-BY cc by\nALL rights  reserved; {cut}", "en", "s", 1),
                                (3, "general public general public license, all rights", "en", "s", 1), (4, None, "en", "s", 1),
                                (5, "a permission of the software is granted to any person", "en", "s", 1)], DOCS)
    r = {x["doc_id"]: x["licences"] for x in licences.find_licences(df).collect()}
    assert r[1]["labels"] == "mit" and r[1]["base_labels"] == "" and r[1]["n_base"] == 0 and r[1]["first_word"] is None
    assert r[1]["score"] == 1.0 and (r[1]["spans"][0]["start"], r[1]["spans"][0]["end"]) == (1, 1 + len(TOKENS.findall(lower(grant))))
    assert r[2]["base_labels"] == "cc-by,reserved" and r[2]["labels"] == "cc-by,mit,reserved" and (r[2]["n_base"], r[2]["first_word"], r[2]["last_word"]) == (3, 0, 4)
    assert (r[3]["labels"], r[3]["n_base"], r[3]["first_word"]) == ("gpl", 1, 2)
    assert (r[4]["n_words"], r[4]["labels"], r[4]["score"]) == (0, "", 0.0) and r[5]["labels"] == ""
    assert licences.find_licences(none).count() == 0 and licences.find_licences(docs.withColumn("label", F.lit(1))).count() == docs.count()


# --- near duplicates

def sets_of(text):
    words = lower(text).encode().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    """Component of each row by comparing all pairs of different sets."""
    sets = [sets_of(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None and (least[find(i)] is None or r[0] < least[find(i)]):
            least[find(i)] = r[0]
    return Counter((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def near_copies(draw, n):
    """Texts at all distances from one another, around the limit too, and a passage that all share."""
    out, passage = [], prose(draw, 60, 9_999)
    for base in range(n):
        words = prose(draw, draw.choice([6, 12, 40, 90, 300]), 9_999).split()
        for copy in range(draw.choice([1, 2, 6])):
            changed = list(words)
            for _ in range(draw.randrange(0, max(2, len(words) // 40 + 2))):
                changed[draw.randrange(len(changed))] = f"x{draw.randrange(99)}"
            if draw.random() < 0.3:
                changed += passage.split()
            out.append((base * 100 + copy, " ".join(changed), "en", "s", 1))
    return out


def found_components(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.with_components(df).collect())


def test_components_are_those_of_all_pairs(spark, rows):
    every = [r for r in rows if r[0] != 304] + near_copies(random.Random(4), 60)
    assert found_components(spark.createDataFrame(every, DOCS).repartition(4)) == brute_components(every)


def test_only_wanted_texts_are_read_again(spark):
    texts = spark.createDataFrame([(n, f"{n} b c d e f") for n in range(2_000)], "mark bigint, text string")
    wanted = spark.sparkContext.broadcast(jaccard.bit_filter(texts.filter("mark < 3").select("mark")))

    def each():
        def step(part, sets):
            if part is not None:
                yield {"mark": part.column(0), "n": [len(s) for s in sets]}
        return step

    read = {r["mark"]: r["n"] for r in jaccard.scan(texts, "mark bigint, n bigint", each, wanted).collect()}
    assert all(read[n] == 2 for n in range(3)) and len(read) < 100


def test_frequent_ngrams_lose_no_link(spark, monkeypatch):
    every = near_copies(random.Random(8), 40)
    monkeypatch.setattr(jaccard, "ABOVE", -1)                # nearly all n-grams count as frequent
    monkeypatch.setattr(jaccard, "DEVIATIONS", 0.0)
    assert found_components(spark.createDataFrame(every, DOCS).repartition(3)) == brute_components(every)


def test_one_of_each_stays(spark, docs, rows, none):
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs.withColumn("mark", F.lit(0))).collect())
    component = {}
    for (doc, n, c), k in brute_components([r for r in rows if r[0] != 304]).items():
        component[doc, n] = c
    expected = Counter()
    for r in rows:
        n = len(sets_of(r[1])) if r[0] != 304 else 1
        if n == 0 or r[0] == 304 or component[r[0], n] == r[0]:
            expected[r[0], r[1]] = expected[r[0], r[1]] + 1 if n == 0 else 1
    assert kept == expected
    assert jaccard.one_of_each(none).columns == none.columns and jaccard.with_components(none).count() == 0


def test_sketches_bound_the_difference():
    draw, shingler = random.Random(6), jaccard.Shingler()
    for _ in range(200):
        words = prose(draw, draw.randrange(5, 400), 9_999).split()
        other = [w if draw.random() > 0.05 else "y" for w in words] + prose(draw, draw.randrange(40), 9_999).split()
        a, b = shingler.sets([" ".join(words), " ".join(other)])
        difference = len(np.setxor1d(a, b))
        assert jaccard.least_difference(jaccard.parity_bits(a), jaccard.parity_bits(b)) <= difference
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            assert set(jaccard.Segmenter(None).keys(a)) & set(jaccard.Segmenter(None).keys(b)) or np.array_equal(a, b)


def test_long_texts_hash_alike_in_pieces(monkeypatch):
    text = prose(random.Random(1), 5_000)
    whole = jaccard.Shingler().sets([text, "a b", "", None])
    monkeypatch.setattr(jaccard, "PIECE", 1_000)
    cut = jaccard.Shingler().sets([text, "a b", "", None])
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut)) and [len(s) for s in whole[1:]] == [1, 0, 0]


# --- mixing

def test_flight_keeps_totals():
    draw = random.Random(0)
    for _ in range(50):
        columns = [(float(draw.choice([0, 1, 5, draw.randrange(1, 500)])), 1.0) for _ in range(draw.randrange(1, 200))]
        chance = draw.random()
        out = mixing.fly([chance] * len(columns), columns, draw)
        assert sum(0 < p < 1 for p in out) <= 2 and all(0 <= p <= 1 for p in out)
        for c in (0, 1):
            assert abs(sum((p - chance) * x[c] for p, x in zip(out, columns))) < 1e-6 * sum(x[c] for x in columns) + 1e-6
        assert set(mixing.land(out, columns)) <= {0.0, 1.0}


def targets(sizes):
    """By resharing the excess until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, everything = set(), 1.5 * sum(sizes.values())
    while True:
        left = everything - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and left * weight[s] / total > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in full else left * weight[s] / total for s in names}
        full |= more


@pytest.mark.parametrize("block", [4_000, 12])
def test_mix_meets_targets(spark, monkeypatch, block):
    draw = random.Random(7)
    every = [(i, prose(draw, draw.randrange(1, 60)), "en", draw.choice(["a", "b", "Z", "é", "hot", "hot", "hot", None]), 1) for i in range(900)]
    every += [(901, None, "en", "a", 0), (902, None, None, "only null", 0), (5, *every[5][1:]), (None, "x y", "en", "b", 1)]
    df = spark.createDataFrame(every, DOCS).repartition(6)
    monkeypatch.setattr(mixing.draw, "__defaults__", (block,))
    got = mixing.with_mix(df).select("doc_id", "source", "text", "mix.*").collect()
    assert len(got) == len(every)
    sizes = Counter()
    for r in every:
        sizes[r[3]] += len(SPACED.findall(r[1] or ""))
    expected, taken = targets(sizes), Counter()
    for r in got:
        assert r["size"] == len(SPACED.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - expected[r["source"]]) < 1e-6 and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 30
    again = mixing.with_mix(df.repartition(3)).select("doc_id", "source", "text", "mix.*").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_of_nothing(spark, none, docs):
    assert mixing.with_mix(none).count() == 0
    out = mixing.mixed(docs.withColumn("copies", F.lit(9)))
    assert out.columns[-2:] == ["copies", "taken"] and out.filter("copies not in (1, 2)").count() == 0


# --- archives

def test_archive_round_trip(spark):
    long, other = "<p>" + "é" * 800, "<p>" + "o" * 1500
    pages = [(1, "http://a.org/x", long), (2, "http://a.org/y\r\nX-Page-ID: 7", long), (3, None, None), (4, "u", "short"), (5, "u", "short"),
             (None, "n", long), (6, "q", other), (6, "q", other), (None, "z", "<b>" * 500), (None, "z", "<b>" * 500)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("sha256", F.lit("clash"))
    got = warc.archived(df).collect()
    assert len(got) == len(pages)
    seen = Counter()
    for r in got:
        payload = bytes(r["payload"])
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(re.findall(rb"\r\nContent-Length: (\d+)", head)[0])
        assert rest[length:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
        http, _, body = rest[:length].partition(b"\r\n\r\n")
        assert body == (payload if r["record_type"] == "response" else b"") and http.startswith(b"HTTP/1.1 200 OK")
        assert r["declared_sha1"] == hashlib.sha1(payload).hexdigest() and r["sha256"] == hashlib.sha256(payload).hexdigest()
        seen[r["page_id"], payload.decode(), r["record_type"], r["refers_to"]] += 1
    html = lambda p: p[2] or ""
    expected = Counter()
    for p in pages:
        same = [q[0] for q in pages if html(q) == html(p) and q[0] is not None]
        owner = max(same) if same and len(html(p).encode()) >= 1000 else None
        revisit = owner is not None and owner != p[0]
        expected[p[0], html(p), "revisit" if revisit else "response", owner if revisit else None] += 1
    assert seen == expected


def test_archive_stores_payloads_once_and_verifies(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "x" * 2000) for i in range(50)] + [(99, "u", "y")], "page_id bigint, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a" / "payloads"))
    assert stored.count() == 2
    stored.withColumn("payload", F.lit("forged").cast("binary")).write.parquet(str(tmp_path / "b" / "payloads"))
    with pytest.raises(Exception, match="does not match"):
        warc.read_payloads(spark, str(tmp_path / "b")).collect()
    assert warc.archived(df.limit(0)).count() == 0


# --- URLs

def test_rules_by_brute_force(spark):
    draw = random.Random(1)
    parts = ["http://", "example.org", ".org", "com", "net", "/de/", "/fr/", "/es/", "/en/1", "?", "#", "WWW.", "x.", "://", "/", "é"]
    found = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 7))) for _ in range(800)] + [None, ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(found)], "page_id bigint, url string").withColumn("host", F.lit("old"))
    got = {r["page_id"]: r for r in urls.judged(df).collect()}
    assert len(got) == len(found)
    fixed = [("allow", "org", "/", "org/"), ("block", "example.org", "/es/", "example.org/es/"), ("block", "example.org", "/en/1", "example.org/en/1"),
             ("allow", "com", "/fr/", "com/fr/"), ("block", "com", "/de/", "com/de/")]
    for i, u in enumerate(found):
        rest = re.split(r"://", u, maxsplit=1)[1] if u and "://" in u else ""
        host, tail = re.match(r"(?s)([^/?#]*)(.*)", rest).groups()
        host, path = lower(host), re.match(r"(?s)[^?#]*", tail).group()
        fits = [(len(t), t, v) for v, h, p, t in fixed if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[1])
        assert got[i]["verdict"] in ("allow", "block") and (best is None or got[i]["verdict"] == best[2])


def test_trees_learn_from_labelled_urls(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(7))
    junk = lambda: "".join(draw.choice("0123456789-") for _ in range(25))
    lists = (urls.Rule("block", "bad.net", "/"), urls.Rule("allow", "good.net", "/"))
    rows = [(i, f"http://{word()}.good.net/{word()}") for i in range(150)] + [(1000 + i, f"http://{word()}.bad.net/{junk()}?a={junk()}&b=1") for i in range(150)]
    rows += [(2000 + i, f"http://{word()}.new.net/{word()}") for i in range(40)] + [(3000 + i, f"http://{word()}.new.net/{junk()}?a={junk()}&b=1") for i in range(40)]
    got = urls.judged(spark.createDataFrame(rows, "page_id bigint, url string"), rules=lists).filter("page_id >= 2000").collect()
    right = sum((r["verdict"] == "block") == (r["page_id"] >= 3000) for r in got)
    assert right >= 76


def test_url_rates_are_those_of_all_labelled_urls(spark, monkeypatch):
    monkeypatch.setattr(urls, "TRAINING", 20)
    made = [(f"http://h{i}.d{i % 7}.{'org' if i % 4 else 'com'}/s{i % 3}/{i}", float(i % 4 == 0)) for i in range(200)]
    rows = [(u, u.split("/")[2], "/" + u.split("/", 3)[3], v) for u, v in made]
    model = urls.train(spark.createDataFrame(rows + rows[:50], "url string, host string, path string, blocked double"))
    assert model.share == 0.25
    keys = {"top_rate": lambda h, p: h.split(".")[-1], "domain_rate": lambda h, p: h.split(".", 1)[1],
            "segment_rate": lambda h, p: h.split(".")[-1] + "/" + p.split("/")[1]}
    for name, key in keys.items():
        each = defaultdict(list)
        for _, h, p, v in rows:
            each[key(h, p)].append(v)
        got = {r[0]: r[1] for r in model.rates[name].select(urls.SUFFIXES[name], name).collect()}
        assert got == pytest.approx({k: (sum(v) + 2.5) / (len(v) + 10) for k, v in each.items()})


def test_url_trees_keep_the_share_of_all_labelled_urls(spark, monkeypatch):
    monkeypatch.setattr(urls, "TRAINING", 40)
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(7))
    lists = (urls.Rule("block", "com", "/b"), urls.Rule("allow", "com", "/a"))
    rows = [(i, f"http://{word()}.com/{'b' if i % 10 == 0 else 'a'}{word()}") for i in range(600)]    # alike but for the rule
    rows += [(1000 + i, f"http://{word()}.net/{word()}") for i in range(60)]
    got = urls.judged(spark.createDataFrame(rows, "page_id bigint, url string"), rules=lists).filter("page_id >= 1000").collect()
    assert all(r["verdict"] == "allow" for r in got) and np.mean([r["block_probability"] for r in got]) < 0.3


def test_urls_without_labels(spark):
    df = spark.createDataFrame([(1, "http://x.net/a"), (2, None)], "page_id bigint, url string")
    assert {r["verdict"] for r in urls.judged(df).collect()} == {"allow"} and urls.judged(df.limit(0)).count() == 0


# --- learned scores

def quality_rows(n=160):
    draw = random.Random(12)
    good = [(i, prose(draw, 120, 300), "en", "s", 1) for i in range(n)]
    bad = [(5000 + i, " ".join(f"W{draw.randrange(300)}###!!" for _ in range(100)), "en", "s", 1) for i in range(n)]
    return good + bad, [(r[0], int(r[0] < 5000), 0) for r in good + bad]


def test_compression_separates_unseen_text(spark, docs, none):
    rows, labels = quality_rows()
    df, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = compression.train(df, known.filter(~texts.held_out()))
    got = compression.with_quality(df, model).filter(texts.held_out()).collect()
    assert got and all((r["quality"]["score"] >= 0.5) == (r["doc_id"] < 5000) for r in got)
    odd = compression.with_quality(docs, model).select("quality.score").collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert compression.train(df, known.limit(0)) is None and compression.with_quality(none, None).count() == 0


def disguised(draw, word):
    kind = draw.randrange(4)
    if kind == 0:
        return "".join({"o": "0", "i": "1", "e": "3", "a": "4", "s": "5", "t": "7"}.get(c, c) for c in word)
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        return "".join(c * 4 if c in "aeiou" else c for c in word)
    return ".".join(word)


def test_disguised_words_are_restored_and_scored(spark, docs, none):
    draw = random.Random(13)
    rude = ["idiot", "moron", "stupid", "worthless", "pathetic"]
    plain = ["garden", "window", "river", "mountain", "letter", "summer", "station", "village", "number", "morning", "table", "silver"]
    rows, labels = [], []
    for i in range(400):
        words = [draw.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            words[draw.randrange(40)] = draw.choice(rude)
            words[draw.randrange(40)] = draw.choice(rude)
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    hidden = []
    for i in range(60):
        words = [draw.choice(plain) for _ in range(40)]
        words[20] = disguised(draw, draw.choice(rude))
        words[30] = disguised(draw, draw.choice(rude))
        hidden.append((9000 + i, " ".join(words), "en", "s", 1))
    clean = [(9500 + i, " ".join(disguised(draw, w) if draw.random() < 0.1 else w for w in draw.choices(plain, k=40)), "en", "s", 1) for i in range(60)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, DOCS), known)
    got = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.with_toxicity(spark.createDataFrame(hidden + clean, DOCS), model).collect()}
    assert sum(got[r[0]] >= 0.5 for r in hidden) >= 57 and sum(got[r[0]] >= 0.5 for r in clean) <= 1
    decoder = toxicity.Decoder(model.characters)
    assert [decoder.restore(w) for w in ("1d10t", "w0r7hl355", "stuuuupid", "m.o.r.o.n", "p a t h e t i c")] == ["idiot", "worthless", "stupid", "moron", "pathetic"]
    assert toxicity.with_toxicity(docs, model).count() == docs.count() and toxicity.with_toxicity(none, None).count() == 0
    assert toxicity.train(none, known) is None


@pytest.fixture(scope="module")
def scorer(spark):
    draw = random.Random(14)
    lines = ["such a moron", "you are a stupid idiot", "a river and a garden", "he is a fine man", "you are late"]
    rows = [(i, " ".join(draw.choices(lines, k=6)), "en", "s", 1) for i in range(200)]
    characters = toxicity.language_model(toxicity.count_characters(spark.createDataFrame(rows, DOCS)))
    return toxicity.Scorer(characters, {"moron": 5.0, "stupid": 4.0, "idiot": 3.0})


@pytest.mark.parametrize("text, words", [
    ("such a m o r o n", ["moron"]), ("s t u p i d m o r o n", ["moron", "stupid"]), ("an i d ! o t here", ["idiot"]),
    ("$ t u p i d", ["stupid"]), ("y o u a r e a s t u p i d i d i o t", ["stupid", "idiot"]), ("m o r o n", ["moron"]),
    ("stu" + "u" * 60 + "pid", ["stupid"]), ("a | b | c", []), ("* * * *", [])])
def test_spaced_and_long_disguises_are_restored(scorer, text, words):
    strongest, count, _ = scorer.evidence(text)
    assert [w for _, w in strongest] == words and count == len(words)


def test_long_tokens_take_linear_time(scorer):
    assert scorer.decoder.restore("m0r0n" * 20_000).startswith("moronmoron")
    assert len(scorer.decoder.restore("1" * 20_000)) <= 20_000


def test_character_counts_cover_all_texts(spark, docs):
    table = toxicity.symbol_table()
    counts = Counter()
    for r in docs.collect():
        read = toxicity.symbols_of("  " + (r["text"] or "").lower() + "  ", table)
        for a, b, c in zip(read, read[1:], read[2:]):
            if b or c:
                counts[(int(a) * 64 + int(b)) * 64 + int(c)] += 1
    assert {r["sequence"]: r["n"] for r in toxicity.count_characters(docs).collect()} == counts
