"""Token counts, the conversation trie and the repair of conversations, against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fingerspark.llm import repair, tokens, trie
from fingerspark.llm.queries import op11_tokens

TOKENIZERS = pytest.importorskip("public_tokenizers")
TURNS = "conv_id long, turn long, role string, text string"
BLANK = "\t\n\v\f\r "


def library_counts(name, texts):
    path = TOKENIZERS.path(name)
    if name.endswith(".model"):
        import sentencepiece
        return [len(p) for p in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer
    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def odd_texts():
    draw = random.Random(2)
    out = [None, "", " ", "  two  spaces ", "don't we'll\tTAB\r\nline\n\n end", "a <|endoftext|> b  <|endoftext|><|startoftext|>\n c",
           "日本語 text हिन्दी ١٢٣ 😀👍🏽 ​﻿", "\x1c\x1d\x85   x", "same text", "same text", "<|endoftext|>", "x" * 3000,
           "ÀÉî ɏ ɐ Ǆ ﬁ ½ ²", " ".join(f"w{draw.randrange(900)}" for _ in range(60_000))]
    for _ in range(150):
        out.append("".join(draw.choice("ab cZ'.,é\n\t ß日1２<|>") for _ in range(draw.randrange(60))))
    return out


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_are_those_of_the_library(spark, odd_texts, monkeypatch, name):
    monkeypatch.setattr(tokens, "CHUNK", 20_000)                # several chunks, one of them of one long text
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(odd_texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string").repartition(3)
    got = tokens.with_token_counts(df.withColumn("chunk", F.lit(1)).withColumn("at", F.lit(2)), TOKENIZERS.path(name))
    assert got.columns == ["doc_id", "text", "chunk", "at", "tokens"]
    want = library_counts(name, [t or "" for t in odd_texts])
    assert sorted((r.doc_id or -1, r.text or "", *r.tokens) for r in got.collect()) == sorted(
        (i or -1, t or "", len((t or "").encode()), n) for (i, t, _), n in zip(rows, want))


def test_every_common_character_is_cut_as_the_library_cuts_it():
    from tokenizers import Tokenizer
    splitter = Tokenizer.from_file(TOKENIZERS.path("byte_bpe_50k.json")).pre_tokenizer
    cut, shape, _ = tokens.json_tokenizer(TOKENIZERS.path("byte_bpe_50k.json"))
    for code in range(0x300):
        for text in (f"a{chr(code)}b", f" {chr(code)}", f"{chr(code)}{chr(code)} 1{chr(code)}"):
            assert shape(cut(text)) == [p for p, _ in splitter.pre_tokenize_str(text)], hex(code)


def test_token_counts_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.with_token_counts(none, TOKENIZERS.path("byte_bpe_50k.json")).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {r.tokens.n_tokens for r in tokens.with_token_counts(blank, TOKENIZERS.path("byte_bpe_50k.json")).collect()} == {0}


def test_op11_equals_the_library_on_the_given_documents(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    want = library_counts("byte_bpe_50k.json", list(docs.values()))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op11_tokens(spark, sf_dir).collect()}
    assert got == {i: (len(t.encode()), n, n > 512) for (i, t), n in zip(docs.items(), want)}


def odd_conversations():
    """Nulls everywhere, repeated rows, ties, one long conversation, many equal ones, copies of beginnings."""
    draw = random.Random(4)
    said = ["Yes.", "No!", "why?", "cut off", "", "  ", None, "Yes. ", "a\nb."]
    rows = [(c, t, draw.choice(["user", "assistant", "system", "tool", None, ""]), draw.choice(said))
            for c in (*range(12), 100, 101, 107, 205) for t in range(draw.randrange(9))]
    rows += [(300 + i, t, ("user", "assistant")[t % 2], f"line {t}.") for i in range(40) for t in range(4)]
    rows += [(400, t, ("user", "assistant")[t % 2 if t % 11 else 0], f"turn {t % 50}" + "." * (t % 5 > 0)) for t in range(700)]
    rows += [(None, 1, "user", "Nobody."), (None, None, None, None), (500, None, "user", "First."), (500, None, "user", "First."),
             (500, 0, None, None), (501, 2, "user", "b."), (501, 2, "assistant", "a."), (501, 2, "assistant", "a."), (502, None, None, None)]
    return rows


def nodes_by_hand(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    again = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        again[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in again.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        for depth in range(len(path) + 1):
            leaves[path[:depth]] += children[path] == 0
            saved[path[:depth]] += (len(convs) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(again[c]) == len(path)))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path], leaves[path],
                    saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("height", [2, 5, 32])
def test_the_trie_is_that_of_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = odd_conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    got = sorted(tuple(r) for r in trie.prefix_trie(*trie.rebuilt(df), height=height).collect())
    assert got == nodes_by_hand(rows)


def test_the_trie_of_nothing_and_of_other_columns(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.shared_beginnings(none).count() == 0
    rows = [(7, 0, "user", "x"), (8, 0, "user", "x")]
    clash = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("node", "depth", "place", "digest")})
    assert sorted(tuple(r) for r in trie.shared_beginnings(clash).collect()) == nodes_by_hand(rows)


def best_by_hand(signs):
    """Least (cost, audit) of all edits, by steps over the rows with up to two insertions before each."""
    def insert(found):
        out, new = dict(found), found
        for _ in range(2):
            more = {}
            for state, (cost, audit) in new.items():
                for initial in "ua":
                    if (state, initial) in repair.STEPS:
                        put(more, repair.STEPS[state, initial], (cost + 5, audit + "I"))
            for state, way in more.items():
                put(out, state, way)
            new = more
        return out

    def put(found, state, way):
        found[state] = min(found.get(state, way), way)

    found = {repair.NOTHING: (0, "")}
    for sign in signs:
        after = {}
        for state, (cost, audit) in insert(found).items():
            put(after, state, (cost + 2, audit + "D"))
            if sign == "-":
                continue
            left = 5 if sign.isupper() else 0
            if (state, sign.lower()) in repair.STEPS:
                put(after, repair.STEPS[state, sign.lower()], (cost + left, audit + "K"))
            for initial in "ua":
                if (state, initial) in repair.STEPS:
                    put(after, repair.STEPS[state, initial], (cost + left + 1, audit + "R"))
        found = after
    found = insert(found)
    return min(found[s] for s in repair.COMPLETE if s in found)


def test_searches_from_both_ends_find_the_cheapest_edits():
    for length in (1, 2, 3):
        for signs in map("".join, itertools.product("suaxSUAX-", repeat=length)):
            assert repair.solved(signs, True, True)[0][2:] == best_by_hand(signs), signs
    draw = random.Random(5)
    for _ in range(300):
        signs = "".join(draw.choice("suaxSUAX-uauaua") for _ in range(draw.randrange(4, 40)))
        want = best_by_hand(signs)
        assert repair.solved(signs, True, True)[0][2:] == want, signs
        size = draw.randrange(1, 9)                              # slices chain to the same audit
        parts = [signs[i:i + size] for i in range(0, len(signs), size)]
        ways = [repair.solved(p, i == 0, i == len(parts) - 1) for i, p in enumerate(parts)]
        cost, chosen = repair.chain([[w[:3] for w in slice_] for slice_ in ways])
        assert (cost, "".join(w[c][3] for w, c in zip(ways, chosen))) == want, (signs, size)


def repaired_by_hand(rows):
    conversations, out = defaultdict(list), {}
    for c, t, r, x in rows:
        conversations[c].append((t is not None, t or 0, " " if r is None else r, " " if x is None else x))
    for c, listed in conversations.items():
        damaged = []
        for known, t, r, x in sorted(listed):
            turn = t if known else None
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            damaged += [(turn, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
        known = [t for t, _, _ in damaged if t is not None]
        seen, faults, signs = set(), [], ""
        for _, r, x in damaged:
            core = x.strip(BLANK)
            fault = "blank" if not core else "duplicate" if (r, x) in seen else None if core[-1] in ".!?" else "truncated"
            seen.add((r, x))
            faults.append(fault)
            sign = r[:1] if r[:1] in ("s", "u", "a") else "x"
            signs += "-" if fault in ("blank", "duplicate") else sign.upper() if fault else sign
        cost, audit = best_by_hand(signs)
        state, at, lines = repair.NOTHING, 0, []
        for letter in audit:
            initial = "a" if state == repair.USER else "u"
            name = {"u": "user", "a": "assistant"}[initial]
            if letter == "I":
                lines.append(f"{name}:")
            else:
                _, r, x = damaged[at]
                at += 1
                if letter == "D":
                    continue
                initial = r[:1] if letter == "K" else initial
                lines.append(f"{r if letter == 'K' else name}:{x}")
            state = repair.STEPS[state, initial]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(damaged))
        out[c] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in repair.FAULTS),
                  illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_repaired_conversations_are_those_of_brute_force(spark):
    rows = odd_conversations() + [(c, 0, "user", "Gone? ") for c in range(600, 900) if zlib.crc32(f"{c}:0".encode()) % 20 < 5]
    df = spark.createDataFrame(rows, TURNS).repartition(4).withColumns({c: F.lit("x") for c in ("place", "conv", "kind")})
    got = {r[0]: tuple(r[1:]) for r in repair.repaired_conversations(df).collect()}
    want = repaired_by_hand(rows)
    assert any(v[6] == "" for v in want.values()) and {len(v[6]) > repair.SLICE for v in want.values()} == {True, False}
    assert got == want
    assert repair.repaired_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_repaired_turns_have_legal_roles_and_their_texts(spark):
    rows = odd_conversations()
    turns = repair.damaged(spark.createDataFrame(rows, TURNS))
    found, anew = repair.repaired(turns, ["turn", "order_role", "order_head", "order_body", "order_copy"])
    texts = {x for *_, x in rows} | {re.sub("[.!?]", "", x or " ") for *_, x in rows} | {""}
    roles = defaultdict(str)
    for r in anew.orderBy("conv", "place", "step").collect():
        roles[r.conv] += r.role[:1]
        assert r.text in texts
    assert all(re.fullmatch("s?(ua)+", r) for r in roles.values())
    audits = {r.conv: r.audit for r in found.collect()}
    assert {c: len(r) for c, r in roles.items()} == {c: len(a) - a.count("D") for c, a in audits.items() if set(a) - {"D"}}
