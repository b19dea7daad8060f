"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items.

Every word of the items gets one character; a document becomes a string with one character
a word (words of no item share one that no window has), and the automaton reads that string
once. Positions in it are word positions, and word spans lead back to the original text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerspark.llm.texts import TOKEN, empty, free_name, map_texts, named, tokens_of
from fingerspark.operators.ordered import running_totals
from fingerspark.sources.tables import durable

#: Words of a window.
WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Windows in one automaton at most, about 150 MB in a task; more items take more passes.
MOST_WINDOWS = 100_000
#: Words of an item that take the room of one window at least.
WORDS_A_WINDOW = 10
#: Characters of item words that take the room of one more window.
CHARACTERS = 320
#: The same words where they stand in a text that has not been lower-cased.
WORDS = re.compile(TOKEN.replace("\\x60", "\\x40\\x5B-\\x60"))
#: Words become characters above the surrogates, "\0" stands for any other word.
FIRST, LAST = 0x10000, 0x10FFFF

PIECES = T.StructType([T.StructField("pieces", T.ArrayType(T.StructType([
    T.StructField("text", T.StringType()), T.StructField("room", T.LongType())])))])
HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("ranges", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("offsets", T.ArrayType(T.LongType())),
])


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


class Matcher:
    """The automaton of some items, and what each of its windows stands for."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        owners = defaultdict(set)
        for item, text in items:
            for window in windows_of(tokens_of(text), size):
                owners[window].add(item)
        vocabulary = sorted({w for window in owners for w in window})
        if len(vocabulary) > LAST - FIRST:
            raise ValueError("too many different words for one automaton; lower MOST_WINDOWS")
        self.letters = {w: chr(FIRST + i) for i, w in enumerate(vocabulary)}
        self.automaton = ahocorasick.Automaton()
        for window, names in owners.items():
            key = "".join(self.letters[w] for w in window)
            self.automaton.add_word(key, (len(window), tuple(sorted(names))))
        self.automaton.make_automaton()
        self.any = bool(owners)

    def scan(self, text: str | None) -> tuple[int, list[int], list[str], list[int]]:
        """Words; hit ranges as starts and ends; items; the ranges' offsets in the text."""
        words = tokens_of(text)
        if not self.any or not words:
            return len(words), [], [], []
        letter = self.letters.get
        read = "".join([letter(w, "\0") for w in words])
        ranges: list[list[int]] = []
        names = set()
        for last, (length, items) in self.automaton.iter(read):
            start, end = last + 1 - length, last + 1
            names.update(items)
            while ranges and ranges[-1][1] >= start:
                start = min(start, ranges[-1][0])
                end = max(end, ranges.pop()[1])
            ranges.append([start, end])
        if not ranges:
            return len(words), [], [], []
        at = [m.span() for m in WORDS.finditer(empty(text))]
        offsets = [x for a, b in ranges for x in (at[a][0], at[b - 1][1])]
        return len(words), [x for r in ranges for x in r], sorted(names), offsets


def merged(ranges: list[int], offsets: list[int]) -> tuple[list[int], list[int]]:
    """Union of ranges, and their offsets."""
    out: list[int] = []
    places: list[int] = []
    for a, b, start, end in sorted(zip(ranges[::2], ranges[1::2], offsets[::2], offsets[1::2])):
        if out and a <= out[-1]:
            if b > out[-1]:
                out[-1], places[-1] = b, end
        else:
            out += [a, b]
            places += [start, end]
    return out, places


def pieces_of(text: str | None, size: int, most: int) -> list[tuple[str, int]]:
    """An item's words in pieces that have each of its windows once, at most ``most`` a piece.

    With each piece goes the room that it takes: its windows, more if its words are many for
    them (so that a block's words are never more than an automaton has letters for), and more for
    long words. Of pieces under one id the windows are those of the item.
    """
    words = tokens_of(text)
    out = []
    for at in range(0, max(1, len(words) - size + 1) if words else 0, most):
        held = words[at:at + most + size - 1]
        piece = b" ".join(held)
        n = max(min(most, max(1, len(words) - size + 1) - at), -(-len(held) // WORDS_A_WINDOW))
        out.append((piece.decode("utf-8", "surrogatepass"), n + len(piece) // CHARACTERS))
    return out


def blocks(items: DataFrame, size: int, most: int = MOST_WINDOWS) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of at most ``most`` windows, each collected when it is asked for.

    Items are cut into pieces of at most a tenth of a block; where a piece starts, counted in
    room over all pieces, tells its block. Only one block is on the driver at a time.
    """
    longest = max(1, most // 10)
    span = most - longest + 1

    def start():
        return lambda texts: [(pieces_of(t, size, longest),) for t in texts]

    cut = map_texts(items.select("item", "text"), "text", "cut", PIECES, start, ["item"])
    each = durable(cut.select("item", F.posexplode("cut.pieces").alias("at", "piece")).select("item", "at", "piece.*"))
    held = each.agg(F.sum("room")).first()[0] or 0
    if held <= most:
        yield [tuple(r) for r in each.select("item", "text").collect()]
        return
    ends = running_totals(each, [], ["item", "at", "text"], {"end": F.col("room")})
    placed = durable(ends.select("item", "text", F.floor((F.col("end") - F.col("room")) / span).alias("block")))
    for block in range(-(-held // span)):
        rows = placed.filter(F.col("block") == block).select("item", "text").collect()
        if rows:                         # a piece of very long words may span several blocks
            yield [tuple(r) for r in rows]


def benchmark_hits(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", into: str = "hits", size: int = WINDOW,
                   most_windows: int = MOST_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """Add struct ``into``: words, hit word ranges, the items found, offsets in the text.

    A word is hit if any occurrence of a window of ``size`` item words holds it; an item of
    fewer words is one window, one of none has none. Rows of ``items`` with one id are one
    item; a null id reads as an empty one. Null texts have no words. An empty table of
    items hits nothing, and an empty table of documents stays empty. Repeated rows of documents are
    scanned each. Very long texts are scanned whole, very long items come in pieces that share no window. ``keep`` names the columns to pass on, all by default; a column
    called ``into`` is replaced.
    """
    listed = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
                          F.col(item_text).alias("text"))
    parts = blocks(listed, size, most_windows)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _pass(df, first, text, into, size, keep)
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != into.lower()]
    row, new = free_name(df, f"{into}_row"), free_name(df, f"new_{into}")
    source = df.select(*named(df, [*kept, *([] if text in kept else [text])]))
    stored = durable(source.withColumn(row, F.monotonically_increasing_id()))
    lists, later = HITS.names[1:], []
    for part in chain([second], parts):  # stored one by one, so that one automaton is in memory at a time
        found = _pass(stored, part, text, new, size, [row]).filter(F.size(f"{new}.items") > 0)
        later.append(durable(found.select(row, *[f"{new}.{c}" for c in lists])))
    more = reduce(DataFrame.union, later).groupBy(row).agg(
        F.struct(*[F.flatten(F.collect_list(c)).alias(c) for c in lists]).alias(new))
    out = _pass(stored, first, text, into, size, [*kept, row]).join(more, row, "left")
    ranges, names, offsets = [F.coalesce(F.col(f"{new}.{c}"), F.array().cast(HITS[c].dataType)) for c in lists]
    spans = F.udf(merged, T.StructType([HITS["ranges"], HITS["offsets"]]))(
        F.concat(f"{into}.ranges", ranges), F.concat(f"{into}.offsets", offsets))
    both = F.struct(F.col(f"{into}.n_words"), spans["ranges"].alias("ranges"),
                    F.array_sort(F.array_union(f"{into}.items", names)).alias("items"), spans["offsets"].alias("offsets"))
    return out.withColumn(into, both).select(*named(out, [*kept, into]))


def _pass(df: DataFrame, items: list, text: str, into: str, size: int,
          keep: list[str] | None = None) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(items)

    def start():
        scan = Matcher(shared.value, size).scan
        return lambda texts: [scan(t) for t in texts]

    return map_texts(df, text, into, HITS, start, keep)


def hit_words(hits: str = "hits"):
    """Number of hit words."""
    ranges = F.col(f"{hits}.ranges")
    ends = F.aggregate(ranges, F.struct(F.lit(0).cast("long").alias("total"), F.lit(-1).cast("long").alias("sign")),
                       lambda a, x: F.struct((a["total"] + a["sign"] * x).alias("total"), (-a["sign"]).alias("sign")))
    return ends["total"]


def items_digest(hits: str = "hits"):
    """SHA-256 of the comma-joined ids of the items found, sorted as strings."""
    return F.sha2(F.array_join(f"{hits}.items", ","), 256)


def contaminated(hits: str = "hits", one_in: int = ONE_IN):
    """The rule: some word is hit, and at least one in ``one_in``."""
    n = hit_words(hits)
    return (n > 0) & (n * one_in >= F.col(f"{hits}.n_words"))


def uncontaminated(df: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that the rule does not reject, with their columns, whatever these are called.

    Null and empty texts have no words and stay; repeated rows stay or go together; very long texts are
    scanned whole. Empty tables of documents or items leave all there is.
    """
    into = free_name(df, "hits")
    return benchmark_hits(df, items, text, into=into, **options).filter(~contaminated(into)).select(*named(df))
