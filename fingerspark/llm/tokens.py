"""Token counts: the pieces of each distinct pre-token are counted once, then joined and summed.

A tokenizer cuts a text into pre-tokens and no piece crosses them, so a text's count is the sum
over its pre-tokens. One pass over the texts cuts them. It works in chunks of some megabytes:
a chunk numbers its distinct pre-tokens and notes, for each document, how often each of its
numbers occurs. The chunks' lists of pre-tokens are shuffled by pre-token, where equal ones of
all chunks meet, the model counts the pieces of each once, and the counts are joined back and
return to their chunks as (number, pieces). There they meet the documents' frequencies.

A pre-token that every document holds has one short row for each chunk, so it makes no large
task, and no list of ids is made anywhere.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fingerspark.llm.texts import empty, named, slices
from fingerspark.sources.tables import durable

#: Bytes of text of one chunk. It bounds memory only: one text is never cut.
CHUNK = 16 << 20
# Fixed value: the split of byte-level tokenizers that name no pattern of their own.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters are split by the pattern above here; others by the tokenizer itself,
#: because two libraries may know different versions of Unicode.
COMMON = regex.compile(r"[\t\n\r\x20-\x7E\xA0-ɏ]*")
#: What marks a space in sentencepiece.
MARK = "▁"

#: Cuts a text into pre-tokens.
Cut = Callable[[str], list[str]]
#: Pre-tokens as the model takes them; the pieces of one of these.
Shape = Callable[[list[str]], list[str]]
Count = Callable[[str], int]


def byte_signs() -> list[str]:
    """The characters that stand for the bytes 0 to 255 in byte-level models.

    Printable Latin-1 characters stand for themselves, the other bytes for those from 256 on.
    """
    free = iter(range(256, 512))
    plain = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    return [chr(b) if plain[b] else chr(next(free)) for b in range(256)]


def unchanged(pretokens: list[str]) -> list[str]:
    return pretokens


def json_tokenizer(path: str) -> tuple[Cut, Shape, Count]:
    """Cutting and counting with a tokenizer file of the library ``tokenizers``.

    Added tokens inside texts count as one piece, which is the library's default.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    added = [t for t in spec.get("added_tokens") or [] if t["content"]]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that take their surroundings in are not supported")
    if '"Metaspace"' in json.dumps([spec.get("pre_tokenizer"), spec.get("normalizer")]):
        raise ValueError("pre-tokenizers that treat a text's beginning apart are not supported")
    marks = sorted({t["content"] for t in added}, key=lambda c: (-len(c), c))
    special = re.compile("|".join(f"({re.escape(m)})" for m in marks) or r"(?!)")
    normalizer, splitter, model = whole.normalizer, whole.pre_tokenizer, whole.model
    table = dict(enumerate(byte_signs()))
    known = spec.get("pre_tokenizer") or {}
    byte_level = (normalizer is None and known.get("type") == "ByteLevel" and known.get("use_regex", True)
                  and not known.get("add_prefix_space", True))
    quick = regex.compile(BYTE_LEVEL)
    #: Before pre-tokens that are already as the model takes them.
    ready = "\x00"

    def part(text: str) -> list[str]:
        if byte_level and COMMON.fullmatch(text):
            return quick.findall(text)
        if normalizer is not None:
            text = normalizer.normalize_str(text)
        if splitter is None:
            return [ready + text] if text else []
        return [ready + p for p, _ in splitter.pre_tokenize_str(text)]

    def cut(text: str) -> list[str]:
        if not any(m in text for m in marks):
            return part(text)
        out = []
        at = 0
        for found in special.finditer(text):
            out += part(text[at:found.start()])
            out.append(ready + found.group())
            at = found.end()
        return out + part(text[at:])

    def shape(pretokens: list[str]) -> list[str]:
        return [p[1:] if p.startswith(ready) else p.encode().decode("latin-1").translate(table) for p in pretokens]

    def count(pretoken: str) -> int:
        return 1 if pretoken in marks else len(model.tokenize(pretoken))

    return cut, shape, count


def piece_tokenizer(path: str) -> tuple[Cut, Shape, Count]:
    """Cutting and counting with a model file of the library ``sentencepiece``.

    A pre-token is a run of spaces and the characters up to the next space. That is exact only
    if no piece of the vocabulary goes on after a space, and is refused otherwise.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    if any(re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in range(model.vocab_size())):
        raise ValueError("pieces that hold several words are not supported")
    leading = model.normalize("a").startswith(MARK)
    if not leading:
        raise ValueError("models without a space before the text are not supported")
    units = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def cut(text: str) -> list[str]:
        return units.findall(model.normalize(text))

    def count(pretoken: str) -> int:
        rest = pretoken[1:]  # the model puts the first space before a text by itself
        return len(model.encode(rest)) if rest else 1

    return cut, unchanged, count


def tokenizer(path: str) -> tuple[Cut, Shape, Count]:
    return piece_tokenizer(path) if path.endswith(".model") else json_tokenizer(path)


def chunk_row(texts: list[str], cut: Cut, shape: Shape) -> tuple[list[str], bytes]:
    """A chunk's distinct pre-tokens, the commonest first, and the packed frequencies of its documents."""
    cuts = [pa.array(cut(t), pa.string()) for t in texts]
    lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
    coded = pa.concat_arrays(cuts).dictionary_encode()
    del cuts
    # Both ways of cutting may give one pre-token; it must have one number.
    shaped = pa.array(shape(coded.dictionary.to_pylist()), pa.string()).dictionary_encode()
    pretokens = shaped.dictionary
    numbers = shaped.indices.to_numpy()[coded.indices.to_numpy()] if len(pretokens) else np.zeros(0, np.int64)
    order = np.argsort(-np.bincount(numbers, minlength=len(pretokens)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    numbers = rank[numbers]
    each, steps, times = [0], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    for part in np.split(numbers, np.cumsum(lengths)[:-1]):
        found, often = np.unique(part, return_counts=True)
        each.append(len(found))
        steps.append(np.diff(found, prepend=np.uint32(0)))
        times.append(often.astype(np.uint32))
    return pretokens.take(pa.array(order)).to_pylist(), packed(each[1:], np.concatenate(steps), np.concatenate(times))


def packed(each: list[int], steps: np.ndarray, times: np.ndarray) -> bytes:
    """How many distinct pre-tokens each document has; steps between their numbers; how often each occurs.

    Compressed with equal bytes of the numbers side by side, because most high bytes are zero.
    """
    numbers = np.concatenate([np.array([len(each), *each], np.uint32), steps, times])
    return zstandard.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents, numbers and frequencies of a chunk, as columns."""
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    numbers = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
    each, rest = numbers[1:1 + numbers[0]].astype(np.int64), numbers[1 + numbers[0]:].astype(np.int64)
    steps, times = rest[:len(rest) // 2], rest[len(rest) // 2:]
    starts = np.repeat(np.cumsum(each) - each, each)
    total = np.cumsum(steps)
    before = np.concatenate([[0], total])[starts]  # each document counts its steps from zero
    return np.repeat(np.arange(len(each)), each), total - before, times


def with_token_counts(docs: DataFrame, path: str, text: str = "text", into: str = "tokens",
                      keep: list[str] | None = None) -> DataFrame:
    """Add a struct column with a text's ``n_bytes`` (UTF-8) and ``n_tokens``.

    ``path`` names a tokenizer file that every executor can read: ``.json`` for the library
    ``tokenizers``, ``.model`` for ``sentencepiece``. Counts are those of the library's encode
    without begin, end or added special tokens, truncation or padding.

    Null and empty texts count 0 of both. Texts of any length are cut whole; one that is longer
    than a chunk makes a chunk of its own. Equal texts have equal counts and repeated rows stay.
    An empty table gives an empty one. Columns in ``keep`` (all by default) pass through, whatever
    they are called; one called ``into`` is replaced. Nothing depends on an order, so there are no ties.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != into.lower()]
    source = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(named(docs, kept))], named(docs, [text])[0].alias("text"))
    fields = source.schema.fields[:-1]
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("at", T.IntegerType()), *fields,
                           T.StructField("n_bytes", T.LongType()),
                           T.StructField("pretokens", T.ArrayType(T.StringType())), T.StructField("counts", T.BinaryType())])
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema}

    def cut_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, shape, _ = tokenizer(path)
        for batch in batches:
            for part in slices(batch, CHUNK):
                texts = [empty(t) for t in part.column(part.num_columns - 1).to_pylist()]
                pretokens, counts = chunk_row(texts, cut, shape)
                rest = [None] * (len(texts) - 1)
                columns = {
                    "chunk": [uuid4().int >> 65] * len(texts), "at": list(range(len(texts))),
                    "n_bytes": [len(t.encode()) for t in texts],
                    "pretokens": [pretokens, *rest], "counts": [counts, *rest]}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[n], kinds[n]) if n in columns else part.column(n) for n in schema.names], schema.names)

    chunks = durable(source.mapInArrow(cut_chunks, schema), "zstd")

    # The numbers of a chunk are the places in its list.
    listed = (chunks.filter("pretokens IS NOT NULL").select("chunk", F.posexplode("pretokens").alias("number", "pretoken"))
              .repartition("pretoken"))

    def count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, count = tokenizer(path)
        for batch in batches:
            pieces = [count(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.int64())], ["pretoken", "pieces"])

    # Grouped with all columns, so that the shuffle by pre-token above serves this and the join.
    distinct = listed.groupBy("pretoken").agg(F.max("chunk").alias("chunk"), F.max("number").alias("number"))
    counted = distinct.mapInArrow(count_pieces, "pretoken string, pieces long")
    pieces = (listed.join(counted.withColumnRenamed("pretoken", "same").hint("merge"), F.col("pretoken") == F.col("same"), "left")
              .groupBy(F.col("chunk").alias("whose"))
              .agg(F.collect_list(F.shiftleft(F.col("number").cast("long"), 32) + F.col("pieces")).alias("pieces")))

    def sum_chunk(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        each = right["pieces"].combine_chunks().flatten().to_numpy() if len(right) else np.zeros(0, np.int64)
        each = np.sort(each) & 0xFFFFFFFF  # numbers run from 0 without gaps
        at, numbers, times = unpacked(left["counts"][0].as_py())
        sums = np.bincount(at, weights=each[numbers] * times.astype(np.float64))
        here = np.flatnonzero(sums)
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(here), pa.int64()),
                         "at": pa.array(here, pa.int32()), "n_tokens": pa.array(sums[here], pa.int64())})

    frequencies = chunks.filter("counts IS NOT NULL").select("chunk", "counts")
    sums = (frequencies.groupBy("chunk").cogroup(pieces.groupBy("whose"))
            .applyInArrow(sum_chunk, "chunk long, at int, n_tokens long"))
    counts = F.struct("n_bytes", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens")).alias(into)
    return (chunks.drop("pretokens", "counts").join(sums, ["chunk", "at"], "left")
            .select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], counts))
