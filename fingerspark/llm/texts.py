"""Helpers shared by the operators: reading tables, words, folds, Arrow passes over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Separators between words, and characters of alphanumeric words.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: For UTF-8: A-Z to a-z; and the same with all ASCII that is not alphanumeric to a space.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
TOKEN_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER_BYTES)
#: Every row of this remainder is held out from the learning of labels.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document's labels must not be learned from. A null id is not held out."""
    text = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(text.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def named(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """The columns of ``df`` (or those given) as expressions, whatever characters they hold."""
    return [F.col(f"`{c}`") for c in (df.columns if columns is None else columns)]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_texts(df: DataFrame, text: str, into: str, result: T.StructType,
              start: Callable[[], Callable[[list], list[tuple]]],
              keep: list[str] | None = None) -> DataFrame:
    """Add struct column ``into``, made of column ``text`` batch by batch on the executors.

    ``start`` runs once in each task and returns the function that maps a batch's texts
    to one tuple per text. The columns in ``keep`` (all by default) pass through untouched;
    one called ``into`` is replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != into.lower()]
    read = [*kept, *([] if text in kept else [text])]
    source = df.select(*named(df, read))
    at = read.index(text)
    schema = T.StructType([*source.schema.fields[:len(kept)], T.StructField(into, result)])
    names = [f.name for f in schema]
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in result]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for part in slices(batch):
                columns = zip(*step(part.column(at).to_pylist()))
                made = [pa.array(c, kind) for c, (_, kind) in zip(columns, kinds)]
                struct = pa.StructArray.from_arrays(made, [n for n, _ in kinds])
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], struct], names)

    return source.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text; one row is never cut."""
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, min(rows, int(rows * most / max(1, batch.nbytes))))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def bounded_ids(ids: DataFrame, most: int, seed: str) -> DataFrame:
    """At most ``most`` distinct ids, the same ones at every run: the first by a hash."""
    return ids.distinct().orderBy(F.xxhash64(F.lit(seed), *ids.columns), *ids.columns).limit(most)


def empty(value: str | None) -> str:
    return "" if value is None else value


def tokens_of(text: str | None) -> list[bytes]:
    """The lower-cased alphanumeric words of a text, in UTF-8."""
    return empty(text).encode("utf-8", "surrogatepass").translate(TOKEN_BYTES).split()
