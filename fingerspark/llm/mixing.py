"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is r times its size takes every document floor(r) times, and each
once more with probability r - floor(r). Which ones is drawn so that the words and the
documents taken match their expected totals: the probabilities of three documents at a
time move along the direction that changes neither total until one of them is 0 or 1.

The flight runs in blocks of a source's documents. A block leaves at most two documents
undecided; those of all blocks of a source fly on together, level by level, until at most
two a source remain, which land where the words come nearest to the target. What their landing
is off by a few shorter documents make up for.
"""

from __future__ import annotations

import functools
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fingerspark.llm.texts import SPACES, free_name, named
from fingerspark.sources.tables import durable

# Weights of the sources in order, repeating; the share of all sizes that the
# mix takes; how often a document may be taken.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: Documents of a source that fly in one task. It bounds memory only: more make more blocks.
BLOCK = 4_000
#: Documents of a source that are decided anew after landing, at most.
MOST_SETTLED = 16
SEED = 20240131
TINY = 1e-9


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^[{SPACES}]+|[{SPACES}]+\z", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"[{SPACES}]+"))).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str) -> DataFrame:
    """One row for each source: its size, number of units and target.

    Targets are proportional to the weights but stop at ``MOST_COPIES`` times a source's
    size; what is above goes to the others by weight. So a target is the smaller of that
    limit and weight times a level that makes the targets' sum the share of all sizes. In
    order of limit over weight the first sources are full; the level if just those before a
    source are full rises up to the first that is not, and falls after it, so it is the
    highest of these. These are windows over one row for each source.
    """
    totals = durable(sizes.groupBy(F.col(source).alias("source")).agg(
        F.sum(size).alias("source_size"), F.count("*").alias("units")))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = totals.withColumn("weight", F.get(weights, (F.row_number().over(by_name) - 1) % len(WEIGHTS)))
    everything = Window.partitionBy()
    limit = F.col("source_size") * F.lit(float(MOST_COPIES))
    filling = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0.0), SHARE * F.sum("source_size").over(everything)
                      - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
    weight_left = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    level = F.max("_level").over(everything)
    return ranked.withColumn("_level", left / weight_left).select(
        "source", "source_size", "units", F.least(limit, F.col("weight") * level).alias("target"))


def direction(columns: list[tuple[float, float]]) -> list[float] | None:
    """A change of two or three probabilities that keeps both totals; None if there is none."""
    if len(columns) == 3:
        (a, x), (b, y), (c, z) = columns
        u = [b * z - c * y, c * x - a * z, a * y - b * x]
        if any(u):
            most = max(map(abs, u))
            return [v / most for v in u]
    for i in range(len(columns)):
        for j in range(i):
            (a, x), (b, y) = columns[j], columns[i]
            if a * y == b * x:
                p, q = (a, b) if a or b else (x, y)
                u = [0.0] * len(columns)
                u[j], u[i] = (1.0, -p / q) if q else (0.0, 1.0)
                return u
    return None


def fly(chances: list[float], columns: list[tuple[float, float]], draw: random.Random) -> list[float]:
    """Move the chances until at most two are neither 0 nor 1."""
    chances = list(chances)
    waiting = [k for k in range(len(chances) - 1, -1, -1) if 0 < chances[k] < 1]
    active: list[int] = []
    while True:
        while waiting and len(active) < 3:
            active.append(waiting.pop())
        u = direction([columns[k] for k in active])
        if u is None:
            return chances
        ahead = min((1 - chances[k]) / v if v > 0 else chances[k] / -v for k, v in zip(active, u) if v)
        back = min(chances[k] / v if v > 0 else (1 - chances[k]) / -v for k, v in zip(active, u) if v)
        step = ahead if draw.random() * (ahead + back) < back else -back
        for k, v in zip(active, u):
            moved = chances[k] + step * v
            chances[k] = 0.0 if moved < TINY else 1.0 if moved > 1 - TINY else moved
        active = [k for k in active if 0 < chances[k] < 1]


def land(chances: list[float], columns: list[tuple[float, float]]) -> list[float]:
    """Decide what the flight left so that words, then documents, come nearest to their totals."""
    open_ = [k for k, p in enumerate(chances) if 0 < p < 1]
    best = None
    for bits in range(1 << len(open_)):
        ends = [float(bits >> i & 1) for i in range(len(open_))]
        off = [abs(sum((e - chances[k]) * columns[k][c] for k, e in zip(open_, ends))) for c in (0, 1)]
        if best is None or (off, ends) < best:
            best = (off, ends)
    chances = list(chances)
    for k, e in zip(open_, best[1]):
        chances[k] = e
    return chances


def settle(before: list[float], chances: list[float], columns: list[tuple[float, float]]) -> list[float]:
    """Decide a few documents anew, long ones first, while that brings the words nearer to their total.

    Landing may leave the words off by half a long document; at most ``MOST_SETTLED`` others make up for it.
    """
    chances, settled = list(chances), 0
    short = sum((b - c) * size for b, c, (size, _) in zip(before, chances, columns))
    for k in sorted(range(len(columns)), key=lambda k: (-columns[k][0], k)):
        change = columns[k][0] if chances[k] == 0 else -columns[k][0]
        if 0 < before[k] < 1 and settled < MOST_SETTLED and abs(short - change) < abs(short) - TINY:
            chances[k], short, settled = 1 - chances[k], short - change, settled + 1
    return chances


def _flight(last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        # Long documents fly first, so what is left to land is short.
        block = block.sort_values(["size", "unit"], ascending=[False, True]).reset_index(drop=True)
        columns = list(zip(block["size"].astype(float), block["rows"].astype(float)))
        draw = random.Random(f"{SEED}:{block['unit'].iloc[0]}:{len(block)}")
        before = block["chance"].tolist()
        chances = fly(before, columns, draw)
        block["chance"] = settle(before, land(chances, columns), columns) if last else chances
        return block
    return run


def draw(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """Units with ``chance`` moved to 0 or 1, balanced within each ``source``.

    ``units`` has source, unit (a hash that names it), size, rows, chance and ``n``, the
    number of units of the source. Blocks are dealt by hash; each level stores its result
    and hands on at most two units a block.
    """
    columns = ["source", "unit", "size", "rows", "chance"]
    kinds = "source string, unit bigint, size bigint, rows bigint, chance double"
    decided, flying, level = [], units.select(*columns, "n"), 0
    while True:
        blocks = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("long")
        last = (flying.agg(F.max(blocks)).first()[0] or 1) == 1
        fly_block = _flight(last)
        dealt = flying.withColumn("block", F.pmod(F.xxhash64("unit", F.lit(level)), blocks))
        flown = durable(dealt.groupBy("source", "block").applyInPandas(
            lambda pdf: fly_block(pdf[columns]), kinds))
        undecided = (F.col("chance") > 0) & (F.col("chance") < 1)
        decided.append(flown if last else flown.filter(~undecided))
        if last:
            return functools.reduce(DataFrame.unionByName, decided)
        left = flown.filter(undecided)
        counts = left.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("n"))
        flying, level = left.join(counts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), level + 1


def with_mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
             into: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """Add struct ``into``: size, the source's size and target, copies and words taken.

    A null text has size 0; null is a source of its own, the last in order. Rows equal in
    id, source and text are one unit: all of them are taken equally often. Sources without
    words have target 0. Very long texts count all their words; one that is most of its source decides how
    near that comes to its target. An empty table stays empty. ``keep`` names the columns to pass on,
    all by default; one called ``into`` is replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != into.lower()]
    sized = df.select(F.struct(*named(df, kept)).alias("_row"), F.col(source).cast("string").alias("_source"),
                      word_count(F.col(text)).alias("_size"),
                      F.xxhash64(doc_id, source, text).alias("_unit"))
    if text not in kept:
        sized = durable(sized)
    units = durable(sized.groupBy(F.col("_source").alias("source"), F.col("_unit").alias("unit")).agg(
        F.sum("_size").alias("size"), F.count("*").alias("rows")))
    targets = source_targets(units, "source", "size").withColumnRenamed("source", "_of")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(0.0)
    whole = F.floor(ratio + TINY)
    planned = units.join(targets, F.col("source").eqNullSafe(F.col("_of"))).withColumns({
        "whole": whole, "chance": F.when(ratio - whole < TINY, 0.0).otherwise(ratio - whole), "n": F.col("units")})
    drawn = draw(planned)
    extra = drawn.select(F.col("source").alias("_of"), F.col("unit").alias("_drawn"), F.col("chance").cast("long").alias("_extra"))
    by_source = targets.select(F.col("_of").alias("_named"), "source_size", "target", whole.alias("_whole"))
    out = sized.join(extra, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_unit") == F.col("_drawn")))
    out = out.join(by_source, F.col("_source").eqNullSafe(F.col("_named")))
    copies = F.col("_whole") + F.col("_extra")
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], F.struct(
        F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"),
        (F.col("_size") * copies).alias("taken")).alias(into))


def mixed(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The documents that the mix takes, with ``copies`` and ``taken``; replaced if present.

    Nulls, repeated rows, ties and long texts as in :func:`with_mix`. Documents that are taken no time go.
    """
    into = free_name(df, "mix")
    kept = [c for c in df.columns if c.lower() not in ("copies", "taken")]
    return with_mix(df, text, source, doc_id, into).filter(F.col(f"{into}.copies") > 0).select(
        *named(df, kept), f"{into}.copies", f"{into}.taken")
