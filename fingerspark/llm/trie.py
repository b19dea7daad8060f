"""Prefix trie of conversations, rolled up by bands of depth.

A node is a sequence of turns with which one or more conversations start. Its key is its depth
and the sum, over its turns, of a digest of place and turn, so keys of all prefixes of a
conversation are running sums, which need no conversation to fit one task. A node is named by
its smallest member, which is unique at each depth.

Totals over subtrees would need a row for each node and ancestor, or a round for each level.
Here the depths are cut into bands of fixed height. A node's value goes to its ancestors within
its band only, so at most ``HEIGHT`` rows come of a node. What a band's root holds then is a
tree of its own, of a height that is smaller by that factor, and is rolled up in the same
way; the completed totals of the roots go to the ancestors in the band above. So there are
as many rounds as the depth has digits to the base ``HEIGHT``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fingerspark.operators.ordered import running_totals
from fingerspark.sources.tables import durable

#: Depths of one band.
HEIGHT = 32
#: Parts of a key, of 32 bits each: sums of them stay exact in a long.
PARTS = ["a", "b", "c", "d"]
#: Ids that are hashed in one piece.
PIECE = 1 << 16
# How conversations are rebuilt from that which their hundred begins with.
HUNDRED = 100
SHARED = 6


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` from 1, a digest of role and text, and the text's length.

    Turns go by ``turn`` with null first; ties by role, the first 64 characters of the text, and
    its digest. Null roles and texts are empty. Rows without ``conv_id`` belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"),
        F.md5(text).alias("body"), F.md5(F.concat(F.length(role), F.lit(":"), role, text)).alias("digest"),
        F.length(text).cast("long").alias("chars"))
    order = ["turn", "role", "head", "body"]
    return running_totals(turns, ["conv_id"], order, {"place": F.lit(1).cast("long")}).select(
        "conv_id", "place", "digest", "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their beginning: their ids with ``length``, and their turns by ``depth``.

    Conversation c begins with the first h turns of conversation c - c % 100 and goes on with its
    own after its first h, where h is its checksum modulo 6.
    """
    turns = durable(ordered_turns(conversations))
    own = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    heads = own.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    ids = (own.withColumns({"h": shared, "base": F.col("conv_id") - F.col("conv_id") % HUNDRED})
           .join(heads, "base", "left")
           .withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0)))))
    length = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    ids = durable(ids.select("conv_id", "base", "h", "taken", length.alias("length")))
    first = turns.filter((F.col("place") < SHARED) & (F.col("conv_id") % HUNDRED == 0)).withColumnRenamed("conv_id", "base")
    begun = ids.join(first, "base").filter(F.col("place") <= F.col("h")).withColumn("depth", F.col("place"))
    gone_on = (turns.join(ids, "conv_id").filter(F.col("place") > F.col("h"))
               .withColumn("depth", F.col("place") - F.col("h") + F.col("taken")))
    columns = ["conv_id", "depth", "length", "digest", "chars"]
    return ids.select("conv_id", "length"), begun.select(columns).unionByName(gone_on.select(columns))


def key_part(i: int) -> Column:
    """32 bits of the digest of place and turn."""
    return F.conv(F.substring("placed", 1 + 8 * i, 8), 16, 10).cast("long")


def prefix_rows(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each conversation and depth, with its ``node`` and the node's own values.

    ``own`` marks the one row of a node that belongs to its smallest member.
    """
    placed = F.sha2(F.concat_ws(":", "depth", "digest"), 256)
    keyed = running_totals(turns.withColumn("placed", placed), ["conv_id"], ["depth"],
                           {p: key_part(i) for i, p in enumerate(PARTS)})
    zero = F.lit(0).cast("long")
    roots = ids.select("conv_id", zero.alias("depth"), "length", zero.alias("chars"), *[zero.alias(p) for p in PARTS])
    rows = durable(keyed.select(roots.columns).unionByName(roots))
    ends = F.col("depth") == F.col("length")
    nodes = rows.groupBy("depth", *PARTS).agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.sum(ends.cast("long")).alias("n_ends"),
        F.max("chars").alias("size"))
    return durable(rows.withColumn("ends", ends).drop("chars", "length").join(nodes, ["depth", *PARTS]).select(
        "conv_id", "depth", "ends", "node", (F.col("conv_id") == F.col("node")).alias("own"), "n_convs",
        (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved")))


def rolled_up(rows: DataFrame, values: list[str], height: int = HEIGHT) -> DataFrame:
    """The totals of ``values`` over each node's subtree, as ``node``, ``depth`` and the totals.

    ``rows`` hold ``conv_id``, ``depth`` without gaps from 0, ``node``, ``own`` and the values,
    which count where ``own`` is true.
    """
    banded = rows.withColumn("band", F.floor(F.col("depth") / height))
    upwards = (Window.partitionBy("conv_id", "band").orderBy(F.desc("depth"))
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.sum(F.when(F.col("own"), 1).otherwise(0)).over(upwards)
    exploded = banded.withColumns({
        "below": own, **{f"_{v}": F.sum(F.when(F.col("own"), F.col(v)).otherwise(0)).over(upwards) for v in values}})
    within = exploded.filter("below > 0").groupBy("node", "depth").agg(*[F.sum(f"_{v}").alias(v) for v in values])
    if (rows.agg(F.max("depth")).first()[0] or 0) < height:
        return within

    within = durable(within)
    edges = banded.filter(F.col("depth") % height == 0)
    zero = [F.lit(0).cast("long").alias(v) for v in values]
    held = edges.filter("own").drop(*values).join(within, ["node", "depth"]).select("conv_id", "band", "node", "own", *values)
    others = edges.filter(~F.col("own")).select("conv_id", "band", "node", "own", *zero)
    roots = rolled_up(durable(held.unionByName(others).withColumnRenamed("band", "depth")), values, height)
    # A root is named by its smallest member, whose rows lead to its ancestors.
    risen = roots.filter("depth > 0").select(F.col("node").alias("conv_id"), (F.col("depth") - 1).alias("band"), *values)
    pushed = (banded.select("conv_id", "band", "node", "depth").join(risen, ["conv_id", "band"])
              .groupBy("node", "depth").agg(*[F.sum(v).alias(v) for v in values]))
    return within.unionByName(pushed).groupBy("node", "depth").agg(*[F.sum(v).alias(v) for v in values])


def id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, depth, id) to texts of ids in order, one or more for each node."""
    names = ["node", "depth", "first", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    key, ids = None, []

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        done = []
        for node, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (node, depth) or len(ids) == PIECE:
                if ids:
                    done.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = (node, depth), []
            ids.append(conv)
        if done:
            yield made(done)
    if ids:
        yield made([(*key, ids[0], ",".join(map(str, ids)))])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of ids to one SHA-256 for each node. A node's pieces pass one by one."""
    names = ["node", "depth", "ends_sha256"]
    key, state = None, None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string()])], names)

    for batch in batches:
        done = []
        for node, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("node", "depth", "ids"))):
            if key == (node, depth):
                state.update(b",")
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (node, depth), hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield made(done)
    if key is not None:
        yield made([(*key, state.hexdigest())])


def ends(rows: DataFrame) -> DataFrame:
    """For each node at which conversations end, the digest of their ids."""
    found = rows.filter("ends").select("node", "depth", "conv_id")
    pieces = (found.repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id")
              .mapInArrow(id_pieces, "node long, depth long, first long, ids string"))
    return (pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first")
            .mapInArrow(digests, "node long, depth long, ends_sha256 string"))


def prefix_trie(ids: DataFrame, turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row for each node of the trie of conversations.

    ``ids`` holds each conversation's ``conv_id`` (long) once, with its ``length``; ``turns`` its
    turns: ``conv_id``, ``depth`` from 1 without gaps, ``length``, ``digest`` and ``chars``. Nodes
    come with ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Conversations without turns are members of the root alone. Equal conversations share all nodes.
    No conversations give no nodes. Texts of any length count by digest and length. Other columns
    are not read, so their names do not matter.
    """
    rows = prefix_rows(ids, turns)
    totals = rolled_up(rows.drop("ends"), ["leaves", "saved"], height)
    above = rows.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    nodes = rows.filter("own").select("conv_id", "depth", "n_convs").join(above, ["conv_id", "depth"], "left")
    children = (nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
                .agg(F.count("*").alias("n_children")))
    named = {"node": "conv_id"}
    return (nodes.join(children, ["conv_id", "depth"], "left")
            .join(totals.withColumnsRenamed(named), ["conv_id", "depth"])
            .join(ends(rows).withColumnsRenamed(named), ["conv_id", "depth"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
                    F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))


def shared_beginnings(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (``conv_id``, ``turn``, ``role``, ``text``) after :func:`rebuilt`.

    Nulls: ``turn`` comes first, ``role`` and ``text`` are empty, rows without ``conv_id`` count
    nowhere. Ties and repeated rows: each row is a turn. An empty table gives no nodes. Texts may be of
    any length; further columns are not read.
    """
    return prefix_trie(*rebuilt(conversations.select("conv_id", "turn", "role", "text")))
