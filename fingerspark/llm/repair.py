"""Repair of conversations whose roles do not alternate, by the cheapest edits.

Rows and states make a lattice: after i rows the conversation so far is in one of four states
(nothing yet, system said, user said, assistant said). Keeping, re-roling or deleting a row leads
to the next row, inserting a turn leads to another state. A search runs from both ends: two
heaps settle nodes by cost until no cheaper or equally cheap crossing can be left; of all equal
crossings the one whose audit, put together, is least in ASCII wins.

A conversation of any length is cut into slices of ``SLICE`` rows. A slice is solved for each
state it may be entered and left in; the solved slices of a conversation are then chained by
cost and by the order of their audits, which are short numbers, whatever the slices hold.
Inserted turns belong before a row, and after the last one only at the end, so audits up to
a slice's end are never beginnings of one another and their order decides.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fingerspark.llm.texts import SPACES
from fingerspark.operators.ordered import running_totals
from fingerspark.sources.tables import durable

#: Rows that one search goes over.
SLICE = 256
# Costs of edits, and of leaving a truncated row.
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 1, 2, 5, 5
# The grammar of role initials, s?(ua)+ or nothing, as steps between states.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
COMPLETE = (NOTHING, ASSISTANT)
STATES = range(4)
LEGAL = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")
# Kinds of damage by checksum modulo KINDS.
KINDS = 20
DROPPED, EMPTIED, UNENDED, REPEATED, MADE_USER = range(5)
#: Signs of rows for the search: initials s, u, a or another (x); upper case if truncated.
MUST_GO = "-"

#: An edge's other end, cost and letter.
Edge = tuple[tuple[int, int], int, str]


def forward_edges(signs: str, node: tuple[int, int], last: bool) -> Iterator[Edge]:
    """Edits that lead on from a node (rows done, state)."""
    i, state = node
    if i < len(signs) or last:
        for initial in "ua":
            if (state, initial) in STEPS:
                yield (i, STEPS[state, initial]), INSERT, "I"
    if i == len(signs):
        return
    sign = signs[i]
    yield (i + 1, state), DELETE, "D"
    if sign == MUST_GO:
        return
    more = LEFT_TRUNCATED if sign.isupper() else 0
    if (state, sign.lower()) in STEPS:
        yield (i + 1, STEPS[state, sign.lower()]), KEEP + more, "K"
    for initial in "ua":
        if (state, initial) in STEPS:
            yield (i + 1, STEPS[state, initial]), REROLE + more, "R"


def backward_edges(signs: str, node: tuple[int, int], last: bool) -> Iterator[Edge]:
    """The same edits from their ends."""
    i, state = node
    for before in STATES:
        for j in (i - 1, i):
            if j >= 0:
                for end, cost, letter in forward_edges(signs, (j, before), last):
                    if end == node:
                        yield (j, before), cost, letter


def cheapest(signs: str, entry: int, exits: tuple[int, ...], last: bool) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits between states, the least audit of equal cost.

    Each heap is ordered by cost, then by rows done: edges of no cost lead to another row, so when a
    node is settled all its equally cheap predecessors are, and its audit is the least. A way is
    found at the edge from a node settled forwards to one settled backwards. Once the heaps' costs
    together exceed the best, every way as cheap as it has such an edge.
    """
    heaps: tuple[list, list] = ([(0, 0, "", (0, entry))], [(0, 0, "", (len(signs), e)) for e in exits])
    settled: tuple[dict, dict] = ({}, {})
    best: tuple[int, str] | None = None
    while heaps[0] and heaps[1]:
        tops = heaps[0][0][0], heaps[1][0][0]
        if best is not None and sum(tops) > best[0]:
            return best
        best = settle(signs, last, int((tops[1], len(settled[1])) < (tops[0], len(settled[0]))), heaps, settled, best)
    # All that one side can reach is settled; the other may still have to meet it.
    for side in (0, 1):
        while heaps[side] and (best is None or heaps[side][0][0] <= best[0]):
            best = settle(signs, last, side, heaps, settled, best)
    return best


def settle(signs: str, last: bool, side: int, heaps: tuple[list, list], settled: tuple[dict, dict],
           best: tuple[int, str] | None) -> tuple[int, str] | None:
    """Take the next node off a heap; the better of ``best`` and the ways that cross there."""
    cost, _, audit, node = heappop(heaps[side])
    if node in settled[side]:
        return best
    settled[side][node] = (cost, audit)
    for end, step, letter in (forward_edges, backward_edges)[side](signs, node, last):
        through = letter + audit if side else audit + letter
        if end in settled[1 - side]:
            more, rest = settled[1 - side][end]
            found = (cost + step + more, rest + through if side else through + rest)
            best = found if best is None else min(best, found)
        if end not in settled[side]:
            heappush(heaps[side], (cost + step, len(signs) - end[0] if side else end[0], through, end))
    return best


def solved(signs: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """All (entry, exit, cost, audit) of a slice, in the order of their audits.

    The exit of a conversation's last slice is its accepted end, in either state.
    """
    out = []
    for entry in (NOTHING,) if first else STATES:
        for exits in (COMPLETE,) if last else ((e,) for e in STATES):
            found = cheapest(signs, entry, exits, last)
            if found:
                out.append((entry, exits[0], *found))
    return sorted(out, key=lambda r: r[3])


def roles_of(entry: int, audit: str, signs: str) -> list[tuple[str, str, str]]:
    """For each row: initials inserted before it, its edit, and its new initial (or none).

    A last entry holds what is inserted after the rows.
    """
    out, state, before, i = [], entry, "", 0
    for letter in audit:
        initial = ""
        if letter == "K":
            initial = signs[i].lower()
        elif letter in "RI":
            initial = "a" if state == USER else "u"
        if initial:
            state = STEPS[state, initial]
        if letter == "I":
            before += initial
            continue
        out.append((before, letter, initial if letter == "R" else ""))
        before, i = "", i + 1
    return [*out, (before, "", "")]


def ordered_rows(turns: DataFrame, order: list[str | Column]) -> DataFrame:
    """Number the rows of each conversation from 1, and find their faults. Texts stay behind.

    ``turns`` hold ``conv`` (a text without nulls), ``role`` and ``text`` (neither null), and what
    ``order`` needs. ``fault`` is the first that applies: blank, duplicate, truncated, or none (null).
    """
    facts = {"digest": said(), "blank": ~F.col("text").rlike(f"[^{SPACES}]"),
             "truncated": ~F.col("text").rlike(rf"[.!?][{SPACES}]*\z"), "initial": F.substring("role", 1, 1)}
    narrow = turns.withColumns(facts).drop("text")
    numbered = durable(running_totals(narrow, ["conv"], order, {"place": F.lit(1).cast("long")})
                       .select("conv", "place", *facts))
    earliest = numbered.groupBy("conv", "digest").agg(F.min("place").alias("earliest"))
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("earliest"), "duplicate").when(F.col("truncated"), "truncated")
    return durable(numbered.join(earliest, ["conv", "digest"]).select(
        "conv", "place", "digest", "initial", fault.alias("fault"), F.floor((F.col("place") - 1) / SLICE).alias("slice")))


def said() -> Column:
    """A digest of role and text."""
    return F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))


def in_slices(rows: DataFrame) -> DataFrame:
    """One row for each slice: its signs, whether it is its conversation's first or last, its illegal pairs."""
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    sign = (F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(known))
            .otherwise(known))
    listed = rows.groupBy("conv", "slice").agg(
        F.sort_array(F.collect_list(F.struct("place", sign.alias("sign"), "initial"))).alias("rows"))
    by_slice = Window.partitionBy("conv").orderBy("slice")
    before = F.lag(F.element_at("rows.initial", -1)).over(by_slice)
    initials = F.concat(F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.array(before)), F.col("rows.initial"))
    illegal = F.size(F.filter(
        F.zip_with("initials", F.slice("initials", F.lit(2), F.size("initials")), lambda x, y: F.concat(x, y)),
        lambda pair: pair.isNotNull() & ~pair.isin(*LEGAL)))
    return (listed.withColumns({"initials": initials, "last": F.lead("slice").over(by_slice).isNull()})
            .select("conv", "slice", F.array_join("rows.sign", "").alias("signs"), (F.col("slice") == 0).alias("first"), "last",
                    illegal.cast("long").alias("illegal")))


WAYS = "conv string, slice long, signs string, illegal long, ways array<struct<entry:int,exit:int,cost:long,audit:string>>"


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    same = ["conv", "slice", "signs", "illegal"]
    known = functools.lru_cache(maxsize=4096)(solved)
    for batch in batches:
        ways = [[dict(zip(("entry", "exit", "cost", "audit"), w)) for w in known(*row)]
                for row in zip(*(batch.column(c).to_pylist() for c in ("signs", "first", "last")))]
        yield pa.RecordBatch.from_arrays([*map(batch.column, same), pa.array(ways, kind)], [*same, "ways"])


def chain(slices: list[list[tuple[int, int, int]]]) -> tuple[int, list[int]]:
    """The cost of the best way through all slices, and which way of each slice it takes.

    Ways are (entry, exit, cost) in the order of their audits, so a way's number tells its rank.
    """
    reached = {NOTHING: (0, 0)}  # state: cost, rank of the audit so far
    taken = []
    for ways in slices:
        found: dict[int, tuple] = {}
        for rank, (entry, leave, cost) in enumerate(ways):
            if entry in reached:
                way = (reached[entry][0] + cost, reached[entry][1], rank)
                found[leave] = min(found.get(leave, way), way)
        order = sorted(found, key=lambda e: found[e][1:])
        reached = {e: (found[e][0], order.index(e)) for e in found}
        taken.append({e: found[e][2] for e in found})
    end, (total, _) = min(reached.items(), key=lambda r: r[1])
    chosen = []
    for ways, way in zip(reversed(slices), reversed(taken)):
        chosen.append(way[end])
        end = ways[way[end]][0]
    return total, chosen[::-1]


def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way of each slice, from the slices of each conversation in order."""
    key, slices = None, []

    def done() -> list[tuple]:
        total, chosen = chain(slices)
        return [(key, i, way, total) for i, way in enumerate(chosen)]

    for batch in batches:
        out = []
        for conv, at, ways in zip(*(batch.column(c).to_pylist() for c in ("conv", "slice", "ways"))):
            if at == 0 and slices:
                out += done()
                slices = []
            key = conv
            slices.append([(w["entry"], w["exit"], w["cost"]) for w in ways])
        if out:
            yield rows_of(out, CHOICE)
    if slices:
        yield rows_of(done(), CHOICE)


CHOICE = {"conv": pa.string(), "slice": pa.int64(), "way": pa.int64(), "cost": pa.int64()}
DIGEST = {"conv": pa.string(), "audit": pa.string(), "cost": pa.int64(), "illegal": pa.int64(), "repaired_sha256": pa.string()}


def rows_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each row of the slices."""
    kind = pa.list_(pa.struct([("before", pa.string()), ("letter", pa.string()), ("anew", pa.string())]))
    for batch in batches:
        edits = [[dict(zip(("before", "letter", "anew"), e)) for e in roles_of(*row)]
                 for row in zip(*(batch.column(c).to_pylist() for c in ("entry", "audit", "signs")))]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("slice"), pa.array(edits, kind)],
                                         ["conv", "slice", "edits"])


def solved_slices(rows: DataFrame) -> DataFrame:
    """One row for each slice of a conversation: its cheapest ``audit``, how it is entered, the whole ``cost``."""
    ways = durable(in_slices(rows).mapInArrow(solve, WAYS))
    # Audits stay behind: for the choice a slice is at most sixteen short numbers.
    short = F.transform("ways", lambda w: F.struct(w.entry.alias("entry"), w.exit.alias("exit"), w.cost.alias("cost")))
    chosen = (ways.select("conv", "slice", short.alias("ways")).repartition("conv").sortWithinPartitions("conv", "slice")
              .mapInArrow(choose, "conv string, slice long, way long, cost long"))
    way = F.element_at("ways", (F.col("way") + 1).cast("int"))
    return durable(ways.join(chosen, ["conv", "slice"]).select(
        "conv", "slice", "signs", "illegal", "cost", way.entry.alias("entry"), way.audit.alias("audit")))


def role_of(initial: Column) -> Column:
    return F.when(initial == "u", "user").when(initial == "a", "assistant")


def repaired_turns(turns: DataFrame, rows: DataFrame, slices: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: ``conv``, ``place``, ``step``, ``role`` and ``text``.

    ``place`` is that of the row which a turn was or stands before; ``step`` orders the turns of a
    place. A row that is kept is the first of its role and text, so texts are looked up by their
    digest.
    """
    edits = (slices.mapInArrow(spell, "conv string, slice long, edits array<struct<before:string,letter:string,anew:string>>")
             .select("conv", "slice", F.posexplode("edits").alias("at", "edit"))
             .select("conv", (F.col("slice") * SLICE + F.col("at") + 1).alias("place"), "edit.*"))
    signs = F.filter(F.split("before", ""), lambda c: c != "")
    inserted = edits.filter("before <> ''").select("conv", "place", F.posexplode(signs).alias("step", "initial")).select(
        "conv", "place", "step", role_of(F.col("initial")).alias("role"), F.lit("").alias("text"))
    kept = edits.filter("letter IN ('K', 'R')").select(
        "conv", "place", F.length("before").alias("step"), role_of(F.col("anew")).alias("anew"))
    texts = turns.select("conv", said().alias("digest"), "role", "text").dropDuplicates(["conv", "digest"])
    looked_up = rows.select("conv", "place", "digest").join(kept, ["conv", "place"])
    own = texts.join(looked_up, ["conv", "digest"]).select(
        "conv", "place", "step", F.coalesce("anew", "role").alias("role"), "text")
    return inserted.unionByName(own)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of each conversation; its slices come first, then its turns, which pass one by one."""
    key, audit, cost, illegal, state, started = None, [], 0, 0, None, False
    columns = ("conv", "place", "audit", "cost", "illegal", "line")
    for batch in batches:
        out = []
        for conv, place, letters, total, pairs, line in zip(*(batch.column(c).to_pylist() for c in columns)):
            if state is None or conv != key:
                if state is not None:
                    out.append((key, "".join(audit), cost, illegal, state.hexdigest()))
                key, audit, illegal, state, started = conv, [], 0, hashlib.sha256(), False
            if line is None:
                audit.append(letters)
                cost = total
                illegal += pairs
            else:
                state.update(("\n" + line if started else line).encode())
                started = True
        if out:
            yield rows_of(out, DIGEST)
    if state is not None:
        yield rows_of([(key, "".join(audit), cost, illegal, state.hexdigest())], DIGEST)


def repaired(turns: DataFrame, order: list[str | Column]) -> tuple[DataFrame, DataFrame]:
    """Repair conversations: one row for each with what was found and done, and the repaired turns.

    ``turns`` hold ``conv`` (text), ``turn``, ``role``, ``text``, of which only ``turn`` may be null, and
    what ``order`` names: columns that tell the rows of a conversation apart, but for equal rows. The
    first result has ``conv``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and
    ``repaired_sha256``.

    Blank rows and rows whose role and text were seen earlier are deleted, so repeated rows leave one. Of
    equally cheap repairs the one of the least audit is taken. Conversations and texts may be of any
    length. No rows give no conversations. Other columns are not read.
    """
    rows = ordered_rows(turns, order)
    slices = solved_slices(rows)
    anew = durable(repaired_turns(turns, rows, slices))
    none = F.lit(None)
    lines = anew.select("conv", F.lit(1).alias("kind"), "place", "step", none.cast("string").alias("audit"),
                        none.cast("long").alias("cost"), none.cast("long").alias("illegal"),
                        F.concat("role", F.lit(":"), "text").alias("line"))
    heads = slices.select("conv", F.lit(0).alias("kind"), F.col("slice").alias("place"), F.lit(0).alias("step"), "audit", "cost",
                          "illegal", none.cast("string").alias("line"))
    hashed = (heads.unionByName(lines).repartition("conv").sortWithinPartitions("conv", "kind", "place", "step")
              .mapInArrow(digests, "conv string, audit string, cost long, illegal long, repaired_sha256 string"))
    counts = rows.groupBy("conv").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in FAULTS])
    return hashed.join(counts, "conv"), anew


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conv_id``, ``turn``, ``role`` and ``text`` as the damage by their checksum leaves them.

    Nulls of any column are one space; ``turn`` stays null to be counted. ``order_...`` columns keep the
    order of the rows before the damage.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), space).alias("conv"), F.col("turn"), F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"))
    kind = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % KINDS
    rows = rows.withColumns({"kind": kind, "order_role": F.col("role"), "order_head": F.substring("text", 1, 64),
                             "order_body": F.md5("text")}).filter(F.col("kind") != DROPPED)
    text = (F.when(F.col("kind") == EMPTIED, "").when(F.col("kind") == UNENDED, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("kind") == MADE_USER, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == REPEATED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumns({"text": text, "role": role, "order_copy": F.explode(copies)}).drop("kind")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """What :func:`repaired` finds and does to :func:`damaged` conversations, for each ``conv_id`` of the table.

    Columns: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``,
    ``repaired_sha256``. Rows go by ``turn`` with null first, ties by role, the first 64 characters and the
    digest of the text before the damage. Rows without ``conv_id`` make one conversation. A conversation
    of which no row is left has zeros, an empty audit and the digest of nothing. Empty tables give empty
    ones. Further columns are not read, whatever they are called.
    """
    turns = damaged(conversations)
    found, _ = repaired(turns, ["turn", "order_role", "order_head", "order_body", "order_copy"])
    missing = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    gaps = turns.groupBy("conv").agg(F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"))
    ids = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    zero = F.lit(0).cast("long")
    return ids.join(gaps, "conv", "left").join(found, "conv", "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
