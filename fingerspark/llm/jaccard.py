"""N-gram Jaccard join by parity sketches.

A document's set is that of its hashed word n-grams; equal sets are one entity. Sets are cut
into segments by hash, and a segment's sketch is the XOR of its hashes: it changes with each
n-gram in which two sets differ. Two sets of sizes a and b with Jaccard similarity of at least
0.8 differ in at most (a + b) / 9 n-grams, so if there are more segments than that, some are
equal (pigeonhole); a band of sizes has its own number of segments. Equal segment sketches
make candidates. Finer parity sketches, of one bit for each of as many cells, bound a pair's
difference from below; what they let pass is verified on the sets.

Segments without n-grams are equal in too many sets to tell anything, and so are segments
made of nothing but n-grams that very many documents share. So segments are made of the
other n-grams; if one set has more segments with n-grams than a partner may differ in, one
of these must be equal, and empty ones need not be compared. A set for which this does not
hold also takes part with all its n-grams, and, if that is still too little, with its empty
segments. So no link is lost, whatever is frequent.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fingerspark.llm.texts import LOWER_BYTES, empty, free_name, named, slices
from fingerspark.sources.tables import durable, release

#: Words of an n-gram.
WORDS = 5
#: Two sets link when 100 times what they share is at least this times their union.
PERCENT = 80
#: Sizes of one band grow by this factor at most; segments beyond the largest difference.
BAND, SLACK, MORE = 1.5, 0.08, 5
LARGEST = 1 << 40
#: Counters of n-grams, by hash, that tell which are frequent; deviations above the median.
COUNTERS, DEVIATIONS, ABOVE = 1 << 20, 8.0, 16
#: Bits of the filters of keys and entities that are broadcast: for each of them, and in all (64 MB).
FILTER_BITS = 16
MOST_BITS = 1 << 29
#: Rounds in which entities are compared with one member of each of their keys before all pairs are;
#: 64-bit words of the sketch by which all pairs are compared first.
ROUNDS = 2
LANES = 8
#: Bytes of text hashed at once.
PIECE = 1 << 20
MERGE = 32
CHUNKS = 64

_U = np.uint64
_MULTIPLIER = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                    0xE7037ED1A0B428DB], dtype=_U)


def upper_sizes() -> list[int]:
    """The largest size of each band."""
    sizes = [1]
    while sizes[-1] < LARGEST:
        sizes.append(max(sizes[-1] + 1, int(sizes[-1] * BAND)))
    return sizes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Hashed n-gram sets of texts, many texts at a time."""

    def __init__(self):
        codes = np.arange(256, dtype=_U)
        self.values = mix(codes * _MULTIPLIER + _U(1))
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.powers = self.inverses = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, PIECE + 4096)
            self.powers = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, _MULTIPLIER)]))
            self.inverses = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, _INVERSE)]))

    def _piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words in ``data``."""
        read = np.frombuffer(data, np.uint8)
        self._grow(len(read))
        word = ~self.space[read]
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(self.values[read] * self.powers[:len(read)])])
        own = (sums[ends] - sums[starts]) * self.inverses[starts]
        return starts, mix(own + (ends - starts).astype(_U) * _PLACES[0])

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same, piece by piece, cut between words."""
        starts, hashes, at = [], [], 0
        while at < len(data):
            end = min(len(data), at + PIECE)
            while end < len(data) and not self.space[data[end]]:
                end += 1
            s, h = self._piece(data[at:end])
            starts.append(s + at)
            hashes.append(h)
            at = end
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        return np.concatenate(starts), np.concatenate(hashes)

    def sets(self, texts: list) -> list[np.ndarray]:
        """The sorted different n-gram hashes of each text."""
        with np.errstate(over="ignore"):
            data = [empty(t).encode("utf-8", "surrogatepass").translate(LOWER_BYTES) for t in texts]
            begins = np.cumsum([0, *[len(d) + 1 for d in data]])
            starts, hashes = self.words(b" ".join(data))
            first = np.searchsorted(starts, begins)
            last = len(hashes) - WORDS + 1
            grams = np.zeros(max(0, last), _U)
            for k in range(WORDS):
                grams += hashes[k:k + len(grams)] * _PLACES[k]
            grams = mix(grams)
            out = []
            for a, b in zip(first[:-1], first[1:]):
                if b - a >= WORDS:
                    out.append(np.unique(grams[a:b - WORDS + 1]))
                elif b > a:
                    whole = (hashes[a:b] * _PLACES[:b - a]).sum(dtype=_U) + _U(b - a)
                    out.append(mix(np.array([whole], _U)))
                else:
                    out.append(np.zeros(0, _U))
            return out


def entity_of(grams: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(grams.tobytes(), seed=len(grams)) - (1 << 63)


class Segmenter:
    """Keys of a set's segment sketches in each of its bands."""

    def __init__(self, frequent: bytes | None):
        self.uppers, self.tags = upper_sizes(), {}
        self.frequent = None if frequent is None else np.unpackbits(np.frombuffer(frequent, np.uint8)).astype(bool)

    def bands(self, n: int) -> list[tuple[int, int, int]]:
        """(band, segments, difference that a partner in it may have at most)."""
        out = []
        for k in sorted({bisect_left(self.uppers, n), bisect_left(self.uppers, n * 100 // PERCENT)}):
            upper = self.uppers[k]
            most = (100 - PERCENT) * (n + min(upper, n * 100 // PERCENT)) // (100 + PERCENT)
            if most:                                         # else only an equal set is similar enough
                widest = (100 - PERCENT) * 2 * upper // (100 + PERCENT)
                out.append((k, widest + 1 + int(SLACK * widest) + MORE, most))
        return out

    def tag(self, space: int, band: int) -> tuple[np.uint64, np.uint64]:
        """A number for the segments of a band, and its hash."""
        if (space, band) not in self.tags:
            own = _U(space * 1000 + band)
            self.tags[space, band] = own, mix(np.array([own]))[0]
        return self.tags[space, band]

    def segments(self, grams: np.ndarray, hashes: np.ndarray, space: int, band: int, count: int, empty_too: bool) -> np.ndarray:
        """Keys of the segments of n-grams, of which the hashes that a sketch is made of are given."""
        tag, mixed = self.tag(space, band)
        if len(grams):
            at = mix(grams + mixed) % _U(count)
            # Short numbers are ordered by radix.
            order = np.argsort(at.astype(np.uint16) if count <= 1 << 16 else at, kind="stable")
            at = at[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sketch = np.bitwise_xor.reduceat(hashes[order], first)
            at = at[first]
        else:
            at = sketch = grams
        if empty_too:
            missing = np.setdiff1d(np.arange(count, dtype=_U), at)
            at, sketch = np.concatenate([at, missing]), np.concatenate([sketch, np.zeros(len(missing), _U)])
        return mix(sketch + mix(at * _PLACES[2] + tag * _PLACES[3]))

    def keys(self, grams: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = [np.zeros(0, _U)]
            hashes = mix(grams ^ _PLACES[1])
            rare, rare_hashes = grams, hashes
            if self.frequent is not None and len(grams):
                seldom = ~self.frequent[bucket_of(grams)]
                rare, rare_hashes = grams[seldom], hashes[seldom]
            for band, count, most in self.bands(len(grams)):
                some = self.segments(rare, rare_hashes, 0, band, count, False)
                out.append(some)
                if len(some) <= most:
                    every = self.segments(grams, hashes, 1, band, count, False)
                    out.append(every if len(every) > most else self.segments(grams, hashes, 1, band, count, True))
            return np.concatenate(out).view(np.int64)


def bucket_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> _U(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def parity_bits(grams: np.ndarray) -> bytes:
    """One bit for each cell, about two cells an n-gram: whether it holds an odd number."""
    cells = 1 << max(6, (2 * len(grams) - 1).bit_length())
    odd = np.bincount((grams & _U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def lanes_of(grams: np.ndarray) -> list[int]:
    """A sketch of fixed size, as signed 64-bit words."""
    cells = 64 * LANES
    odd = np.bincount((grams >> _U(20) & _U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def least_difference(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches; the longer one is folded to the shorter one's cells."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def may_link(n: int, m: int, difference: int) -> bool:
    """Whether sets of these sizes that differ in so many n-grams reach the similarity."""
    shared = n + m - difference                              # twice what they share
    return 100 * shared >= PERCENT * (n + m + difference)


Batches = Iterator[pa.RecordBatch]


def scan(df: DataFrame, schema: str | T.StructType, each: Callable[[], Callable[[pa.RecordBatch, list], Iterator[dict]]],
         wanted: Broadcast | None = None) -> DataFrame:
    """Map pieces of ``df``, whose last column is text, with their n-gram sets to new rows.

    With ``wanted``, a filter of numbers, rows whose first column it does not hold are left out unread.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, types = fields.names, [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Batches) -> Batches:
        shingler, step = Shingler(), each()
        bits = None if wanted is None else np.frombuffer(wanted.value, np.uint8)

        def made(columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                columns[n].cast(t) if isinstance(columns[n], pa.Array) else pa.array(columns[n], t)
                for n, t in zip(names, types)], names)

        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(in_filter(bits, batch.column(0).to_numpy())))
            for part in slices(batch, PIECE):
                texts = part.column(part.num_columns - 1).to_pylist()
                for columns in step(part, shingler.sets(texts)):
                    yield made(columns)
        for columns in step(None, []):
            yield made(columns)

    return df.mapInArrow(run, fields)


def merged_counts(parts: DataFrame) -> np.ndarray:
    """Arrays of counts that tasks gave in (place, part, data) chunks, summed over the tasks.

    Few are combined at a time, level by level; the result has a fixed size.
    """
    width = parts.agg(F.max("part")).first()[0]

    def run(pdf):
        total = np.sum([np.frombuffer(d, np.int32) for d in pdf["data"]], axis=0, dtype=np.int32)
        return pdf.iloc[:1][["place", "part"]].assign(data=total.tobytes())

    while width:
        width //= MERGE
        grouped = parts.withColumn("part", F.floor(F.col("part") / MERGE).cast("bigint")).groupBy("place", "part")
        parts = durable(grouped.applyInPandas(run, "place bigint, part bigint, data binary"))
    rows = parts.groupBy("place").applyInPandas(run, "place bigint, part bigint, data binary").collect()
    if not rows:
        return np.zeros(0, np.int32)
    return np.concatenate([np.frombuffer(r["data"], np.int32) for r in sorted(rows, key=lambda r: r["place"])])


def chunks_of(array: np.ndarray) -> tuple[list[int], list[bytes]]:
    return list(range(CHUNKS)), [c.tobytes() for c in np.split(array, CHUNKS)]


def part_number() -> int:
    from pyspark import TaskContext
    return TaskContext.get().partitionId()


def read_entities(rows: DataFrame) -> DataFrame:
    """(id, mark, n, entity) of each row, and the task's counters of n-grams in (place, part, data)."""
    def each():
        counts = np.zeros(COUNTERS, np.int32)

        def step(part, sets):
            nonlocal counts
            if part is None:
                places, data = chunks_of(counts)
                none = [None] * CHUNKS
                yield {"id": none, "mark": none, "n": none, "entity": none, "place": places,
                       "part": [part_number()] * CHUNKS, "data": data}
                return
            counts += np.bincount(bucket_of(np.concatenate(sets)), minlength=COUNTERS).astype(np.int32)
            none = [None] * len(sets)
            yield {"id": part.column(0), "mark": part.column(1), "n": [len(s) for s in sets],
                   "entity": [entity_of(s) if len(s) else None for s in sets], "place": none, "part": none, "data": none}
        return step

    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL(
        "mark bigint, n bigint, entity bigint, place bigint, part bigint, data binary")])
    return durable(scan(rows, schema, each))


def frequent_buckets(counts: np.ndarray) -> bytes | None:
    """A bit for each counter that is far above the median."""
    if not len(counts):
        return None
    median = float(np.median(counts))
    return np.packbits(counts > median + DEVIATIONS * np.sqrt(median) + ABOVE).tobytes()


def shared_keys(rows: DataFrame, frequent) -> DataFrame:
    """Keys that more than one entity has. Partly aggregated first, so hot keys hardly travel."""
    def each():
        segmenter, seen = Segmenter(frequent.value), set()

        def step(part, sets):
            if part is None:
                return
            keys, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for grams in sets:
                name = entity_of(grams)
                if name in seen or not len(grams):
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                own = segmenter.keys(grams)
                keys.append(own)
                owners.append(np.full(len(own), name))
            yield {"key": np.concatenate(keys), "entity": np.concatenate(owners)}
        return step

    keyed = scan(rows, "key bigint, entity bigint", each)
    return keyed.groupBy("key").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).filter("a < b").select("key")


def bit_filter(values: DataFrame) -> bytes:
    """A filter of 64-bit numbers (one column) that misses none of them.

    Its size goes by their number, up to ``MOST_BITS``, which bounds what is broadcast: of still more numbers
    it lets others through more often, which costs rows in the joins but no link.
    """
    bits = min(MOST_BITS, max(1 << 15, 1 << (FILTER_BITS * values.count()).bit_length()))
    place = F.col(values.columns[0]).bitwiseAND(F.lit(bits - 1)) + 1  # Spark numbers bits and stretches from 1
    # Numbers meet at their stretch of the filter before it is made, so that no task holds all of it.
    placed = values.select(F.bitmap_bucket_number(place).alias("at"), F.bitmap_bit_position(place).alias("bit")).repartition("at")
    out = bytearray(bits // 8)
    for row in placed.groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bitmap")).collect():
        end = row["at"] * len(row["bitmap"])
        out[end - len(row["bitmap"]):end] = row["bitmap"]
    return bytes(out)


def in_filter(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def read_candidates(rows: DataFrame, frequent, keys_filter) -> DataFrame:
    """(entity, n, sketch, keys, lanes) of each entity with keys that the filter holds."""
    def each():
        segmenter, seen = Segmenter(frequent.value), set()
        bits = np.frombuffer(keys_filter.value, np.uint8)

        def step(part, sets):
            out = {c: [] for c in ("entity", "n", "sketch", "keys", "lanes")}
            for grams in sets:
                name = entity_of(grams)
                if name in seen or not len(grams):
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                own = segmenter.keys(grams)
                own = np.unique(own[in_filter(bits, own)])
                if len(own):
                    for column, value in zip(out.values(), (name, len(grams), parity_bits(grams), own, lanes_of(grams))):
                        column.append(value)
            yield out
        return step

    found = scan(rows, "entity bigint, n bigint, sketch binary, keys array<bigint>, lanes array<bigint>", each)
    # Copies in other tasks have equal rows.
    return durable(found.groupBy("entity").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "keys", "lanes")]))


def sketched(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sketches of their own sizes do not rule out."""
    for side in ("a", "b"):
        own = candidates.select(F.col("entity").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
        pairs = pairs.join(own, side)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = batch.to_pydict()
            good = [may_link(n, m, least_difference(x, y)) for n, m, x, y in zip(rows["na"], rows["nb"], rows["sa"], rows["sb"])]
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield kept.select(["a", "b"])

    return durable(pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint"))


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose sets reach the similarity. Only one text of each paired entity is read again.

    ``docs`` names the ``mark`` of each text with its ``entity``. ``pairs`` is a durable table, which goes.
    """
    wanted = durable(pairs.select(F.col("a").alias("entity")).union(pairs.select("b")).distinct())
    marks = durable(docs.join(wanted, "entity", "left_semi").groupBy("entity").agg(F.min("mark").alias("mark")).select("mark"))
    shared = rows.sparkSession.sparkContext.broadcast(bit_filter(marks))

    def each():
        seen = set()

        def step(part, sets):
            out = {"entity": [], "grams": []}
            for grams in sets:
                if not len(grams):
                    continue
                name = entity_of(grams)
                if name not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(name)
                    out["entity"].append(name)
                    out["grams"].append(grams.tobytes())
            yield out
        return step

    sets = scan(rows.select("mark", "text"), "entity bigint, grams binary", each, shared).join(wanted, "entity", "left_semi")
    sets = durable(sets.groupBy("entity").agg(F.first("grams").alias("grams")))
    both = pairs.join(sets.select(F.col("entity").alias("a"), F.col("grams").alias("x")), "a")
    both = both.join(sets.select(F.col("entity").alias("b"), F.col("grams").alias("y")), "b")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, PIECE):
                rows_ = part.to_pydict()
                good = []
                for x, y in zip(rows_["x"], rows_["y"]):
                    x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * common >= PERCENT * (len(x) + len(y) - common))
                yield part.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    good = durable(both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"))
    release(sets, wanted, marks, pairs)
    return good


def components(edges: DataFrame) -> DataFrame:
    """(entity, label): the smallest entity that each one reaches over the edges (a, b).

    Labels pass to neighbours and then jump to the label's own label, until none changes.
    """
    both = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("entity")).agg(F.least(F.min("b"), F.col("entity")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("entity")).groupBy("a").agg(F.min("label").alias("near"))
        passed = durable(labels.join(near, F.col("entity") == F.col("a"), "left").select(
            "entity", "label", F.least("label", "near").alias("new")))
        far = passed.select(F.col("entity").alias("at"), F.col("new").alias("far"))
        jumped = durable(passed.join(far, F.col("new") == F.col("at"), "left").select(
            "entity", F.least("new", "far").alias("new"), "label"))
        release(labels, passed)
        if not jumped.filter("new < label").limit(1).count():
            release(both)
            return jumped.select("entity", F.col("new").alias("label"))
        labels = durable(jumped.select("entity", F.col("new").alias("label")))
        release(jumped)


def close(one: str, other: str) -> Column:
    """Whether sizes and fixed-size sketches of two sides leave the similarity possible."""
    n, m = F.col(f"{one}.n"), F.col(f"{other}.n")
    apart = sum((F.bit_count(F.col(f"{one}.s{i}").bitwiseXOR(F.col(f"{other}.s{i}"))) for i in range(LANES)), F.lit(0))
    return ((100 * F.least(n, m) >= PERCENT * F.greatest(n, m))
            & ((100 + PERCENT) * apart <= (100 - PERCENT) * (n + m)))


def pairs_of(matched: DataFrame, one: str, other: str) -> DataFrame:
    x, y = F.col(f"{one}.entity"), F.col(f"{other}.entity")
    return matched.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def open_members(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, entity, label) of the keys whose entities are not all in one component yet."""
    if labels is None:
        labelled = members.withColumn("label", F.col("entity"))
    else:
        labelled = members.join(labels.withColumnRenamed("entity", "_entity"), F.col("entity") == F.col("_entity"), "left").select(
            "key", "entity", F.coalesce("label", "entity").alias("label"))
    several = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
    return durable(labelled.join(several, "key"))


def star_pairs(members: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b) of entities with a hub of their keys, one pair for an entity and component.

    Hubs are the first of their keys in one order over all entities. So the keys of a group
    of near copies mostly have the same hub, and the pairs grow with the group's size.
    """
    order = F.struct(F.xxhash64("entity", F.lit(seed)).alias("order"), F.col("entity").alias("hub"), F.col("label").alias("of"))
    hubs = members.groupBy("key").agg(F.min(order).alias("first")).select("key", "first.hub", "first.of")
    met = members.join(hubs, "key").filter("label <> of").groupBy("entity", "of").agg(F.min("hub").alias("hub"))
    return met.select(F.least("entity", "hub").alias("a"), F.greatest("entity", "hub").alias("b")).distinct()


def links(rows: DataFrame, frequent, docs: DataFrame) -> DataFrame:
    """Verified pairs (a, b) of entities that connect all that link.

    First, in a few rounds, each entity is compared with one member of each of its keys that it
    is not connected with yet. Members are drawn in one order over all entities, another
    in each round, so that the cost grows with a group's size and not with its square.
    Then the entities of one key are compared that these links have not brought together, but for
    those both in the component that most of the key's entities are in. All comparisons start
    with sketches, the last ones inside the join; pairs come out only where the similarity is still
    possible.
    """
    context = rows.sparkSession.sparkContext
    keys = durable(shared_keys(rows.select("text"), frequent))
    keys_filter = context.broadcast(bit_filter(keys))
    release(keys)
    candidates = read_candidates(rows.select("text"), frequent, keys_filter)
    members = durable(candidates.select(F.explode("keys").alias("key"), "entity"))
    found = tested = labels = None
    for seed in range(ROUNDS):
        unconnected = open_members(members, labels)
        release(members)  # keys that are closed now stay closed
        members = unconnected.drop("label")
        pairs = durable(star_pairs(unconnected, seed))
        new = verified(sketched(pairs, candidates), rows, docs)
        found, tested = (new, pairs) if found is None else (found.union(new), tested.union(pairs))
        labels = components(found)

    unconnected = open_members(members, labels)
    sizes = unconnected.groupBy("key", "label").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max(F.struct("size", "label")).alias("main")).select("key", F.col("main.label").alias("main"))
    lanes = candidates.select(F.col("entity").alias("_entity"), "n", *[F.get("lanes", F.lit(i)).alias(f"s{i}") for i in range(LANES)])
    sides = durable(unconnected.join(main, "key").join(lanes, F.col("entity") == F.col("_entity")).drop("_entity"))
    x, y = sides.filter("label <> main").alias("x"), sides.alias("y")
    # Of two outside the main component one order is enough.
    once = (F.col("y.label") == F.col("x.main")) | (F.col("x.entity") < F.col("y.entity"))
    apart = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & once & close("x", "y"))
    rest = durable(pairs_of(apart, "x", "y").join(tested, ["a", "b"], "left_anti"))
    last = verified(sketched(rest, candidates), rows, docs)
    release(candidates, members, unconnected, sides, rest)
    return found.union(last)


def with_components(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) of each row of ``df``.

    ``mark`` is the hash of the text. A null text, or one without words, has an empty set and
    is its own component. Equal sets, repeated rows among them, are one entity and always
    linked. The component's id is the smallest id in it; ids may be of any type that has an order,
    and may be null, and then count only where there is no other. Very long texts are read whole. An
    empty table stays empty. Other columns are left out, whatever they are called.

    Sets and n-grams are known by hashes of 64 bits, so among some billions of different texts
    two that have nothing in common may be taken for equal.
    """
    rows = df.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    entities = read_entities(rows)
    counters = entities.filter("place is not null").select("place", "part", "data")
    frequent = df.sparkSession.sparkContext.broadcast(frequent_buckets(merged_counts(durable(counters))))
    docs = entities.filter("place is null").select("id", "mark", "n", "entity")
    found = links(rows.select("mark", "text"), frequent, docs.select("mark", "entity"))
    labels = components(found).select(F.col("entity").alias("_entity"), "label")
    grouped = durable(docs.join(labels, F.col("entity") == F.col("_entity"), "left").select(
        "id", "mark", "n", F.coalesce("label", "entity").alias("component")))
    # Stored, so that adaptive execution may split the rows of a large component in the join.
    least = durable(grouped.filter("component is not null").groupBy("component").agg(F.min("id").alias("least")))
    return grouped.join(least, "component", "left").select(
        F.col("id").alias(doc_id), "mark", F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each component, that of the smallest id, with the columns of ``df``.

    Of rows that are equal in id and text one stays; rows without words all stay.
    """
    found = with_components(df, text, doc_id)
    id_, mark = free_name(df, "kept_id"), free_name(df, "kept_mark")
    words = found.filter("n_shingles > 0").groupBy("component_id").agg(
        F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id).alias("id"), F.col("mark"))).alias("least"))
    kept = words.select(F.col("least.id").alias(id_), F.col("least.mark").alias(mark)).join(
        found.select(F.col(doc_id).alias("_id"), F.col("mark").alias("_mark")),
        F.col(id_).eqNullSafe(F.col("_id")) & (F.col(mark) == F.col("_mark"))).groupBy(id_, mark).agg(F.count("*").alias("_rows"))
    none = found.filter("n_shingles = 0").select(F.col(doc_id).alias(id_), F.col("mark").alias(mark)).distinct()
    wanted = durable(kept.unionByName(none.withColumn("_rows", F.lit(1).cast("bigint"))))
    joined = df.join(wanted, F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(mark)))
    single = joined.filter("_rows = 1").select(*named(df))
    repeated = joined.filter("_rows > 1").dropDuplicates([id_, mark]).select(*named(df))
    return single.unionByName(repeated)
