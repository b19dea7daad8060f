"""Quality rules, with DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated five-word windows. The verdict
on what passes them is a log-likelihood ratio: words and word pairs are hashed into buckets,
bucket frequencies of trusted documents and of the whole corpus make two multinomials, and
a document's mean log ratio over all its n-grams is held against a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fingerspark.llm.texts import SPACES, free_name, named
from fingerspark.sources.tables import durable

# Limits and characters of the base rules.
LEAST_WORDS = 10
REPEAT_WINDOW = 5
MOST_REPEATED_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"

#: Buckets of n-grams; the table of log ratios has as many entries.
BUCKETS = 1 << 14
PAIR_FACTOR = 33
#: Bits of the filter of trusted ids, for each of them and in all (32 MB).
FILTER_BITS = 8
MOST_BITS = 1 << 28
#: Occurrences that the prior adds to a bucket's expected count on both sides of the ratio.
PRIOR = 16.0
#: Log ratios are held in so many parts of a nat, as integers, so that sums of them are
#: exact and each verdict is the same at every run.
PARTS = 1 << 16
#: A document whose mean log ratio is below this is rejected.
THRESHOLD = -0.125


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")


def with_base_counts(df: DataFrame, text: str, crc: str = "crc") -> DataFrame:
    """Add the base counts, and the CRC-32 of each word as array ``crc``.

    Every step is a column that later ones refer to, and arrays go as soon as they are used,
    so that nothing is computed twice and little is carried along.
    """
    t, w, size = F.coalesce(F.col(text), F.lit("")), F.col("_words"), REPEAT_WINDOW
    df = df.withColumn("_words", words_of(F.col(text))).withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACES}]")),
        "_hashes": F.transform(w, lambda x: F.xxhash64(x)),
        crc: F.transform(w, lambda x: F.crc32(x.cast("binary"))),
    }).drop("_words")
    h = F.col("_hashes")
    windows = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]))
    df = df.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.slice(windows, F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(0))),
    }).drop("_lines", "_hashes")
    # Equal windows stand side by side when sorted; most texts have none and skip this.
    df = df.withColumn("_placed", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_windows")
    placed = F.col("_placed")
    df = df.withColumn("_starts", F.sort_array(F.transform(
        F.filter(placed, lambda x, i: (x["h"] == F.get(placed, i - 1)["h"])
                 | (x["h"] == F.get(placed, i + 1)["h"])), lambda x: x["i"]))).drop("_placed")
    starts = F.col("_starts")
    # From one repeated window's start to the next, at most a window's words are covered.
    covered = F.transform(starts, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(starts, i + 1) - x, F.lit(size))))
    repeated = F.aggregate(covered, F.lit(0), lambda total, x: total + x)
    return df.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long")).drop("_starts")


def base_failed() -> Column:
    return ((F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def ngram_buckets(crc: str = "crc") -> Column:
    """The buckets of all words and of all pairs of neighbours, from the words' hashes."""
    c, mask = F.col(crc), F.lit(BUCKETS - 1)
    singles = F.transform(c, lambda x: x.bitwiseAND(mask))
    pairs = F.transform(c, lambda x, i: (x * PAIR_FACTOR + F.get(c, i + 1)).bitwiseAND(mask))
    return F.concat(singles, F.slice(pairs, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))))


def perhaps_among(df: DataFrame, column: str, ids: DataFrame, id_: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among the ids. None that is there is missed.

    The filter has about ``FILTER_BITS`` bits for each id and at most ``MOST_BITS`` in all, which bounds
    what is broadcast: with more ids it lets more rows through.
    """
    bits = min(MOST_BITS, max(1 << 15, FILTER_BITS * ids.count()))

    def placed(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(bits))

    bitmaps = ids.groupBy(F.bitmap_bucket_number(placed(id_)).alias("_number")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(placed(id_))).alias("_bitmap"))
    found = df.withColumns({"_of": F.bitmap_bucket_number(placed(column)), "_bit": F.bitmap_bit_position(placed(column))}).join(
        F.broadcast(bitmaps), F.col("_of") == F.col("_number"))
    byte = F.conv(F.hex(F.substring("_bitmap", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.filter(F.expr("shiftleft(1, int(_bit % 8))").bitwiseAND(byte) > 0).select(*named(df))


def bucket_counts(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Occurrences of each bucket in the whole corpus and in the trusted documents.

    All documents are counted in one scan without a join. Counts are combined before the shuffle, so
    what moves is at most one row for each bucket and task. For the trusted documents, a filter of their
    ids drops most others in the scan; what passes is joined with the ids, and moves its id
    and two bytes a word, which is all that buckets depend on.
    """
    kind = docs.select(F.col(doc_id)).schema[0].dataType  # hashes of equal ids differ between types
    ids = durable(trusted.select(F.col(doc_id).cast(kind).alias("_trusted")).dropna().distinct())

    def low(words: str) -> Column:
        return F.transform(words_of(F.col(words)), lambda w: F.crc32(w.cast("binary")).bitwiseAND(F.lit(BUCKETS - 1)).cast("smallint"))

    perhaps = perhaps_among(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_id", ids, "_trusted")
    known = perhaps.select("_id", low("_text").alias("crc")).join(ids, F.col("_id") == F.col("_trusted"), "left_semi")
    # The array is built inside explode: of a column, Spark would infer a filter on its size
    # and push that below the steps that make it, to compute them once more for each element.
    raw, target = (rows.select(F.explode(ngram_buckets()).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
                   for rows in (docs.select(low(text).alias("crc")), known))
    return raw.withColumnRenamed("n", "raw").join(target.withColumnRenamed("n", "target"), "bucket", "left").fillna(0, ["target"])


def log_ratios(counts: DataFrame) -> DataFrame:
    """One row with the array ``ratios``: each bucket's log ratio in whole parts of a nat.

    The ratio holds a bucket's count in the trusted documents against what the corpus lets
    one expect there. A bucket that was never seen has ratio 0.
    """
    stored = durable(counts)
    total = stored.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    expected = F.col("c.raw") * F.col("t.target") / F.col("t.raw")
    ratio = F.ln((F.col("c.target") + PRIOR) / (expected + PRIOR))
    seen = stored.alias("c").join(F.broadcast(total).alias("t")).select(
        "bucket", F.floor(ratio * PARTS + 0.5).alias("ratio"))
    every = stored.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    full = every.join(F.broadcast(seen), "bucket", "left").select(
        "bucket", F.coalesce("ratio", F.lit(0)).cast("int").alias("ratio"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))),
                                lambda x: x["ratio"]).alias("ratios"))


def with_rules(df: DataFrame, trusted: DataFrame, corpus: DataFrame | None = None, text: str = "text",
               doc_id: str = "doc_id", into: str = "rules", keep: list[str] | None = None) -> DataFrame:
    """Add struct ``into``: the base counts, ``base_failed``, the mean log ratio and ``kept``.

    ``trusted`` has the ids of the trusted documents; ``corpus`` (``df`` by default) is what
    the raw multinomial is counted on. A null or empty text has no words and fails the base
    rules. Without trusted documents all log ratios are 0 and the base rules decide alone.
    Repeated rows are counted and judged each; a trusted id stands for all rows that have it, a null
    id for none. Very long texts are read whole, as arrays of their words. A ratio at the threshold
    keeps. An empty table stays empty. ``keep`` names the columns to pass on, all by default; one
    called ``into`` is replaced.
    """
    ratios = log_ratios(bucket_counts(df if corpus is None else corpus, trusted, text, doc_id)).scalar()
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != into.lower()]
    held = df.select(F.struct(*named(df, kept)).alias("_row"), F.col(text).alias("_text"))
    counted = with_base_counts(held, "_text", "_crc").drop("_text")
    counted = counted.withColumn("_grams", ngram_buckets("_crc")).drop("_crc").withColumn("_ratios", ratios)
    table, grams = F.col("_ratios"), F.col("_grams")
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda a, b: a + F.get(table, b.cast("int")))
    mean = F.when(F.size(grams) > 0, total / (F.size(grams) * F.lit(float(PARTS)))).otherwise(0.0)
    judged = counted.withColumn("log_ratio", mean).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("log_ratio") >= THRESHOLD))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio",
              "base_failed", "kept")
    return judged.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept],
                         F.struct(*fields).alias(into))


def kept_by_rules(df: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that the rules keep, with their columns, whatever these are called.

    Null and empty texts have no words and go; repeated rows stay or go together; very long texts are
    judged whole; an empty table stays empty. Rows without an id are judged like others.
    """
    into = free_name(df, "rules")
    ruled = with_rules(df, trusted, None, text, doc_id, into)
    # A filter on a computed column is pushed below the steps that compute it and repeats
    # them for each element; it stops at a generator, here of one row.
    kept = free_name(df, "kept")
    return ruled.select(*named(df), F.explode(F.array(f"{into}.kept")).alias(kept)).filter(kept).select(*named(df))
