"""URL filters: host and path rules first, gradient-boosted trees for what they leave.

The URLs that the rules decide are the labelled ones. Block rates of suffixes are counted on
all of them; trees are grown on these and lexical features of a bounded number of them, and
judge every URL that no rule fits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fingerspark.llm.texts import LOWER, UPPER, bounded_ids, named
from fingerspark.sources.tables import durable

#: Labelled URLs that trees are grown on at most, of each verdict.
TRAINING = 10_000
TREES, DEPTH, SEED = 20, 4, 11
#: Rules in one list at most; each is an expression of the plan.
MOST_RULES = 1_000
#: Labelled URLs that a suffix must have besides before its own block rate prevails.
PRIOR = 10.0
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "symbol_ratio",
            "entropy", "parameters", "longest_run", "has_fragment", "is_secure", "top_rate", "domain_rate",
            "segment_rate")


@dataclass(frozen=True)
class Rule:
    """``verdict`` on a host with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to a slash, question mark, hash or the end."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """Struct of text and verdict of the longest rule that fits; null for none."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    found = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):   # the longest is asked first
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits of a character, from the counts of the different characters."""
    n = F.length(text)
    bits = F.aggregate(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0), lambda total, c: total + (
        (n - F.length(F.replace(text, c, F.lit("")))) * F.log2((n - F.length(F.replace(text, c, F.lit("")))).cast("double"))))
    return F.when(n > 0, F.log2(n.cast("double")) - bits / n).otherwise(0.0)


def with_lexical(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """Add the features that a URL has by itself, and the suffixes that statistics are kept of."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    n = F.greatest(F.length(u), F.lit(1))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    runs = F.regexp_extract_all(u, F.lit("[A-Za-z]+"), F.lit(0))
    return df.withColumns({
        "url_length": F.length(u).cast("double"), "host_length": F.length(h).cast("double"),
        "path_length": F.length(p).cast("double"), "depth": F.regexp_count(p, F.lit("/")).cast("double"),
        "host_labels": F.size(F.split(h, r"\.")).cast("double"),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / n,
        "symbol_ratio": F.regexp_count(u, F.lit("[^A-Za-z0-9/.:]")) / n,
        "entropy": entropy(u),
        "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1).cast("double"),
        "longest_run": F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("double"),
        "has_fragment": F.contains(u, F.lit("#")).cast("double"),
        "is_secure": u.startswith("https://").cast("double"),
        "_top": F.substring_index(h, ".", -1), "_domain": F.substring_index(h, ".", -2),
        "_segment": F.concat(F.substring_index(h, ".", -1), F.regexp_extract(p, r"^(/[^/]*)", 1)),
    })


SUFFIXES = {"top_rate": "_top", "domain_rate": "_domain", "segment_rate": "_segment"}


@dataclass(frozen=True)
class Model:
    trees: GBTClassificationModel
    rates: dict[str, DataFrame]
    share: float


def with_rates(df: DataFrame, rates: dict[str, DataFrame], share: float) -> DataFrame:
    """Add the block rates of the suffixes; one that no labelled URL has gets the overall rate."""
    for name, key in SUFFIXES.items():
        rate = rates[name].withColumnsRenamed({key: f"{key}_known"})
        df = df.join(rate, F.col(key) == F.col(f"{key}_known"), "left").drop(f"{key}_known")
    return df.fillna(share, subset=list(SUFFIXES))


def train(labelled: DataFrame, url: str = "url", host: str = "host", path: str = "path",
          label: str = "blocked") -> Model | float:
    """Grow the trees on at most ``TRAINING`` different URLs of each label (1.0 for block).

    The block rates of the suffixes and the overall share are counted on all different
    labelled URLs; in the trees, those drawn stand for all of their label by weight. Where
    all labelled URLs have one label, or there are none, it is the share of blocked ones
    that is returned; then nothing can be learned.
    """
    unique = labelled.select(url, host, path, label).dropna(subset=[url])
    counted = durable(with_lexical(unique.distinct(), url, host, path).groupBy(*SUFFIXES.values(), label).agg(
        F.count("*").alias("n")))
    totals = {r[label]: r["n"] for r in counted.groupBy(label).agg(F.sum("n").alias("n")).collect()}
    blocked, total = totals.get(1.0, 0), sum(totals.values())
    if blocked in (0, total):
        return blocked / total if total else 0.0
    share = blocked / total
    rates = {name: durable(counted.groupBy(key).agg(
        ((F.sum(F.col(label) * F.col("n")) + PRIOR * share) / (F.sum("n") + PRIOR)).alias(name)))
        for name, key in SUFFIXES.items()}
    picked = [bounded_ids(unique.filter(F.col(label) == v), TRAINING, f"url{v:.0f}").withColumn(
        "weight", F.lit(totals[v] / min(totals[v], TRAINING))) for v in (0.0, 1.0)]
    sample = with_lexical(durable(picked[0].unionByName(picked[1])), url, host, path)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_rates(sample, rates, share))
    booster = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=TREES, maxDepth=DEPTH,
                            stepSize=0.3, seed=SEED)
    return Model(booster.fit(ready.select("features", label, "weight").orderBy(F.xxhash64("features"))), rates, share)


def judged(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """Host, path, rule, verdict and block probability of every URL, besides its columns.

    A null URL, or one without ``://``, has an empty host and path; no rule fits it, and the
    trees judge it by its other features. Of equally long rules that fit, the one last in order of text
    decides; URLs of any length are read whole. Where the rules decide no URL, or all alike, the
    rest gets what they mostly said, allow by default. Repeated rows are judged alike; an
    empty table stays empty. Input columns called like the new ones are replaced; ``keep``
    names the columns to pass on, all by default.
    """
    made = ("host", "path", "rule", "verdict", "block_probability")
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in made]
    read = df.select(F.struct(*named(df, kept)).alias("_row"), F.col(url).alias("_url"),
                     host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    read = read.withColumn("_rule", fitting(rules, F.col("host"), F.col("path")))
    labelled = read.filter(F.col("_rule").isNotNull()).select(
        "_url", "host", "path", (F.col("_rule.verdict") == "block").cast("double").alias("blocked"))
    model = train(labelled, "_url")
    if isinstance(model, float):
        out = read.withColumn("block_probability", F.lit(model))
    else:
        rated = with_rates(with_lexical(read, "_url", "host", "path"), model.rates, model.share)
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rated)
        scored = model.trees.setFeaturesCol("features").transform(ready)
        probability = F.get(vector_to_array(F.col("probability")), F.lit(1))
        out = scored.withColumn("block_probability", probability)
    learned = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], "host", "path", F.col("_rule.text").alias("rule"),
                      F.coalesce("_rule.verdict", learned).alias("verdict"), "block_probability")
