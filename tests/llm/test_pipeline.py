"""The pipeline, stage by stage, against brute force on a small corpus with planted cases."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fingerspark.llm import secrets
from fingerspark.llm.queries import QUERIES, op1_mixing
from fingerspark.sources.tables import durable

from .test_operators import DOCS, brute_components, brute_hits, expected_rules, prose, targets

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(21)
    rows = [(i, prose(draw, 70, 80), "en", f"s{i % 3}", 1) for i in range(90)]
    rows += [(200 + i, rows[i][1], "en", "s0", 1) for i in range(10)]                            # exact copies
    rows += [(300 + i, rows[i][1] + " end", "en", "s1", 1) for i in range(20, 30)]                # near copies
    rows += [(400 + i, f"{prose(draw, 40, 80)} {ITEM}", "en", "s2", 1) for i in range(5)]         # leaked test items
    rows += [(500, f"{prose(draw, 60, 80)} password = hunter2hunter2", "en", "s2", 1), (501, None, "en", "s0", None), (502, "", None, None, 0),
             (503, "again and again and again and " * 9, "en", "s0", 1), (None, prose(draw, 50, 80), "en", "s1", 1)]
    rows += [(600 + i, " ".join(f"w{draw.randrange(40)}&&&" for _ in range(70)), "en", "s0", 1) for i in range(24)]   # junk
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).withColumn("copies", F.lit("clash")).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(600, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_each_stage_does_its_work(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, folder))
        seen.append(docs.collect())
    columns = [*DOCS.names, "copies"]
    start, ruled, single, clean, safe, mix = seen
    assert all(list(r.asDict()) == columns for found in (ruled, single, clean, safe) for r in found)

    failed = {r[0] for r in rows if expected_rules(r[1])[-1]}
    assert {r.doc_id for r in start} - {r.doc_id for r in ruled} == failed | {600 + i for i in range(24)}

    least = {(d, n): c for d, n, c in brute_components([tuple(r) for r in ruled])}
    expected = {r.doc_id for r in ruled if least[r.doc_id, len_of(r.text)] == r.doc_id}
    assert Counter(r.doc_id for r in single) == Counter(expected)

    def leaked(text):
        n, hit, _ = brute_hits(text, [(1, ITEM), (2, None)])
        return hit > 0 and 20 * hit >= n
    assert {r.doc_id for r in clean} == {r.doc_id for r in single if not leaked(r.text)} and any(leaked(r.text) for r in single)

    before = {r.doc_id: r for r in clean}
    for r in safe:
        hidden = secrets.find(before[r.doc_id].text, "[secret]")[-1]
        assert r.text == (hidden or before[r.doc_id].text) and (hidden is None or r.n_chars == len(hidden))
    assert len(safe) == len(clean) and sum("[secret]" in r.text for r in safe) == 1

    sizes, taken = Counter(), Counter()
    for r in safe:
        sizes[r.source] += len(r.text.split())
    for r in mix:
        assert r.copies in (1, 2) and r.taken == r.copies * len(r.text.split())
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 71 for s, t in targets(sizes).items())


def len_of(text):
    from .test_operators import sets_of
    return len(sets_of(text))


def test_run_is_all_stages_and_repeats(spark, corpus):
    folder, _ = corpus
    first, again = (sorted(map(str, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert first == again and first


def test_an_empty_corpus_stays_empty(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    turns = "conv_id bigint, turn bigint, role string, text string"
    spark.createDataFrame([], turns).write.parquet(f"{tmp_path}/conversations.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in QUERIES.items():
        if name not in ("op5_urls", "op8_warc"):
            assert query(spark, str(tmp_path)).count() == 0, name


def test_mix_query_takes_whole_documents(spark, corpus):
    folder, rows = corpus
    got = op1_mixing(spark, folder).collect()
    assert len(got) == len(rows) and all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
