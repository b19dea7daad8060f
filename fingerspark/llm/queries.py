"""The registered queries ``opN_<name>`` and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerspark.llm import compression, decontamination, jaccard, licences, mixing, repair, rules, secrets, tokens, toxicity, trie, urls, warc
from fingerspark.llm.texts import LOWER, SPACES, TOKEN, UPPER, WORD, held_out, table

#: A-Z to a-z in DuckDB.
_LOWER = f"translate({{}}, '{UPPER}', '{LOWER}')"

# Scores from which a label is predicted.
GOOD_FROM = 0.3
TOXIC_FROM = 0.5
#: The tokenizer of the token counts, and tokens above which a text is too long.
TOKENIZER = "byte_bpe_50k.json"
MOST_TOKENS = 512


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents labelled as good."""
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.with_mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mix.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(~held_out()))
    scored = toxicity.with_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "toxicity.score",
                         (F.col("toxicity.score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.find_licences(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "licences.*").drop("spans")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.with_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), keep=["page_id"]).select(
        "page_id", "host", "path", "rule", "verdict")


def op6_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = compression.train(docs, labels.filter(~held_out()))
    scored = compression.with_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "quality.score",
                         (F.col("quality.score") >= GOOD_FROM).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                          keep=["doc_id"])
    return hits.select("doc_id", "hits.n_words", decontamination.hit_words().alias("n_hit"),
                       F.size("hits.items").cast("long").alias("n_items"),
                       decontamination.items_digest().alias("items_sha256"),
                       decontamination.contaminated().alias("contaminated"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", *[f"secrets.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = rules.with_rules(table(spark, sf_dir, "documents"), trusted_documents(spark, sf_dir), keep=["doc_id"])
    return ruled.select("doc_id", "rules.*")


def op11_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = tokenizer or public_tokenizers.path(TOKENIZER)
    counted = tokens.with_token_counts(table(spark, sf_dir, "documents"), path, keep=["doc_id"])
    return counted.select("doc_id", "tokens.*", (F.col("tokens.n_tokens") > MOST_TOKENS).alias("over_limit"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_beginnings(table(spark, sf_dir, "conversations"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_toxicity, op3_licences, op4_jaccard, op5_urls, op6_compression, op7_decontamination, op8_warc,
    op9_secrets, op10_rules, op11_tokens, op12_trie, op13_repair)}
#: The table of CRC-32 in DuckDB, as a row of a table called steps, and the checksum of an ASCII text by it.
_STEPS = """steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
                      CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crcs)"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                      lambda c, k: xor(c >> 8, crcs[(xor(c, k) & 255) + 1])), 4294967295)"""

CHECKS: dict[str, str] = {
    "op4_jaccard": rf"""
        WITH RECURSIVE doc AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{WORD}') AS words FROM documents),
        sets AS (
            SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words]
                       ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4])) END AS grams
            FROM doc),
        sized AS (SELECT r, doc_id, len(grams) AS n FROM sets),
        each AS (SELECT r, unnest(grams) AS gram FROM sets),
        shared AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM each a JOIN each b USING (gram) WHERE a.r <> b.r GROUP BY 1, 2),
        link AS (SELECT x, y FROM shared JOIN sized p ON p.r = x JOIN sized q ON q.r = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
        reach AS (SELECT r AS x, r AS y FROM sized UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
        SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
        FROM sized s JOIN reach ON reach.x = s.r JOIN sized t ON t.r = reach.y GROUP BY s.r, s.doc_id, s.n""",
    "op7_decontamination": rf"""
        WITH doc AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all({_LOWER.format('text')}, '{TOKEN}') AS words FROM documents),
        item AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
                   regexp_extract_all({_LOWER.format('text')}, '{TOKEN}') AS words FROM benchmark),
        pattern AS (
            SELECT DISTINCT item, words[i:i + least(len(words), 13) - 1] AS gram
            FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 13, 0) + 2)) AS i
                  FROM item WHERE len(words) > 0)),
        placed AS (
            SELECT r, size, i, words[i:i + size - 1] AS gram
            FROM (SELECT r, words, size, unnest(range(1, greatest(len(words) - size + 2, 1))) AS i
                  FROM doc, (SELECT DISTINCT len(gram) AS size FROM pattern) WHERE len(words) >= size)),
        found AS (SELECT r, size, i, item FROM placed JOIN pattern USING (gram)),
        hit AS (SELECT r, count(DISTINCT place) AS n_hit
                FROM (SELECT r, unnest(range(i, i + size)) AS place FROM found) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
                  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
        SELECT doc_id, CAST(coalesce(len(words), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
        o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN
                  max(page_id) OVER (PARTITION BY payload_digest) END AS owner FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id IS DISTINCT FROM owner AND owner IS NOT NULL THEN 'revisit'
                    ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to
        FROM o""",
    "op10_rules": rf"""
        WITH doc AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
                   doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS trusted FROM documents),
        placed AS (SELECT r, trusted, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM doc),
        steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
                      CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crcs),
        bytes AS (SELECT word, crcs, list_transform(range(0, length(hex(word)) // 2), lambda i:
                      CAST(concat('0x', substr(hex(word), CAST(2 * i + 1 AS INT), 2)) AS BIGINT)) AS b
                  FROM (SELECT DISTINCT word FROM placed), steps),
        hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, k:
                       xor(c >> 8, crcs[(xor(c, k) & 255) + 1])), 4294967295) AS crc FROM bytes),
        crc AS (SELECT r, trusted, crc, lead(crc) OVER (PARTITION BY r ORDER BY i) AS after
                FROM placed JOIN hashed USING (word)),
        grams AS (SELECT r, trusted, crc % {rules.BUCKETS} AS bucket FROM crc
                  UNION ALL SELECT r, trusted, (crc * {rules.PAIR_FACTOR} + after) % {rules.BUCKETS} FROM crc WHERE after IS NOT NULL),
        counts AS (SELECT bucket, count(*) AS raw, count(*) FILTER (trusted) AS target FROM grams GROUP BY 1),
        total AS (SELECT sum(raw) AS raws, sum(target) AS targets FROM counts),
        ratio AS (SELECT bucket, CAST(floor(ln((target + 16e0) / (CAST(raw * targets AS DOUBLE) / CAST(raws AS DOUBLE) + 16e0))
                      * 65536e0 + 0.5e0) AS BIGINT) AS part FROM counts, total),
        scored AS (SELECT r, CAST(sum(part) AS DOUBLE) / (count(*) * 65536e0) AS mean FROM grams JOIN ratio USING (bucket) GROUP BY r),
        windows AS (SELECT r, i, words[i:i + 4] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM doc)),
        again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
        repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again) GROUP BY r),
        counted AS (
            SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                   CAST(len(regexp_extract_all(text, '{rules.SYMBOLS}')) AS BIGINT) AS n_symbols,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACES}]')) AS lines,
                   coalesce(n, 0) AS n_repeat_words, coalesce(mean, 0e0) AS log_ratio
            FROM doc LEFT JOIN repeated USING (r) LEFT JOIN scored USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
               n_repeat_words, log_ratio, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND log_ratio >= -0.125e0 AS kept
        FROM counted""",
    "op12_trie": f"""
        WITH {_STEPS},
        turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                  WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS said
                FROM turns GROUP BY conv_id),
        shared AS (SELECT conv_id, said, {_CRC.format("CAST(conv_id AS VARCHAR)")} % {trie.SHARED} AS h FROM own, steps),
        again AS (SELECT a.conv_id, list_concat(coalesce(b.said, [])[1:h], a.said[h + 1:]) AS said
                  FROM shared a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % {trie.HUNDRED}),
        prefix AS (SELECT conv_id, depth, said[1:depth] AS path, len(said) = depth AS ends
                   FROM (SELECT *, unnest(range(len(said) + 1)) AS depth FROM again)),
        node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS listed
                 FROM prefix GROUP BY path, depth),
        child AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
        tree AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (path)),
        part AS (SELECT path[1:k] AS path, leaf, saved
                 FROM (SELECT path, CAST(n_children = 0 AS INT) AS leaf, (n_convs - 1) * coalesce(length(path[-1].text), 0) AS saved,
                              unnest(range(depth + 1)) AS k FROM tree)),
        total AS (SELECT path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM part GROUP BY path)
        SELECT tree.conv_id, tree.depth, up.conv_id AS parent_conv_id, tree.n_convs, tree.n_children,
               CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(tree.listed) AS ends_sha256
        FROM tree JOIN total USING (path)
        LEFT JOIN node up ON tree.depth > 0 AND up.path = tree.path[1:tree.depth - 1]""",
    "op13_repair": rf"""
        WITH RECURSIVE {_STEPS},
        raw AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(CAST(turn AS VARCHAR), ' ') AS said,
                       coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
        kinds AS (SELECT *, {_CRC.format("concat(conv, ':', said)")} % {repair.KINDS} AS kind FROM raw, steps),
        damaged AS (SELECT conv, turn, role AS was, text AS wrote, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy,
                           CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
                    FROM kinds WHERE kind <> 0),
        placed AS (SELECT conv, turn, role, text, left(role, 1) AS initial,
                          row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, was, wrote, copy) AS i FROM damaged),
        faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{SPACES}]') THEN 'blank'
                                  WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
                                  WHEN NOT regexp_matches(text, '[.!?][{SPACES}]*$') THEN 'truncated' END AS fault,
                          lag(initial) OVER (PARTITION BY conv ORDER BY i) AS before FROM placed),
        step(state, initial, after, called) AS (VALUES (0, 's', 1, ''), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'),
                                                       (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
        gain(state, letters, more, after, lines) AS (
            SELECT state, '', 0, state, CAST([] AS VARCHAR[]) FROM (VALUES (0), (1), (2), (3)) t(state)
            UNION ALL SELECT state, 'I', 5, after, [called || ':'] FROM step WHERE called <> ''
            UNION ALL SELECT x.state, 'II', 10, y.after, [x.called || ':', y.called || ':']
                      FROM step x JOIN step y ON x.after = y.state WHERE x.called <> '' AND y.called <> ''),
        edit AS (
            SELECT conv, i, state, state AS after, 'D' AS letter, 2 AS cost, CAST([] AS VARCHAR[]) AS lines
            FROM faults, (SELECT DISTINCT state FROM gain)
            UNION ALL SELECT conv, i, state, after, 'K', CASE WHEN fault IS NULL THEN 0 ELSE 5 END, [role || ':' || text]
            FROM faults JOIN step USING (initial) WHERE fault IS NULL OR fault = 'truncated'
            UNION ALL SELECT conv, i, state, after, 'R', CASE WHEN fault IS NULL THEN 1 ELSE 6 END, [called || ':' || text]
            FROM faults, step WHERE called <> '' AND (fault IS NULL OR fault = 'truncated')),
        way AS (
            SELECT DISTINCT conv, CAST(0 AS BIGINT) AS i, 0 AS state,
                   {{'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS best FROM faults
            UNION ALL
            SELECT w.conv, e.i, e.after, min({{'cost': w.best.cost + g.more + e.cost, 'audit': w.best.audit || g.letters || e.letter,
                                              'lines': list_concat(w.best.lines, g.lines, e.lines)}})
            FROM way w JOIN gain g USING (state) JOIN edit e ON e.conv = w.conv AND e.i = w.i + 1 AND e.state = g.after
            GROUP BY w.conv, e.i, e.after),
        found AS (
            SELECT conv, min({{'cost': w.best.cost + g.more, 'audit': w.best.audit || g.letters,
                              'lines': list_concat(w.best.lines, g.lines)}}) AS best
            FROM way w JOIN gain g USING (state) JOIN (SELECT conv, max(i) AS i FROM faults GROUP BY conv) USING (conv, i)
            WHERE g.after IN (0, 3) GROUP BY conv),
        counted AS (
            SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faults GROUP BY conv)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
               coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, conv FROM raw) LEFT JOIN counted USING (conv) LEFT JOIN found USING (conv)""",
}
