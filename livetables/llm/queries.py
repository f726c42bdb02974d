"""Queries over the given tables, one per operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livetables.llm import (decontamination, dual_tree_search, license_scan, mixing, near_dedup, pii, quality_classifier, quality_rules,
                            repeated_passages, source_divergence, substring_dedup, toxicity, url_filter)
from livetables.llm.base import held_out, ready, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ready(spark), sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NEAR_SQL = fr"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '{SPACED}') AS w FROM documents),
    grams AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
        FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    links AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
        JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
    reach AS (
        SELECT doc_id AS a, doc_id AS b FROM documents
        UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


@query("op1_near_dedup", NEAR_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf, "documents"), shingle=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


DECONTAMINATION_SQL = fr"""
    WITH dw AS (SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM documents),
    bw AS (SELECT item_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
        FROM bw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
    places AS (
        SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
        FROM dw, (SELECT DISTINCT m FROM windows) s, unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m),
    found AS (SELECT doc_id, item_id, i, p.m FROM places p JOIN windows USING (m, g)),
    hits AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(0, m)) AS t(j) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op2_decontamination", DECONTAMINATION_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    hits = decontamination.find_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"), window=13)
    return hits.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
                       decontamination.contaminated().alias("contaminated"))


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return _scored(quality_classifier.score(docs, quality_classifier.learn(docs, table(spark, sf, "labels"))), 0.5)


@query("op5_toxicity")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return _scored(toxicity.score(docs, toxicity.learn(docs, table(spark, sf, "labels"))), toxicity.THRESHOLD)


URL_SQL = r"""
    WITH split AS (
        SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (
        SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM split),
    rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS r(action, h, p)),
    best AS (
        SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
        FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
    SELECT page_id, host, path, rule,
           coalesce(action, CASE WHEN regexp_matches(host, 'spam|adult|bets|casino') AND (path = '' OR starts_with(path, '/')) THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts LEFT JOIN best USING (page_id)"""


@query("op4_url_filter", URL_SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"))


@query("op6_pii")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(table(spark, sf, "documents"))
    every = F.array_distinct(F.concat("spans", "added"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, pii.KINDS), F.sha2(pii.spans_text(F.col("spans")), 256).alias("base_sha256"), pii.spans_text(every).alias("spans"))


@query("op7_repeated_passages")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    rows, cut = repeated_passages.cut_texts(table(spark, sf, "documents"), length=200)
    digests = cut.select("t1", "t2", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return rows.join(digests, ["t1", "t2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


MIXING_SQL = fr"""
    WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS BIGINT) AS size FROM documents),
    sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sized GROUP BY source),
    weighted AS (SELECT *, CAST(1 + turn % 3 AS BIGINT) AS weight FROM sums),
    -- sources in the order in which they fill up; before: what those before it give at most
    filled AS (
        SELECT *, CAST(coalesce(sum(3 * source_size) OVER w, 0) AS BIGINT) AS before, CAST(coalesce(sum(weight) OVER w, 0) AS BIGINT) AS weight_before,
               CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights
        FROM weighted WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (
        SELECT total - before AS rest, weights - weight_before AS weight_left FROM filled
        WHERE weight * (total - before) <= 3 * source_size * (weights - weight_before) ORDER BY weight_before LIMIT 1),
    targets AS (
        SELECT source, source_size, CASE WHEN weight * rest > 3 * source_size * weight_left THEN CAST(3 * source_size AS DOUBLE)
                                         ELSE CAST(weight * rest AS DOUBLE) / CAST(weight_left AS DOUBLE) END AS target FROM weighted, level),
    placed AS (
        SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS quota,
               CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                    AS BIGINT) AS before
        FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST(least(greatest(quota - before, 0), size) + least(greatest(quota - before - source_size, 0), size)
                + least(greatest(quota - before - 2 * source_size, 0), size) AS BIGINT) AS taken
    FROM placed"""


@query("op8_mixing", MIXING_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.allocate(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_license_scan")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.licences(table(spark, sf, "documents"))


RULES_SQL = fr"""
    WITH words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
    grams AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM words, unnest(range(1, len(w) - 1)) AS t(i) WHERE len(w) >= 3),
    again AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
    repeats AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM grams JOIN again USING (doc_id, g), unnest(range(0, 3)) AS t(j) GROUP BY doc_id),
    lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
              FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '{SPACED}') GROUP BY doc_id),
    measured AS (
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
               CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines,
               coalesce(l.n, 0) AS n_lines, coalesce(r.n, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
               length(text) - length(regexp_replace(text, '!', '', 'g')) AS n_bangs
        FROM words LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
    judged AS (
        SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                       + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
                       + CASE WHEN 100 * n_upper > 40 * word_chars THEN 16 ELSE 0 END + CASE WHEN 10 * n_bangs > 5 * n_words THEN 32 ELSE 0 END
                       + CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 128 ELSE 0 END AS BIGINT) AS failures FROM measured)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures % 4 > 0 AS base_failed, failures, failures % 8 = 0 AS kept_v1, failures = 0 AS kept
    FROM judged"""


@query("op10_quality_rules", RULES_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger's mask, and the verdicts of every version of the policy from it."""
    entries = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf, "documents")), "v2")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.failed("base").alias("base_failed"), "failures",
                          (~quality_rules.failed("v1")).alias("kept_v1"), "kept")


SEARCH_SQL = fr"""
    WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM documents),
    sized AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
    totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sized),
    tfs AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
    wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '{ALNUM}')) AS term FROM benchmark),
    dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
    weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM dfs, totals),
    scored AS (
        SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) AS BIGINT) AS score
        FROM wanted JOIN tfs USING (term) JOIN weights USING (term) JOIN sized USING (doc_id), totals GROUP BY item_id, doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""


@query("op11_ranked_search", SEARCH_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return dual_tree_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)


DIVERGENCE_SQL = fr"""
    WITH d AS (
        SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    occurrences AS (SELECT doc_id, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term, CAST(count(*) AS BIGINT) AS total FROM occurrences GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
    cells AS (SELECT lang, source, term, CAST(count(*) AS BIGINT) AS n FROM occurrences JOIN kept USING (lang, term) GROUP BY lang, source, term),
    groups_ AS (SELECT DISTINCT lang, source FROM d),
    langs AS (SELECT lang, CAST(count(*) AS BIGINT) AS v, CAST(sum(total) AS BIGINT) AS n_lang FROM kept GROUP BY lang),
    sums AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n_group FROM cells GROUP BY lang, source),
    grid AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(s.n_group, 0) + 2 * l.v) AS p,
               1 + (1000000000 * (k.total + 2)) // (l.n_lang + 2 * l.v) AS q
        FROM groups_ g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
        LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    sums_of_pairs AS (
        SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
        FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
    pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
        FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums_of_pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM grid WHERE n > 0 AND p > q),
    ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf, "documents"))


SUBSTRING_SQL = fr"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
    starts AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM d, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
    smallest AS (SELECT g, min(doc_id) AS least FROM starts GROUP BY g),
    gone AS (SELECT DISTINCT doc_id, i + j AS i FROM starts JOIN smallest USING (g), unnest(range(0, 50)) AS t(j) WHERE doc_id > least),
    words AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
    removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""


@query("op13_substring_dedup", SUBSTRING_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf, "documents"), window=50)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
