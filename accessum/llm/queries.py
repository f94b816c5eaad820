"""Queries over the driver's tables, one for each operator of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, divergence, exact_dedup, filter_audit, licenses, media, mixing, quality, sharding, simhash, substrings, token_counts, windows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return media.text_media(documents(spark, sf_dir)).select("doc_id", *facts, "position", "caption")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), token_counts.vocabulary_path())


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_scan(documents(spark, sf_dir)).drop("row_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), byte_bpe.vocabulary_path())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = windows.remove_repeated_windows(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_spans")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_mix_sources, op3_simhash_near_dedup, op4_balanced_shards, op5_token_counts, op6_repeated_substrings, op7_quality, op8_license_scan, op9_byte_bpe, op10_exact_dedup, op11_filter_audit, op12_repeated_windows, op13_source_divergence)}

ORACLES = {
    "op2_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS src,
                len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::BIGINT % 64 AS salt
            FROM documents),
        s AS (SELECT none, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
        w AS (SELECT *, 3 * source_size AS top, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY none, src) - 1) % 3 + 1] AS weight FROM s),
        a AS (
            SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(top) OVER (ORDER BY top / weight, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
                sum(weight) OVER (ORDER BY top / weight, none, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
            FROM w),
        l AS (SELECT rest, share FROM a WHERE rest / share <= top / weight ORDER BY top / weight, none, src LIMIT 1),
        t AS (SELECT none, src, source_size, least(top::DOUBLE, weight * l.rest / l.share) AS target FROM a, l),
        r AS (
            SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
                ('0x' || substr(md5('mix-1' || CASE WHEN none THEN '-' ELSE '+' || src END), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u,
                row_number() OVER (PARTITION BY none, src ORDER BY size, salt, doc_id NULLS FIRST) AS n
            FROM d JOIN t USING (none, src)),
        c AS (SELECT *, least(3, floor(each * n + u) - floor(each * (n - 1) + u))::BIGINT AS copies FROM r)
        SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
    """,
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
    "op11_filter_audit": r"""
        WITH w AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        c AS (SELECT text, min(doc_id) AS first FROM w GROUP BY text),
        l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
        d AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
                || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
                || CASE WHEN 100 * len(regexp_extract_all(w.text, '[A-Z]')) > 5 * length(w.text) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN coalesce(w.doc_id > c.first, false) THEN 'E' ELSE '' END AS failed
            FROM w JOIN c USING (text) LEFT JOIN l ON w.doc_id = l.doc_id),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (
            SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS before
            FROM o, (SELECT unnest(range(1, 6)) AS step)),
        g AS (SELECT part, failed, good, toxic, count(*) AS n FROM d GROUP BY ALL),
        r AS (
            SELECT g.*, s.*, contains(failed, filter) AS here, length(translate(failed, before, '')) < length(failed) AS earlier FROM g, s),
        t AS (
            SELECT part, filter_order, step, filter,
                coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0)::BIGINT AS kept,
                coalesce(sum(n) FILTER (here AND NOT earlier), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (here AND earlier), 0)::BIGINT AS redundant,
                coalesce(sum(n) FILTER (failed = filter), 0)::BIGINT AS unique_fails,
                coalesce(sum(n) FILTER (here AND NOT earlier AND good), 0)::BIGINT AS good_lost,
                coalesce(sum(n) FILTER (here AND NOT earlier AND toxic), 0)::BIGINT AS toxic_lost
            FROM r GROUP BY ALL)
        SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM t
    """,
    "op12_repeated_windows": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
        f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM s),
        g AS (
            SELECT doc_id, i, word, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
            FROM p LEFT JOIN f USING (doc_id, i)),
        r AS (
            SELECT doc_id, count(*) FILTER (gone) AS n_removed, sum((gone AND NOT before)::INT) AS n_spans, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept
            FROM (SELECT *, lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)
    """,
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) JOIN k USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
        gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
        ln AS (SELECT lang, sum(n)::HUGEINT AS n FROM gn GROUP BY lang),
        p AS (
            SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.n + 2 * v.v) AS p
            FROM gn JOIN k ON gn.lang = k.lang JOIN v ON v.lang = gn.lang
            LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
        q AS (
            SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (sum(c.n)::HUGEINT + 2)) // (ln.n + 2 * v.v) AS q
            FROM k JOIN c USING (lang, term) JOIN ln ON ln.lang = k.lang JOIN v ON v.lang = k.lang GROUP BY k.lang, k.term, ln.n, v.v),
        s AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
        r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT p.lang, p.source, 'term', p.term, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
        SELECT * FROM o WHERE part = 'pair' OR rank <= 10
    """,
}
