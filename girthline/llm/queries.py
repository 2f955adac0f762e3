"""Registered queries of the numbered operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girthline.llm import blocknames, clusters, containment, divergence, licenses, mixing, neardup, preference, quality, sharding, tokenfiles, toxicity, urls


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scanned(_table(spark, folder, "documents"))


def op2_byte_plane_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    found = tokenfiles.token_files(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(F.col("row_id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op3_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.judged(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    copies = mixing.mixed(_table(spark, folder, "documents"))
    return copies.select("doc_id", "source", "copy", "n_copies", F.round("rate", 9).alias("rate"), "mix_key", F.md5("text").alias("text_md5"))


def op5_toxicity_severity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.severities(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_benchmark_containment(spark: SparkSession, folder: str) -> DataFrame:
    return containment.contained_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_sampled_splitters(spark: SparkSession, folder: str) -> DataFrame:
    shards = sharding.sharded(_table(spark, folder, "documents"), 40)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return urls.judged(pages, urls.rule_table(pages))


def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return preference.preferences(*preference.swapped_replies(_table(spark, folder, "conversations")))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergences(_table(spark, folder, "documents"))


def op12_block_names(spark: SparkSession, folder: str) -> DataFrame:
    found = blocknames.exact_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_rotated_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.with_inertia(*clusters.clustered(_table(spark, folder, "embeddings")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_byte_plane_files, op3_quality_cascade, op4_poisson_mix, op5_toxicity_severity,
        op6_benchmark_containment, op7_sampled_splitters, op8_url_filter, op9_minhash_near_dedup, op10_preference_pairs,
        op11_source_divergence, op12_block_names, op13_rotated_clusters,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SET = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"



def _clusters_sql(rounds: int = 10) -> str:
    """Every round is a pair of CTEs: all distances to the centroids before, then their exact floored means."""
    nearest = "SELECT vec_id, min(struct_pack(d := d, k := k)) AS b FROM (SELECT vec_id, k, sum((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN {c} c USING (i) GROUP BY vec_id, k) GROUP BY vec_id"
    steps = [f"a{r} AS MATERIALIZED ({nearest.format(c=f'c{r}')})" if r == rounds else f"""a{r} AS MATERIALIZED ({nearest.format(c=f'c{r}')}),
        m{r} AS MATERIALIZED (SELECT b.k AS k, i, sum(x) AS s, count(*) AS n FROM e JOIN a{r} USING (vec_id) GROUP BY b.k, i),
        c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, CASE WHEN s IS NULL THEN c.x WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS x
              FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k AND c.i = m.i)""" for r in range(rounds + 1)]
    return f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
                   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        e AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(x) AS x FROM v),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM v),
        c0 AS MATERIALIZED (SELECT k, i, x FROM e JOIN f USING (vec_id) WHERE k < 8),
        {', '.join(steps)},
        h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
        SELECT vec_id, CAST(b.k AS INT) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(b.d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h ON h.k = b.k"""


_SPACE = "[\\x20\\x09-\\x0D]"

ORACLE = {
    "op3_quality_cascade": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
        h AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM g),
        r AS (SELECT doc_id, i FROM h JOIN (SELECT doc_id, g FROM h GROUP BY doc_id, g HAVING count(*) > 1) USING (doc_id, g)),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
        m AS (SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
                     len(list_distinct(string_split_regex(text, '{_SPACE}+'))) AS n_distinct,
                     length(regexp_replace(text, '\\P{{L}}', '', 'g')) AS n_letters
              FROM d LEFT JOIN c USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
                    OR 5 * n_symbols > n_words OR 20 * n_dup_lines > n_words OR 2 * n_letters < word_chars OR n_distinct < 10) AS kept
        FROM m""",
    "op10_preference_pairs": """
        WITH last AS (SELECT conv_id, max(turn) AS turn, min(turn) AS early, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
        o AS (SELECT conv_id, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS following FROM last),
        p AS (SELECT a.conv_id AS pair_id, a.turn AS last, a.early, a.conv_id % 3 AS kind, b.text AS other
              FROM last a JOIN o USING (conv_id) JOIN last b ON b.conv_id = o.following WHERE o.following <> a.conv_id),
        c AS (SELECT pair_id, turn, role, text, kind = 2 AND turn >= last AS gone,
                     CASE WHEN role = 'assistant' AND turn = CASE kind WHEN 0 THEN last WHEN 1 THEN early END THEN other ELSE text END AS bad
              FROM conversations JOIN p ON pair_id = conv_id),
        f AS (SELECT pair_id, min(turn) AS first FROM c WHERE gone OR text <> bad GROUP BY pair_id),
        a AS (SELECT pair_id, CASE WHEN turn >= first THEN 'chosen' ELSE 'prompt' END AS part, turn, role, text FROM c LEFT JOIN f USING (pair_id)
              UNION ALL SELECT pair_id, 'rejected', turn, role, bad FROM c JOIN f USING (pair_id) WHERE turn >= first AND NOT gone)
        SELECT pair_id, part, turn, 1 AS place, role, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS segment,
               part <> 'prompt' AND role = 'assistant' AS train FROM a""",
    "op8_url_filter": """
        WITH t AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        u AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM t),
        p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(h) + 1), '^/[^?#]*') AS path FROM u)
        SELECT page_id, host, path,
               CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
               CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'allow'
                    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'block'
                    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'block' ELSE 'allow' END AS verdict
        FROM p""",
    "op4_poisson_mix": """
        WITH s AS (SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS DOUBLE) AS b FROM documents GROUP BY source),
        w AS (SELECT source, b, CASE WHEN b > 0 THEN pow(b, 0.7) ELSE 0 END AS w FROM s),
        r AS (SELECT source, CASE WHEN w > 0 THEN w / (SELECT sum(w) FROM w) * (SELECT sum(b) FROM s) / b ELSE 0 END AS rate FROM w),
        p AS (SELECT source, rate, CAST(greatest(ceil(rate / 64), 1) AS INT) AS parts FROM r),
        m AS (SELECT *, rate / parts AS mu FROM p),
        k AS (SELECT source, k, CASE WHEN mu > 0 THEN exp(k * ln(mu) - mu - lgamma(k + 1)) WHEN k = 0 THEN 1.0 ELSE 0.0 END AS q
              FROM (SELECT source, mu, unnest(range(0, 171)) AS k FROM m)),
        f AS (SELECT source, sum(q) OVER (PARTITION BY source ORDER BY k) AS c FROM k),
        d AS (SELECT d.doc_id, d.source, md5(d.text) AS text_md5, m.rate, i,
                     CAST('0x' || substr(md5('mix-1|' || i || '|' || d.doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
              FROM documents d JOIN m USING (source), LATERAL (SELECT unnest(range(1, m.parts + 1)) AS i)),
        n AS (SELECT doc_id, d.source, text_md5, rate, count(f.c) AS n FROM d LEFT JOIN f ON f.source = d.source AND f.c < d.u
              GROUP BY doc_id, d.source, text_md5, rate),
        e AS (SELECT doc_id, source, text_md5, rate, n, unnest(range(1, n + 1)) AS c FROM n)
        SELECT doc_id, source, CAST(c AS INT) AS copy, CAST(n AS INT) AS n_copies, round(rate, 9) AS rate,
               CAST('0x' || substr(md5('mix-1|order|' || doc_id || '|' || c), 1, 15) AS BIGINT) AS mix_key, text_md5 FROM e""",
    "op6_benchmark_containment": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        ds AS (SELECT doc_id, unnest({_SET}) AS g FROM d),
        bs AS (SELECT item_id, {_SET} AS s FROM b),
        be AS (SELECT item_id, len(s) AS n_item, unnest(s) AS g FROM bs)
        SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
        FROM ds JOIN be USING (g) GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 80""",
    "op9_minhash_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, {_SET} AS s FROM d),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        pair AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id
                 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * 100 >= (a.n + b.n - count(*)) * 85),
        reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT pair.v, reach.r FROM reach JOIN pair ON reach.doc_id = pair.u),
        c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d),
        w AS (SELECT r, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM t),
        k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT DISTINCT lang, source FROM d),
        x AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, lang_n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        y AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM x),
        p AS (SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (total + 2 * v) AS p,
                     1 + CAST(1000000000 AS HUGEINT) * (lang_n + 2) // (lang_total + 2 * v) AS q FROM y JOIN l USING (lang)),
        s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER z AS INT) AS rank
        FROM o WINDOW z AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER z <= 10""",
    "op12_block_names": """
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS chars FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER best = 1 AS kept,
               sha256(t) AS text_sha256 FROM n WINDOW best AS (PARTITION BY t ORDER BY chars DESC, doc_id)""",
    "op13_rotated_clusters": _clusters_sql(),
}
