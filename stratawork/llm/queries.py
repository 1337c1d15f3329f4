"""One query for each operator of the package over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawork.llm import (
    decontaminate, html_extract, language_id, license_scan, minhash, mixing, prefix_trie, sharding, spelling, token_files, topk, toxicity,
    url_filter,
)
from stratawork.llm.text import read
from stratawork.session import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = dedent(sql).strip()
        return function

    return add


def tokenizer_file() -> str:
    """The vocabulary the token files are written with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, read(spark, sf_dir, "labels"))).drop("text_hash")


@query()
def op2_boosted_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_extract.main_texts(pages, html_extract.train(pages))


#: Fixed rules of the URL query: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query(
    r"""
    WITH rest AS (
        SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
    ), parts AS (
        SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
        FROM rest
    ), rules(rhost, rpath, rverdict) AS (
        VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
               ('net', '/es/', 'block'), ('net', '/fr/', 'block')
    ), fitting AS (
        SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
               max_by(rverdict, length(rhost || rpath)) AS rverdict
        FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        GROUP BY page_id
    )
    SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM parts LEFT JOIN fitting USING (page_id)
    """
)
def op3_bloom_cascade_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judged(read(spark, sf_dir, "pages"), rules)


@query()
def op4_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(read(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op5_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.languages(docs, language_id.train(docs))


@query()
def op6_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash")


@query()
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    token_files.write_tokens(read(spark, sf_dir, "documents"), folder, tokenizer_file(), end_id=1)
    return token_files.read_tokens(spark, folder)


@query(
    """
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
               ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496)
               / coalesce(0.5 + 0.5 * length(regexp_replace(text, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+', '', 'g'))
                          / greatest(length(text), 1), 0.5) AS key
        FROM documents
    ), sources AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
        FROM sized GROUP BY source
    ), levels AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER full_first, 0))::DOUBLE
                  / sum(weight) OVER rest_of AS level
        FROM sources
        WINDOW full_first AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               rest_of AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ), targets AS (
        SELECT *, least(3.0::DOUBLE * source_size, weight * (
            SELECT min_by(level, 3.0::DOUBLE * source_size / weight) FROM levels WHERE level <= 3.0::DOUBLE * source_size / weight
        )) AS target
        FROM levels
    ), chosen AS (
        SELECT d.doc_id, d.size, t.source_size, t.target,
               CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
               sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key DESC, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS started
        FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    ), counted AS (
        SELECT *, epochs + CASE WHEN target - epochs * source_size > 0
                                 AND started + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END AS copies
        FROM chosen
    )
    SELECT doc_id, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM counted
    """
)
def op8_efraimidis_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "copies", "taken"
    )


@query()
def op10_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("doc_key")


@query(
    """
    WITH clean AS (
        SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS ints
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.ints, c.ints)::BIGINT AS score
        FROM clean q JOIN clean c ON q.vec_id != c.vec_id
        WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM scored QUALIFY rank <= 10
    """
)
def op9_pivot_table_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def _crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII or UTF-8 text, bit by bit."""
    bits = f"bin({text})"
    register = "CASE WHEN xor(r, b) & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END"
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [substr({bits}, 8 * (i // 8) + 8 - i % 8, 1)::BIGINT"
        f" FOR i IN range(length({bits}))]), lambda r, b: {register}))"
    )


@query(
    f"""
    WITH RECURSIVE runs AS (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM documents
    ), counted AS (
        SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL HAVING length(run) >= 6
    ), hashed AS (
        SELECT run, n, {_crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted
    ), damaged AS (
        SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                    ELSE run END AS word, n
        FROM hashed
    ), words AS MATERIALIZED (
        SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
    ), cut AS MATERIALIZED (
        SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), pairs AS (
        SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
        UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
    ), best AS (
        SELECT word, count(*) AS n_near, max(near_n) AS form_n FROM pairs GROUP BY word
    ), formed AS MATERIALIZED (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n,
               CASE WHEN form_n >= 5 * w.n
                    THEN (SELECT min(near) FROM pairs p WHERE p.word = w.word AND p.near_n = best.form_n) END AS form
        FROM words w LEFT JOIN best USING (word)
    ), ways AS (
        SELECT word, word AS root, form AS next FROM formed
        UNION ALL SELECT ways.word, ways.next, f.form FROM ways JOIN formed f ON f.word = ways.next
    )
    SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM formed JOIN (
        SELECT word, root FROM ways WHERE next IS NULL
    ) USING (word)
    """
)
def op11_chunk_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.word_counts(read(spark, sf_dir, "documents")))


@query()
def op12_diagonal_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(read(spark, sf_dir, "documents"), license_scan.default_templates(spark))


@query(
    f"""
    WITH RECURSIVE own AS (
        SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))
               AS turns, {_crc32_sql("conv_id::VARCHAR")} % 9 AS h
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ), paths AS MATERIALIZED (
        SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS path
        FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
    ), prefixes AS MATERIALIZED (
        SELECT conv_id, d AS depth, len(path) = d AS ends, md5(path[1:d]::VARCHAR) AS node,
               CASE WHEN d > 0 THEN md5(path[1:d - 1]::VARCHAR) END AS parent,
               CASE WHEN d > 0 THEN strlen(path[d][2]) ELSE 0 END AS bytes
        FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM paths)
    ), nodes AS MATERIALIZED (
        SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
               (count(*) - 1) * any_value(bytes) AS saved,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
        FROM prefixes GROUP BY depth, node
    ), children AS (
        SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY ALL
    ), full_nodes AS MATERIALIZED (
        SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (depth, node)
    ), sums AS (
        SELECT a.depth, a.node, sum(n.saved) AS saved_tokens, count(*) FILTER (n.n_children = 0) AS n_leaves
        FROM full_nodes n JOIN prefixes own ON own.conv_id = n.conv_id AND own.depth = n.depth
             JOIN prefixes a ON a.conv_id = n.conv_id AND a.depth <= n.depth
        GROUP BY ALL
    )
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
           s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM full_nodes n JOIN sums s USING (depth, node) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.parent
    """
)
def op13_parenthesis_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(prefix_trie.rebuilt(read(spark, sf_dir, "conversations")))
