"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm import (
    chat,
    decontamination,
    language_id,
    lexical_search,
    mixing,
    ngram_join,
    sequence_packing,
    sharding,
    substring_dedup,
    token_counts,
    url_filter,
    vector_codes,
    vector_dedup,
)
from folioworks.llm.shared import staging_folder
from folioworks.plans.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "op1_chat_formatting",
    r"""
    WITH t AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
               md5(coalesce(text, ''))) AS position,
             '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS line,
             md5(coalesce(role, '')) || md5(coalesce(text, '')) AS digest
      FROM conversations WHERE conv_id IS NOT NULL),
    c AS (
      SELECT conv_id, count(*) AS n_turns, string_agg(line, '' ORDER BY position) AS rendered,
             string_agg(digest, '' ORDER BY position) AS path
      FROM t GROUP BY conv_id),
    begins AS (SELECT DISTINCT left(path, 64 * k.k::INT) AS path FROM c, LATERAL (
      SELECT unnest(range(1, c.n_turns)) AS k) k)
    SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_equal, any_value(rendered) AS rendered
    FROM c WHERE path NOT IN (SELECT path FROM begins) GROUP BY path, n_turns
    """,
)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


#: The rules of the contract, and words of hosts that the filter itself blocks.
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]
URL_PATTERNS = [
    url_filter.Pattern(word, "block")
    for word in ("spam-farm", "cheap-pills", "casino", "porn", "xxx", "viagra", "adult", "betting")
]


def _url_sql() -> str:
    def text(s: str) -> str:
        return s.replace("'", "''")

    fits = [
        (
            len(r.name),
            f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN ",
            r,
        )
        for r in URL_RULES
    ]
    fits.sort(key=lambda f: -f[0])
    rule = " ".join(f"{f[1]}'{text(f[2].name)}'" for f in fits)
    verdict = " ".join(f"{f[1]}'{f[2].verdict}'" for f in fits)
    own = "|".join(p.word for p in URL_PATTERNS)
    return rf"""
    WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0
                 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
    SELECT page_id, host, path, CASE {rule} END AS rule,
           CASE {verdict} ELSE CASE WHEN regexp_matches(host || path, '(?i)(^|[^A-Za-z0-9])({own})([^A-Za-z0-9]|$)')
             THEN 'block' ELSE 'allow' END END AS verdict
    FROM s
    """


@query("op7_url_filter", _url_sql())
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, URL_PATTERNS)


@query("op9_source_mixing")
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own, so the query always shows the cold path: every distinct text is encoded.
    counts = token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), staging_folder(spark)
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=13)


@query("op8_embedding_near_dedup")
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), width=3, percent=90)


@query("op4_benchmark_decontamination")
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_best_fit_packing")
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    packed = sequence_packing.pack(table(spark, sf_dir, "documents"), tokenizer, capacity=1024, end_id=2)
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def _codes_sql() -> str:
    """Two rounds of codebooks of 16 parts of four dimensions, entry by entry."""
    dims = range(1, 5)
    distance = " + ".join(f"(p.v[{d}] - b.v[{d}]) * (p.v[{d}] - b.v[{d}])" for d in dims)
    means = ", ".join(f"floor(sum(p.v[{d}])::DOUBLE / count(*))::BIGINT" for d in dims)

    def near(books: str) -> str:
        # The entry is the last part of what is minimised, so the lower index wins a tie.
        return f"SELECT p.rn, p.part, min(({distance}) * 256 + b.entry) AS x FROM p JOIN {books} b USING (part) GROUP BY ALL"

    def moved(books: str, near: str) -> str:
        return f"""SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN (
          SELECT p.part, n.x % 256 AS entry, [{means}] AS v FROM p JOIN {near} n USING (rn, part) GROUP BY ALL) m
          USING (part, entry)"""

    return f"""
    WITH numbers AS MATERIALIZED (
      SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    kept AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS rn FROM numbers),
    p AS MATERIALIZED (SELECT rn, part, q[4 * part + 1 : 4 * part + 4] AS v FROM kept, range(16) r(part)),
    b0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, v FROM p WHERE rn <= 64),
    n0 AS MATERIALIZED ({near("b0")}), b1 AS MATERIALIZED ({moved("b0", "n0")}),
    n1 AS MATERIALIZED ({near("b1")}), b2 AS MATERIALIZED ({moved("b1", "n1")}),
    n2 AS MATERIALIZED ({near("b2")}),
    coded AS MATERIALIZED (
      SELECT rn, string_agg(lower(printf('%02x', x % 256)), '' ORDER BY part) AS code, sum(x // 256)::BIGINT AS error
      FROM n2 GROUP BY rn),
    digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (rn), digest
    """


@query("op12_vector_codes", _codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return vector_codes.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256")
    )


@query(
    "op13_ranked_search",
    r"""
    WITH letters AS (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    d AS MATERIALIZED (SELECT doc_id, terms, len(terms) AS n FROM letters WHERE len(terms) > 0),
    tf AS MATERIALIZED (
      SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL),
    sums AS MATERIALIZED (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM d),
    w AS MATERIALIZED (
      SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), sums),
    q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    scored AS (
      SELECT item_id, doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term), sums GROUP BY item_id, doc_id),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
