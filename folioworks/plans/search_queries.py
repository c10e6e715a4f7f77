"""Search queries: every vector is also a question, buckets are the labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions.text import name_tokens
from folioworks.functions.vectors import hashed_embedding, l2_normalize
from folioworks.operators import prompts, pruned_search, search
from folioworks.plans.registry import query, spread, table

BOOST_WORDS = ("tion", "ung")
K = {"b0": 2, "b1": 4, "b2": 1}


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("b"), F.col("label").cast("string")).alias("index_type"),
        F.col("embedding").alias("vec"),
    )


def questions(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("question"))
    asked = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vec"))
    return asked.join(texts, "question_id", "left").withColumn("question", F.coalesce("question", F.lit("")))


def routes(spark, sf_dir):
    centroids = search.bucket_centroids(vectors(spark, sf_dir))
    return centroids.select(
        "index_type", (F.col("index_type") == "b3").alias("boosted"), l2_normalize(F.col("vec")).alias("vec")
    )


def routed(spark, sf_dir):
    return search.route_questions(questions(spark, sf_dir), routes(spark, sf_dir), BOOST_WORDS)


def retrieved(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumnRenamed("index_type", "bucket")
    return search.routed_topk(routed(spark, sf_dir), v, K)


# --- checking SQL -------------------------------------------------------------------------------

_ROUTED = """WITH v AS (SELECT vec_id AS id, 'b' || label AS index_type, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
x AS (SELECT index_type, unnest(vec) AS x, unnest(range(len(vec))) AS d FROM v),
m AS (SELECT index_type, d, avg(x) AS x FROM x GROUP BY index_type, d),
c AS (SELECT index_type, list(x ORDER BY d) AS vec FROM m GROUP BY index_type),
r AS (SELECT index_type, list_transform(vec, lambda y: y / sqrt(list_inner_product(vec, vec))) AS vec FROM c),
q AS (SELECT v.id AS question_id, v.vec, coalesce(d.text, '') AS question FROM v LEFT JOIN documents d ON d.doc_id = v.id),
s AS (SELECT q.question_id, q.question, q.vec, r.index_type, round(list_inner_product(q.vec, r.vec)
  + CASE WHEN r.index_type = 'b3' AND (contains(lower(q.question), 'tion') OR contains(lower(q.question), 'ung')) THEN 0.04 ELSE 0 END, 6) AS score FROM q, r),
routed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, index_type) AS rank FROM s)"""

_FOUND = (
    _ROUTED
    + """,
p AS (SELECT t.question_id, t.index_type, t.question, v.id, round(list_inner_product(t.vec, v.vec), 6) AS score
  FROM routed t JOIN v ON v.index_type = t.index_type WHERE t.rank = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM p),
found AS (SELECT question_id, index_type, question, rank, id, score FROM k
  WHERE rank <= CASE index_type WHEN 'b0' THEN 2 WHEN 'b1' THEN 4 WHEN 'b2' THEN 1 ELSE 3 END)"""
)


@query(
    "l2_normalize",
    """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 50 = 7 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: 0 * x)
  ELSE list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (vec_id % 7 + 1)) END AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM v)
SELECT vec_id, unnest(range(len(v))) AS d, round(unnest(list_transform(v, lambda x: CASE WHEN norm > 0 THEN x / norm ELSE x END)), 6) + 0 AS x FROM n""",
)
def l2_normalize_query(spark, sf_dir):
    scaled = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id",
        "transform(cast(embedding as array<double>), x -> CASE WHEN vec_id % 50 = 7 THEN 0 * x ELSE x * (vec_id % 7 + 1) END) AS v",
    )
    unit = scaled.select("vec_id", F.posexplode(l2_normalize(F.col("v"))).alias("d", "x"))
    return unit.withColumn("x", F.round("x", 6) + 0.0)


_TOPK_SQL = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
p AS (SELECT a.vec_id AS question_id, b.vec_id AS id, round(list_inner_product(a.vec, b.vec), 6) AS score FROM v a, v b),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM p)
SELECT question_id, rank, id, score FROM k WHERE rank <= 5"""


@query("vector_topk", _TOPK_SQL)
def vector_topk(spark, sf_dir):
    one = F.lit("all").alias("bucket")
    v = table(spark, sf_dir, "embeddings")
    asked = v.select(F.col("vec_id").alias("question_id"), one, F.col("embedding").alias("vec"))
    return search.exact_topk(asked, v.select(F.col("vec_id").alias("id"), one, F.col("embedding").alias("vec")), 5)


@query("vector_topk_pruned", _TOPK_SQL)
def vector_topk_pruned(spark, sf_dir):
    """The same from an index of blocks, where a question skips blocks that can't hold one of its best."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.lit("all").alias("bucket"), F.col("embedding").alias("vec"))
    index = pruned_search.build_index(v.withColumnRenamed("vec_id", "id"), rows_per_block=100)
    return pruned_search.pruned_topk(v.withColumnRenamed("vec_id", "question_id"), index, 5)


@query(
    "route_questions",
    f"""{_ROUTED} SELECT question_id, max(index_type) FILTER (WHERE rank = 1) AS index_type, max(score) AS route_score,
  string_agg(index_type, ',' ORDER BY rank) AS ranking FROM routed GROUP BY question_id""",
)
def route_questions(spark, sf_dir):
    out = routed(spark, sf_dir)
    names = F.array_join(F.transform("ranking", lambda s: s["index_type"]), ",")
    return out.select("question_id", "index_type", "route_score", names.alias("ranking"))


@query("routed_topk", f"{_FOUND} SELECT question_id, index_type, rank, id, score FROM found")
def routed_topk(spark, sf_dir):
    return retrieved(spark, sf_dir)


@query("routed_topk_blocked", f"{_FOUND} SELECT question_id, index_type, rank, id, score FROM found")
def routed_topk_blocked(spark, sf_dir):
    """The same search with both sides in blocks, as for questions beyond the broadcast bound."""
    v = vectors(spark, sf_dir).withColumnRenamed("index_type", "bucket")
    return search.routed_topk(routed(spark, sf_dir), v, K, max_questions=0, per_block=(20, 15), strict=True)


_CONTEXT = (
    _FOUND
    + """,
blocks AS (SELECT f.question_id, f.question, f.rank, '#' || f.rank || ' id=' || f.id || CASE WHEN d.source IS NOT NULL THEN ' source=' || d.source ELSE '' END
  || CASE WHEN f.id % 2 = 0 THEN ' chunk=' || f.id // 2 ELSE '' END
  || ' score=' || printf('%.4f', f.score) || CASE WHEN d.lang IS NOT NULL THEN chr(10) || 'family: ' || d.lang ELSE '' END || chr(10) || coalesce(d.text, '') AS block
  FROM found f LEFT JOIN documents d ON d.doc_id = f.id),
contexts AS (SELECT question_id, any_value(question) AS question, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM blocks GROUP BY question_id)"""
)


def contexts(spark, sf_dir):
    """Rank ids first; texts are joined to the few survivors only."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang", "text")
    found = retrieved(spark, sf_dir).join(docs, "id", "left")
    block = prompts.context_block(
        F.col("rank"),
        F.col("id").cast("string"),
        F.col("source"),
        F.expr("CASE WHEN id % 2 = 0 THEN id div 2 END"),
        F.col("score"),
        F.col("text"),
        {"family": F.col("lang")},
    )
    return prompts.join_contexts(found.withColumn("block", block), "question_id", "rank", "block")


@query("build_context", f"{_CONTEXT} SELECT question_id, trim(context, chr(10) || ' ') AS context FROM contexts")
def build_context(spark, sf_dir):
    return contexts(spark, sf_dir).select("question_id", F.btrim("context", F.lit("\n ")).alias("context"))


_PROMPT_HEAD = (fv.ANSWER_SYSTEM + "\n\n" + fv.ANSWER_CONTEXT_HEAD).replace("'", "''")
_PROMPT_TAIL = ("\n\n" + fv.ANSWER_RULES).replace("'", "''")


@query(
    "build_prompts",
    f"""{_CONTEXT} SELECT question_id, '{_PROMPT_HEAD}' || context || chr(10) || chr(10) || '{fv.ANSWER_QUESTION_HEAD}' || question || '{_PROMPT_TAIL}' AS prompt FROM contexts""",
)
def build_prompts(spark, sf_dir):
    asked = questions(spark, sf_dir).select("question_id", "question")
    joined = asked.join(contexts(spark, sf_dir), "question_id", "left")
    return joined.select("question_id", prompts.answer_prompt(F.col("question"), F.col("context")).alias("prompt"))


_STOPS = ", ".join(f"'{w}'" for w in fv.NAME_STOPWORDS)


def _tokens_sql(x: str) -> str:
    folded = f"replace(regexp_replace(strip_accents(lower(trim({x}))), '\\s+', ' ', 'g'), 'đ', 'd')"
    return f"list_filter(regexp_extract_all({folded}, '[a-z0-9]+'), lambda w: NOT list_contains([{_STOPS}], w))"


@query(
    "name_match_filter",
    f"""{_FOUND}, n AS (SELECT f.question_id, f.question, f.rank, f.id, split_part(d.text, ' ', 1) AS name FROM found f LEFT JOIN documents d ON d.doc_id = f.id),
t AS (SELECT *, {_tokens_sql('coalesce(name, chr(32))')} AS nt, {_tokens_sql('question')} AS qt FROM n),
h AS (SELECT *, len(nt) > 0 AND list_has_all(qt, nt) AS hit FROM t),
a AS (SELECT *, bool_or(hit) OVER (PARTITION BY question_id) AS any_hit FROM h)
SELECT question_id, rank, id FROM a WHERE hit OR (NOT any_hit AND rank = 1)""",
)
def name_match_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.split_part("text", F.lit(" "), F.lit(1)).alias("name")
    )
    asked = questions(spark, sf_dir).select("question_id", "question")
    found = retrieved(spark, sf_dir).join(docs, "id", "left").join(asked, "question_id")
    return search.name_match_filter(found, "question", "name").select("question_id", "rank", "id")


@query(
    "hash_embed",
    f"""WITH t AS (SELECT doc_id, {_tokens_sql('text')} AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS w FROM t),
h AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS d,
  CASE WHEN CAST('0x' || substr(md5(w), 9, 1) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM w),
g AS (SELECT documents.doc_id, r.d FROM documents, (SELECT unnest(range(64)) AS d) r),
c AS (SELECT g.doc_id, g.d, coalesce(sum(h.sign), 0) AS x FROM g LEFT JOIN h ON h.doc_id = g.doc_id AND h.d = g.d GROUP BY g.doc_id, g.d)
SELECT doc_id, d, round(CASE WHEN sum(x * x) OVER (PARTITION BY doc_id) > 0 THEN x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) ELSE x END, 6) + 0 AS x FROM c""",
)
def hash_embed(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    vec = hashed_embedding(name_tokens(F.col("text")), 64)
    return docs.select("doc_id", F.posexplode(vec).alias("d", "x")).withColumn("x", F.round("x", 6) + 0.0)
