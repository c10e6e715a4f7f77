"""Run comparison queries. Two runs are derived from the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.operators import evaluation as ev
from folioworks.plans.book_queries import WS
from folioworks.plans.document_queries import collapse_sql
from folioworks.plans.registry import query, table

_M = fv.SCORE_METRICS


def _metric(name: str, mult: int, run: str) -> str:
    shift = 0 if run == "proposed" else 3
    return (
        f"CASE WHEN doc_id % 13 = {shift} THEN CAST('NaN' AS DOUBLE) WHEN doc_id % 17 = {shift} THEN NULL"
        f" ELSE CAST((doc_id * {mult} + rep * 5) % 101 AS DOUBLE) / 100 END AS {name}"
    )


def run_sql(run: str) -> str:
    """One run; the same body for both engines. Questions repeat, some are blank or in one run only."""
    other = "" if run == "proposed" else " WHEN doc_id % 9 = 0 THEN 'khác ' || text"
    asked = f"CASE WHEN doc_id % 31 = 30 THEN '   '{other} WHEN rep = 1 THEN ' ' || replace(text, ' ', '  ') ELSE text END"
    mult = (7, 11, 13, 17) if run == "proposed" else (5, 11, 19, 23)
    metrics = ", ".join(_metric(m, k, run) for m, k in zip(_M, mult))
    return f"""
    SELECT doc_id * 2 + rep AS row_id, {asked} AS user_input,
      CASE WHEN doc_id % 3 = 0 AND rep = 0 THEN NULL ELSE '{run} ' || lang || ' ' || CAST(doc_id AS STRING) || ' ' || CAST(rep AS STRING) END AS response,
      {metrics}
    FROM (SELECT r.doc_id, d.text, d.lang, r.rep
          FROM (SELECT doc_id, 0 AS rep FROM {{labels}} UNION ALL
                SELECT doc_id, 1 AS rep FROM {{labels}}) r
          JOIN {{documents}} d ON d.doc_id = r.doc_id) x
    """


def run(spark, sf_dir, name):
    df = spark.sql(
        run_sql(name), labels=table(spark, sf_dir, "labels"), documents=table(spark, sf_dir, "documents")
    )
    return ev.prepare_run(df)


def both(spark, sf_dir):
    return run(spark, sf_dir, "proposed"), run(spark, sf_dir, "baseline")


def _prep(name: str) -> str:
    metrics = ", ".join(f"CASE WHEN isnan({m}) THEN NULL ELSE {m} END AS {m}" for m in _M)
    body = run_sql(name).replace("{labels}", "labels").replace("{documents}", "documents")
    return (
        f"{name} AS (SELECT * FROM (SELECT row_id, response, {metrics}, {collapse_sql('user_input')} AS _key FROM ({body})) WHERE _key <> '')"
    )


def _grouped(name: str) -> str:
    avgs = ", ".join(f"avg({m}) AS {m}" for m in _M)
    return f"{name}_q AS (SELECT _key, {avgs}, arg_min(response, row_id) FILTER (WHERE response IS NOT NULL) AS response FROM {name} GROUP BY _key)"


_RUNS = f"WITH {_prep('proposed')}, {_prep('baseline')}"
_COMMON = (
    f"{_RUNS}, {_grouped('proposed')}, {_grouped('baseline')}, common AS (SELECT p._key, "
    + ", ".join(f"p.{c} AS {c}_proposed, b.{c} AS {c}_baseline" for c in (*_M, "response"))
    + " FROM proposed_q p JOIN baseline_q b ON b._key = p._key)"
)
_DIFFS = (
    f"{_COMMON}, d AS (SELECT _key AS user_input, response_proposed, response_baseline, "
    + ", ".join(f"{m}_proposed - {m}_baseline AS {m}_diff" for m in _M)
    + " FROM common), diffs AS (SELECT *, list_avg(["
    + ", ".join(f"{m}_diff" for m in _M)
    + "]) AS avg_diff FROM d)"
)
_R6 = ", ".join(f"round({m}, 6) AS {m}" for m in _M)


def _rounded(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "eval_means",
    f"{_RUNS} "
    + " UNION ALL ".join(
        f"SELECT '{r}' AS run, count(*) AS n_rows, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in _M) + f" FROM {r}"
        for r in ("proposed", "baseline")
    ),
)
def eval_means(spark, sf_dir):
    p, b = both(spark, sf_dir)
    out = ev.run_means(p).withColumn("run", F.lit("proposed")).unionByName(
        ev.run_means(b).withColumn("run", F.lit("baseline"))
    )
    return _rounded(out, _M)


@query("eval_by_question", f"{_RUNS}, {_grouped('proposed')} SELECT _key, response, {_R6} FROM proposed_q")
def eval_by_question(spark, sf_dir):
    return _rounded(ev.by_question(run(spark, sf_dir, "proposed")), _M)


@query(
    "eval_common",
    f"{_COMMON} SELECT _key, response_proposed, response_baseline, "
    + ", ".join(f"round({m}_{s}, 6) AS {m}_{s}" for m in _M for s in ("proposed", "baseline"))
    + " FROM common",
)
def eval_common(spark, sf_dir):
    return _rounded(
        ev.common_questions(*both(spark, sf_dir)), [f"{m}_{s}" for m in _M for s in ("proposed", "baseline")]
    )


@query(
    "eval_summary",
    f"{_COMMON}, halves AS (SELECT " + ", ".join(f"({m}_proposed + {m}_baseline) / 2 AS {m}" for m in _M) + " FROM common) "
    + " UNION ALL ".join(
        f"SELECT '{label}' AS label, count(*) AS n_rows, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in _M) + f" FROM {src}"
        for label, src in (
            ("mean_eval_proposed", "proposed"),
            ("mean_eval_baseline", "baseline"),
            ("mean_common_questions_(avg_of_two)", "halves"),
        )
    ),
)
def eval_summary(spark, sf_dir):
    return _rounded(ev.summary(*both(spark, sf_dir)), _M)


_DIFF_COLUMNS = [*(f"{m}_diff" for m in _M), "avg_diff"]
_RD6 = ", ".join(f"round({c}, 6) AS {c}" for c in _DIFF_COLUMNS)


@query("eval_diffs", f"{_DIFFS} SELECT user_input, response_proposed, response_baseline, {_RD6} FROM diffs")
def eval_diffs(spark, sf_dir):
    return _rounded(ev.differences(ev.common_questions(*both(spark, sf_dir))), _DIFF_COLUMNS)


@query(
    "eval_win_loss",
    f"{_DIFFS} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, count(*) FILTER (WHERE {m}_diff > 0.001) AS better, count(*) FILTER (WHERE {m}_diff < -0.001) AS worse,"
        f" count(*) - count(*) FILTER (WHERE {m}_diff > 0.001) - count(*) FILTER (WHERE {m}_diff < -0.001) AS equal,"
        f" round(count(*) FILTER (WHERE {m}_diff > 0.001) * 100.0 / count(*), 2) AS pct_improved FROM diffs"
        for m in _M
    ),
)
def eval_win_loss(spark, sf_dir):
    return ev.win_loss(ev.differences(ev.common_questions(*both(spark, sf_dir))))


_MOVER_COLUMNS = f"user_input, response_proposed, response_baseline, {_RD6}"


@query(
    "eval_top_bottom",
    f"{_DIFFS}, hi AS (SELECT * FROM diffs ORDER BY round(avg_diff, 9) DESC NULLS LAST, user_input LIMIT 5),"
    f" lo AS (SELECT * FROM diffs ORDER BY round(avg_diff, 9) ASC NULLS LAST, user_input LIMIT 5)"
    f" SELECT {_MOVER_COLUMNS}, 'top' AS side FROM hi UNION ALL SELECT {_MOVER_COLUMNS}, 'bottom' FROM lo",
)
def eval_top_bottom(spark, sf_dir):
    return _rounded(ev.top_movers(ev.differences(ev.common_questions(*both(spark, sf_dir)))), _DIFF_COLUMNS)


@query(
    "eval_examples",
    f"{_DIFFS}, k AS (SELECT * FROM diffs WHERE answer_correctness_diff IS NOT NULL),"
    f" hi AS (SELECT * FROM k ORDER BY round(answer_correctness_diff, 9) DESC, user_input LIMIT 1),"
    f" lo AS (SELECT * FROM k ORDER BY round(answer_correctness_diff, 9) ASC, user_input LIMIT 1)"
    f" SELECT {_MOVER_COLUMNS}, 'best' AS side FROM hi UNION ALL SELECT {_MOVER_COLUMNS}, 'worst' FROM lo",
)
def eval_examples(spark, sf_dir):
    return _rounded(ev.examples(ev.differences(ev.common_questions(*both(spark, sf_dir)))), _DIFF_COLUMNS)


_SCORES = """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN 'Dễ' ELSE 'Khó' END AS difficulty,
  CASE WHEN l.toxic = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(d.n_chars % 100 AS DOUBLE) / 100 END AS score
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id"""


@query(
    "score_by_difficulty",
    f"""WITH s AS ({_SCORES.format(documents='documents', labels='labels')})
SELECT CASE WHEN grouping(difficulty) = 1 THEN '(all)' ELSE difficulty END AS difficulty, count(*) AS n, round(avg(score), 6) AS mean_score
FROM (SELECT doc_id, score, coalesce(difficulty, 'Unknown') AS difficulty FROM s) GROUP BY ROLLUP (difficulty)""",
)
def score_by_difficulty(spark, sf_dir):
    scored = spark.sql(
        _SCORES, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels")
    )
    return _rounded(ev.score_by_difficulty(scored), ["mean_score"])


_ANSWERS = "CASE WHEN doc_id % 6 = 0 THEN 'Tôi không biết ' || lang WHEN doc_id % 7 = 0 THEN NULL ELSE text END"


@query(
    "scored_pairs",
    f"""WITH a AS (SELECT doc_id, {_ANSWERS} AS answer FROM documents)
SELECT a.doc_id, a.answer, CAST(l.quality AS BIGINT) AS reference, NOT (trim(coalesce(a.answer, ''), {WS}) = '' OR contains(lower(coalesce(a.answer, '')), 'tôi không biết')
  OR contains(lower(coalesce(a.answer, '')), 'không tìm thấy dữ liệu')) AS scored FROM a JOIN labels l ON l.doc_id = a.doc_id""",
)
def scored_pairs(spark, sf_dir):
    answers = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_ANSWERS} AS answer")
    refs = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality AS reference")
    return ev.pair_with_references(answers, refs, "doc_id")


_RETRIEVED = """SELECT conv_id, CAST(turn AS INT) * 2 + rep AS pos,
  CASE WHEN turn % 5 = 4 THEN '  ' WHEN rep = 1 THEN ' ' || text || ' ' ELSE text || text || text END AS content,
  CASE WHEN turn % 4 = 3 THEN NULL ELSE CAST((turn * 37 + rep * 11 + conv_id) % 13 AS DOUBLE) / 10 END AS score
FROM (SELECT c.*, 0 AS rep FROM {conversations} c UNION ALL SELECT c.*, 1 AS rep FROM {conversations} c
      UNION ALL SELECT c.*, 2 AS rep FROM {conversations} c) x"""


@query(
    "select_contexts",
    f"""WITH r AS ({_RETRIEVED.format(conversations='conversations')}),
s AS (SELECT conv_id, pos, trim(content, {WS}) AS t, coalesce(score, 0.0) AS score FROM r WHERE trim(content, {WS}) <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, t ORDER BY score DESC, pos) AS rn FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, pos) AS rank FROM f WHERE rn = 1)
SELECT conv_id, rank, CASE WHEN length(t) > 1200 THEN left(t, 1200) || '...' ELSE t END AS context FROM k WHERE rank <= 4""",
)
def select_contexts(spark, sf_dir):
    found = spark.sql(_RETRIEVED, conversations=table(spark, sf_dir, "conversations"))
    return ev.select_contexts(found, "conv_id", "content", "score", "pos")
