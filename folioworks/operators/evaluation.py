"""Comparison of evaluation runs.

A run is a table with a question, a response, a row order and any set of numeric metrics. Every
per-question step aggregates before it joins, so a question repeated many times costs one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks import fixed_values as fv
from folioworks.functions.core import strip
from folioworks.functions.text import join_key, shorten
from folioworks.session import cut_lineage

METRICS = fv.SCORE_METRICS


def number(c: Column) -> Column:
    """A number, or NULL for text that is none and for NaN."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def prepare_run(df: DataFrame, metrics=METRICS, question: str = "user_input") -> DataFrame:
    """Numeric metrics and a ``_key``; rows without a question are dropped."""
    missing = sorted({question, *metrics} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    typed = df.withColumns({m: number(F.col(m)) for m in metrics})
    return typed.withColumn("_key", join_key(F.col(question))).where(F.col("_key") != "")


def run_means(run: DataFrame, metrics=METRICS) -> DataFrame:
    return run.agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(m).alias(m) for m in metrics])


def _question_hash() -> list[Column]:
    """128 bits that stand for a question: the texts themselves are no key of an aggregate."""
    return [F.xxhash64("_key").alias("_k1"), F.xxhash64(F.lit(1), "_key").alias("_k2")]


def _means(run: DataFrame, metrics, response: str, order: str) -> DataFrame:
    """Per question: means, the row whose response comes first, and a row that has the question. Numbers only."""
    present = F.when(F.col(response).isNotNull(), F.col(order))
    narrow = run.select(*_question_hash(), *metrics, F.col(order).alias("_row"), present.alias("_present"))
    return narrow.groupBy("_k1", "_k2").agg(
        *[F.avg(m).alias(m) for m in metrics], F.min("_present").alias("_response_row"), F.min("_row").alias("_key_row")
    )


def by_question(run: DataFrame, metrics=METRICS, response: str = "response", order: str = "row_id") -> DataFrame:
    """Means per question and its first response that is present; ``order`` is unique in a run."""
    means = _means(run, metrics, response, order)
    keys = run.select(F.col(order).alias("_key_row"), "_key")
    texts = run.select(F.col(order).alias("_response_row"), response)
    out = means.join(keys, "_key_row").join(texts, "_response_row", "left")
    return out.select("_key", *metrics, response)


def common_questions(proposed: DataFrame, baseline: DataFrame, metrics=METRICS) -> DataFrame:
    """Questions of both runs, with suffixed columns. Texts join the rows that are left."""

    def side(run: DataFrame, suffix: str) -> DataFrame:
        means = _means(run, metrics, "response", "row_id")
        named = [F.col(c).alias(f"{c}_{suffix}") for c in (*metrics, "_response_row", "_key_row")]
        return means.select("_k1", "_k2", *named)

    def texts(run: DataFrame, suffix: str) -> DataFrame:
        return run.select(F.col("row_id").alias(f"_response_row_{suffix}"), F.col("response").alias(f"response_{suffix}"))

    pairs = side(proposed, "proposed").join(side(baseline, "baseline"), ["_k1", "_k2"])
    keys = proposed.select(F.col("row_id").alias("_key_row_proposed"), "_key")
    out = pairs.join(keys, "_key_row_proposed")
    for run, suffix in ((proposed, "proposed"), (baseline, "baseline")):
        out = out.join(texts(run, suffix), f"_response_row_{suffix}", "left")
    cols = [f"{c}_{suffix}" for suffix in ("proposed", "baseline") for c in (*metrics, "response")]
    return out.select("_key", *cols)


def summary(proposed: DataFrame, baseline: DataFrame, metrics=METRICS) -> DataFrame:
    """Means of both runs, and of the average of both on their common questions."""
    pairs = common_questions(proposed, baseline, metrics)
    halves = pairs.select(*[((F.col(f"{m}_proposed") + F.col(f"{m}_baseline")) / 2).alias(m) for m in metrics])
    parts = [
        ("mean_eval_proposed", run_means(proposed, metrics)),
        ("mean_eval_baseline", run_means(baseline, metrics)),
        ("mean_common_questions_(avg_of_two)", run_means(halves, metrics)),
    ]
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("label"), "*") for name, df in parts])


def row_mean(columns: list[Column]) -> Column:
    """Mean of the values that are present; NULL when none is."""
    present = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.aggregate(
        present, F.lit(0.0), lambda a, x: a + x, lambda a: F.try_divide(a, F.size(present).cast("double"))
    )


def differences(pairs: DataFrame, metrics=METRICS) -> DataFrame:
    """Per question: proposed minus baseline for every metric, and their mean."""
    diffs = [(F.col(f"{m}_proposed") - F.col(f"{m}_baseline")).alias(f"{m}_diff") for m in metrics]
    out = pairs.select(F.col("_key").alias("user_input"), "response_proposed", "response_baseline", *diffs)
    return out.withColumn("avg_diff", row_mean([F.col(f"{m}_diff") for m in metrics]))


def win_loss(diffs: DataFrame, metrics=METRICS, band: float = fv.EQUAL_BAND) -> DataFrame:
    """Better, worse and other questions per metric; a missing difference counts as equal."""
    long = diffs.unpivot([], [f"{m}_diff" for m in metrics], "metric", "diff")
    counted = long.groupBy(F.regexp_replace("metric", "_diff$", "").alias("metric")).agg(
        F.count_if(F.col("diff") > band).alias("better"),
        F.count_if(F.col("diff") < -band).alias("worse"),
        F.count(F.lit(1)).alias("n"),
    )
    return counted.select(
        "metric",
        "better",
        "worse",
        (F.col("n") - F.col("better") - F.col("worse")).alias("equal"),
        F.round(F.col("better") * 100.0 / F.col("n"), 2).alias("pct_improved"),
    )


def top_movers(diffs: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` questions that gained most and the ``n`` that lost most."""
    diffs = cut_lineage(diffs)  # both ends are read off it
    rank = F.round("avg_diff", 9)
    gained = diffs.orderBy(rank.desc_nulls_last(), "user_input").limit(n)
    lost = diffs.orderBy(rank.asc_nulls_last(), "user_input").limit(n)
    return gained.withColumn("side", F.lit("top")).unionByName(lost.withColumn("side", F.lit("bottom")))


def examples(diffs: DataFrame, metric: str = "answer_correctness") -> DataFrame:
    """The best and the worst question by one metric, with both responses."""
    diffs = cut_lineage(diffs)  # both ends are read off it
    d = F.round(f"{metric}_diff", 9)
    best = diffs.where(d.isNotNull()).orderBy(d.desc(), "user_input").limit(1)
    worst = diffs.where(d.isNotNull()).orderBy(d.asc(), "user_input").limit(1)
    return best.withColumn("side", F.lit("best")).unionByName(worst.withColumn("side", F.lit("worst")))


def score_by_difficulty(df: DataFrame, score: str = "score", difficulty: str = "difficulty") -> DataFrame:
    """Mean score per difficulty and over all, in one pass."""
    known = df.withColumn("_d", F.coalesce(F.col(difficulty), F.lit(fv.UNKNOWN_DIFFICULTY)))
    out = known.rollup("_d").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.grouping("_d").alias("_all")
    )
    return out.select(F.when(F.col("_all") == 1, "(all)").otherwise(F.col("_d")).alias(difficulty), "n", "mean_score")


def pair_with_references(answers: DataFrame, references: DataFrame, key: str = "id") -> DataFrame:
    """Answers with their reference by id; those that are blank or a refusal take no part in scoring."""
    from folioworks.functions.text import is_failed_answer

    joined = answers.join(references, key)
    return joined.withColumn("scored", ~is_failed_answer(F.coalesce(F.col("answer"), F.lit(""))))


def select_contexts(
    df: DataFrame,
    question: str,
    content: str,
    score: str,
    order: str,
    max_contexts: int = fv.CONTEXT_MAX,
    max_chars: int = fv.CONTEXT_MAX_CHARS,
) -> DataFrame:
    """Best distinct contexts of each question, cut to a length: (question, rank, context).

    Equal texts are merged first (before any cut), then only the best few per question are ranked;
    Spark limits each task to those before the exchange.
    """
    limit = max(1, int(max_contexts))
    chars = max(fv.CONTEXT_MIN_CHARS_LIMIT, int(max_chars))
    text = strip(F.coalesce(F.col(content), F.lit("")))
    ranked = df.select(
        question, text.alias("_t"), F.struct((-F.coalesce(F.col(score), F.lit(0.0))).alias("s"), F.col(order).alias("o")).alias("_r")
    )
    distinct = ranked.where("_t <> ''").groupBy(question, "_t").agg(F.min("_r").alias("_r"))
    w = Window.partitionBy(question).orderBy("_r")
    best = distinct.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return best.select(question, "rank", shorten(F.col("_t"), chars).alias("context"))

