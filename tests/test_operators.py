"""Operators on small inputs: brute force, skew paths, sources, sinks and streams."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks import fixed_values as fv
from folioworks.operators import evaluation as ev
from folioworks.operators import images as im
from folioworks.operators import metrics, ocr, prompts, records, search, segment, store
from folioworks.functions.text import stable_id
from folioworks.operators.scan import ordered_scan
from folioworks.plans import pipelines
from folioworks.session import settings as session_settings
from folioworks.sources import files, sinks
from folioworks.streaming import ingest


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-")


# --- search -------------------------------------------------------------------------------------


def brute_force(q, v, k):
    out = {}
    for qi, qb, qv in q:
        scored = sorted((-round(float(np.dot(qv, x)), 6), i) for i, b, x in v if b == qb and len(x) == len(qv))
        out[qi] = [(i, -s) for s, i in scored[:k]]
    return out


def make_vectors(n, seed, buckets, dim=8):
    rng = np.random.default_rng(seed)
    # Coarse values make many equal scores, and most vectors share one bucket.
    return [
        (int(i), buckets[0] if rng.random() < 0.6 else str(rng.choice(buckets)), [float(x) for x in rng.integers(-1, 2, dim)])
        for i in range(n)
    ]


@pytest.mark.parametrize("max_questions", [1000, 0])
def test_topk_equals_brute_force(spark, monkeypatch, max_questions):
    monkeypatch.setattr(search, "VECTORS_PER_BLOCK", 60)
    monkeypatch.setattr(search, "QUESTIONS_PER_BLOCK", 7)
    v, q = make_vectors(400, 1, ["a", "b", "c"]), make_vectors(30, 2, ["a", "b", "c"])
    v.append((1000, "a", [1.0, 2.0]))
    vdf = spark.createDataFrame(v, "id bigint, bucket string, vec array<double>").repartition(5)
    qdf = spark.createDataFrame(q, "question_id bigint, bucket string, vec array<double>")
    rows = search.exact_topk(qdf, vdf, 6, max_questions=max_questions).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["question_id"], r["rank"])):
        got.setdefault(r["question_id"], []).append((r["id"], r["score"]))
    assert got == brute_force(q, v, 6)


def test_small_blocks_copy_no_row_to_ever_more_tasks(spark):
    v, q = make_vectors(400, 1, ["a", "b"]), make_vectors(300, 2, ["a", "b"])
    vdf = spark.createDataFrame(v, "id bigint, bucket string, vec array<double>").repartition(5)
    qdf = spark.createDataFrame(q, "question_id bigint, bucket string, vec array<double>")
    counts = search.block_counts(qdf, vdf, (3, 2)).collect()
    assert len(counts) == 2 and all(1 < max(r["n_q"], r["n_v"]) <= search.MOST_BLOCKS for r in counts)
    got = {}
    rows = search.exact_topk(qdf, vdf, 6, max_questions=0, per_block=(3, 2)).collect()
    for r in sorted(rows, key=lambda r: (r["question_id"], r["rank"])):
        got.setdefault(r["question_id"], []).append((r["id"], r["score"]))
    assert got == brute_force(q, v, 6)


def test_topk_with_text_ids(spark):
    v = [("e1", "x", [1.0, 0.0]), ("e2", "x", [0.0, 1.0]), ("-e1", "x", [-1.0, 0.0])]
    vdf = spark.createDataFrame(v, "id string, bucket string, vec array<double>")
    qdf = spark.createDataFrame([("q", "x", [1.0, 0.0])], "question_id string, bucket string, vec array<double>")
    got = [(r["id"], r["score"]) for r in search.exact_topk(qdf, vdf, 2).orderBy("rank").collect()]
    assert got == [("e1", 1.0), ("e2", 0.0)]


@pytest.mark.parametrize("limit", [256, 0])
def test_routing_boost(spark, monkeypatch, limit):
    monkeypatch.setattr(search, "MAX_LITERAL_ROUTES", limit)
    routes = spark.createDataFrame(
        [("diseases", False, [0.5, 0.0]), ("herbs", True, [0.47, 0.1])], "index_type string, boosted boolean, vec array<double>"
    )
    asked = spark.createDataFrame(
        [(1, "Cây gì", [1.0, 0.0]), (2, "gì", [1.0, 0.0])], "question_id bigint, question string, vec array<double>"
    )
    got = {r["question_id"]: r for r in search.route_questions(asked, routes).collect()}
    assert (got[1]["index_type"], got[1]["route_score"]) == ("herbs", 0.51)
    assert [s["index_type"] for s in got[2]["ranking"]] == ["diseases", "herbs"]


def test_name_filter(spark):
    rows = [(1, 1, "a b", "a"), (1, 2, "a b", "c"), (2, 1, "x", "c"), (2, 2, "x", None)]
    df = spark.createDataFrame(rows, "question_id int, rank int, question string, name string")
    got = {(r["question_id"], r["rank"]) for r in search.name_match_filter(df, "question", "name").collect()}
    assert got == {(1, 1), (2, 1)}


def test_compatible_buckets(spark):
    stats = spark.createDataFrame([("a", 4), ("b", 5), ("c", None)], "index_type string, dim int")
    assert {r["index_type"] for r in search.compatible_buckets(stats, 4).collect()} == {"a", "c"}


# --- scans over long groups ---------------------------------------------------------------------


@pytest.mark.parametrize("rows_per_block", [7, 50, 100_000])
def test_ordered_scan_equals_one_window(spark, rows_per_block):
    df = spark.range(600).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 5) END AS g",
        "(id * 37) % 101 AS o", "id", "id % 4 AS v",
    )
    w = Window.partitionBy("g").orderBy("o", "id")
    want = df.select(
        "*",
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.lag("v").over(w).alias("p"),
    )
    got = ordered_scan(df, ["g"], ["o", "id"], sums={"s": F.col("v")}, previous={"p": "v"}, rows_per_block=rows_per_block)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def ocr_items(spark):
    lines = [
        ("d", 1, 0, "heading", "Mở đầu", False, None),
        ("d", 1, 1, "paragraph", "một", False, None),
        ("d", 1, 2, "image", "x", False, "i1"),
        ("d", 2, 0, "paragraph", "hai </break>", False, None),
        ("d", 2, 1, "paragraph", "đầu trang", True, None),
        ("d", 2, 2, "image", "y", False, "i2"),
        ("d", 3, 0, "heading", "</break>", False, None),
        ("d", 3, 1, "heading", "Cuối", False, None),
        ("d", 3, 2, "paragraph", " ", False, None),
    ]
    return spark.createDataFrame(
        lines, "doc string, page_num int, item_no int, element_type string, text string, skip boolean, image_id string"
    ).withColumn("file_path", F.concat(F.col("image_id"), F.lit(".png")))


@pytest.mark.parametrize("rows_per_block", [1, 100_000])
def test_sections(spark, rows_per_block):
    out = ocr.sections(ocr_items(spark), ["page_num", "item_no"], rows_per_block=rows_per_block)
    got = [(r["section_id"], r["heading"], r["full_text"], [i["image_id"] for i in r["images"]], r["page_range"]) for r in out.orderBy("section_id").collect()]
    # The middle section has neither heading nor content and goes, with its image.
    assert got == [(1, "Mở đầu", "một hai", ["i1"], [1, 2]), (2, "Cuối", "", [], [3])]
    entry = ocr.section_entries(out).orderBy("section_id").first()
    assert (entry["id"], entry["chunk_count"], entry["has_images"]) == ("section_001", 1, True)
    titles = ocr.retrieval_docs(ocr.section_entries(out).withColumn("heading", F.lit(None).cast("string")))
    assert titles.first()["title"] == "Untitled Section"


@pytest.mark.parametrize("rows_per_block", [3, 40, 100_000])
def test_hot_document_and_conversation(spark, rows_per_block):
    """A third of all rows in one document without any break, and in one conversation."""
    rows = spark.range(300).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('d', id % 4) END AS doc", "id AS page_num", "0 AS item_no",
        "CASE WHEN id % 50 = 3 THEN 'heading' WHEN id % 21 = 0 THEN 'image' ELSE 'paragraph' END AS element_type",
        "concat('t', id, CASE WHEN id % 3 <> 0 AND id % 10 = 1 THEN ' </break>' ELSE '' END) AS text", "false AS skip",
        "concat('i', id) AS image_id", "'f' AS file_path",
    )
    want = sorted(map(str, ocr.sections(rows, ["page_num", "item_no"]).collect()))
    got = sorted(map(str, ocr.sections(rows, ["page_num", "item_no"], rows_per_block=rows_per_block).collect()))
    assert got == want
    hot = ocr.sections(rows, ["page_num", "item_no"], rows_per_block=rows_per_block).where("doc = 'hot'").collect()
    assert len(hot) == 1 and len(hot[0]["images"]) == sum(i % 21 == 0 and i % 50 != 3 for i in range(0, 300, 3))

    talk = rows.selectExpr("doc", "page_num AS turn", "'user' AS role", "text")
    out = {r["doc"]: r["prompt"] for r in prompts.messages_to_prompt(talk, "doc", "turn", "role", "text", rows_per_block).collect()}
    lines = out["hot"].split("\n\n")
    assert lines[:2] == ["USER: t0", "USER: t3"] and lines[-1] == "ASSISTANT:" and len(lines) == 101


@pytest.mark.parametrize("rows_per_block", [5, 100_000])
def test_reading_order_spacing(spark, rows_per_block):
    df = spark.range(200).selectExpr("id % 2 AS page", "(id * 13) % 97 AS y", "id % 10 AS x", "id % 20 AS h", "id")
    out = ocr.reading_order(df, ["page"], "x", "y", "h", ["id"], rows_per_block=rows_per_block).collect()
    for page in (0, 1):
        rows = sorted((r for r in out if r["page"] == page), key=lambda r: (r["y"], r["x"], r["id"]))
        assert [r["reading_no"] for r in rows] == list(range(1, 101))
        want = [1.0] + [max(1.0, (b["y"] - a["y"]) / max(a["h"], 8)) for a, b in zip(rows, rows[1:])]
        assert [round(r["spacing"], 9) for r in rows] == [round(x, 9) for x in want]


# --- evaluation ---------------------------------------------------------------------------------


def run_of(spark, rows):
    return ev.prepare_run(spark.createDataFrame(rows, "row_id int, user_input string, response string, m string"), ["m"])


def test_win_loss_counts_missing_as_equal(spark):
    p = run_of(spark, [(i, f"q{i}", "p", s) for i, s in enumerate(["0.502", "0.498", "0.5005", "n/a"])])
    b = run_of(spark, [(i, f" q{i} ", "b", "0.5") for i in range(4)])
    pairs = ev.common_questions(p, b, ["m"])
    r = ev.win_loss(ev.differences(pairs, ["m"]), ["m"]).first()
    assert (r["better"], r["worse"], r["equal"], r["pct_improved"]) == (1, 1, 2, 25.0)


def test_first_response_that_is_present(spark):
    run = run_of(spark, [(1, "q", None, "1"), (3, "q", "late", "2"), (2, "q", "early", "nan"), (4, "  ", "x", "1")])
    rows = ev.by_question(run, ["m"]).collect()
    assert [(r["_key"], r["m"], r["response"]) for r in rows] == [("q", 1.5, "early")]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="faithfulness"):
        ev.prepare_run(spark.createDataFrame([("q",)], "user_input string"))


def test_summary_without_common_questions(spark):
    p, b = run_of(spark, [(1, "a", "x", "1")]), run_of(spark, [(1, "b", "x", "2")])
    rows = {r["label"]: (r["n_rows"], r["m"]) for r in ev.summary(p, b, ["m"]).collect()}
    assert rows["mean_common_questions_(avg_of_two)"] == (0, None)


def test_contexts_dedupe_before_the_cut(spark):
    long = "x" * 1300
    rows = [("q", long + "1", 0.9, 1), ("q", long + "2", 0.8, 2), ("q", " a ", 0.1, 3), ("q", "a", 0.7, 4), ("q", "", 1.0, 5)]
    df = spark.createDataFrame(rows, "q string, t string, s double, o int")
    got = [r["context"] for r in ev.select_contexts(df, "q", "t", "s", "o").orderBy("rank").collect()]
    assert got == [long[:1200] + "...", long[:1200] + "...", "a"]


# --- records ------------------------------------------------------------------------------------


def test_tolerant_jsonl(spark):
    lines = ['{"data":{"x":1}}{"data":{"x":2}}', 'junk{"data":{"x":3}}', "{bad", "", '{"error":"e"}', "[1]"]
    got = records.parse_records(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(r[0] for r in got.select(F.try_variant_get("data", "$.x", "int")).collect()) == [1, 3]


def coerce(spark, schema, obj):
    df = spark.createDataFrame([(json.dumps(obj, ensure_ascii=False),)], "j string").select(F.parse_json("j").alias("data"))
    return records.coerce_records(df, schema).first()


def test_every_schema_takes_an_empty_object(spark):
    from folioworks.functions.schemas import SCHEMAS, struct_type

    for name, fields in SCHEMAS.items():
        r = coerce(spark, name, {})
        assert r["record"] is not None
        required = [n for n, kind, _ in fields if kind == "req"]
        assert (r["error"] or "").removeprefix("missing: ").split(", ") == (required or [""])
        assert [f.name for f in struct_type(fields)] == list(r["record"].asDict())


def test_nested_aliases(spark):
    r = coerce(
        spark,
        "EndocrineDisease",
        {"title": "Bướu cổ", "classification": "một", "experience_formulas": {"remedy": "A", "ingredients": "gừng"},
         "patterns": [{"name": "P", "formulas": ["F1", {"name": "F2", "ingredients": [{"herb": "h", "dose": "2g"}], "usage": "uống"}]}, "lẻ"]},
    )["record"]
    assert r["disease_name"] == "Bướu cổ" and r["classification"] == ["một"]
    assert r["experience_formulas"][0]["ingredients"][0]["name"] == "gừng"
    assert [p["pattern_name"] for p in r["patterns"]] == ["P", "lẻ"]
    f1, f2 = r["patterns"][0]["formulas"]
    assert (f1["formula_name"], f2["usage_instructions"], f2["ingredients"][0]["amount"]) == ("F1", "uống", "2g")


def test_a_string_can_be_a_record(spark):
    assert coerce(spark, "EndocrinePatternRecord", " thể A ")["record"]["pattern_name"] == "thể A"
    assert coerce(spark, "EndocrineDisease", "bệnh B")["record"]["disease_name"] == "bệnh B"


def test_emergency_text(spark):
    r = coerce(spark, "EmergencyProtocol", {"condition_name": ["a", " ", "b "], "category": {"x": 1, "y": "p,q:r"}, "medications": 3, "prevention": ["u", "v"]})
    assert r["record"]["condition_name"] == "a, b"
    assert r["record"]["category"] == '{"x": 1, "y": "p,q:r"}'
    assert r["record"]["medications"] == ["3"] and r["record"]["prevention"] == "u; v"


def test_merge_json_right_side_wins(spark):
    df = spark.createDataFrame([('{"a":1,"b":"x"}', '{"b":"y","c":[1,{"d":null}]}')], "l string, r string")
    got = json.loads(df.select(records.merge_json(F.col("l"), F.col("r")).alias("m")).first()["m"])
    assert got == {"a": 1, "b": "y", "c": [1, {"d": None}]}


def test_clean_nested_records(spark):
    df = spark.sql("SELECT named_struct('a', 'x. X. y', 'b', array('p', 'P ', '', 'q'), 'c', array(named_struct('d', 'k\nk')), 'e', 1, 'f', cast(null as string)) AS r")
    r = records.clean_records(df, "r").first()["r"].asDict(recursive=True)
    assert r == {"a": "x. y", "b": ["p", "q"], "c": [{"d": "k"}], "e": 1, "f": None}


def test_extract_slot_keeps_failures_as_rows(spark):
    chunks = spark.createDataFrame([("1", "ok"), ("2", "boom")], "id string, chunk_text string")

    def extractor(text, schema):
        if text == "boom":
            raise ValueError("no luck")
        return json.dumps({"schema": schema, "text": text})

    got = {r["id"]: (r["data"], r["error"]) for r in records.extract(chunks, "RemedyRecipe", extractor).collect()}
    assert got["2"] == (None, "no luck") and json.loads(got["1"][0])["text"] == "ok"
    again = records.pending(chunks, records.extract(chunks, "RemedyRecipe", extractor))
    assert [r["id"] for r in again.collect()] == ["2"]


def test_embed_slot(spark):
    import pandas as pd

    df = spark.createDataFrame([("ab",), ("c",)], "text string")
    out = records.embed(df, lambda s: pd.Series([[3.0 * len(t), 4.0 * len(t)] for t in s])).collect()
    assert all(r["vec"] == [0.6, 0.8] for r in out)


def test_extraction_prompt(spark):
    row = spark.createDataFrame([("văn bản", "source=a")], "t string, h string")
    got = row.select(prompts.extraction_prompt(F.col("t"), F.col("h"), ["a", "b"], "{}").alias("p")).first()["p"]
    assert "văn bản" in got and "(top-level): a, b" in got and got.endswith("Schema JSON:\n{}\n")


def test_chunk_records_by_book(spark):
    body = "nội dung " * 40
    rows = [("raw/cay-canh--cay-thuoc/x.md", f"## 1. CÂY A\n{body}\n## II - X\n### 1. NƯỚC B\n{body}"), ("other.md", " all ")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r["id"]: r["chunk_text"][:12] for r in segment.chunk_records(df, "MedicinalPlant").collect()}
    assert got == {"raw/cay-canh--cay-thuoc/x.md:#0": "## 1. CÂY A\n", "other.md:#0": "all"}
    drinks = segment.chunk_records(df, "RemedyRecipe").where("source_path <> 'other.md'").first()
    assert drinks["chunk_text"].startswith("### 1. NƯỚC B") and drinks["schema_name"] == "RemedyRecipe"


# --- buckets ------------------------------------------------------------------------------------


def test_upsert_last_one_wins(spark):
    old = spark.createDataFrame([("h", "1", "a"), ("h", "2", "b")], "index_type string, id string, text string")
    new = spark.createDataFrame(
        [("h", "2", "x", 1), ("h", "2", "y", 2), ("d", "2", "z", 1)], "index_type string, id string, text string, seq int"
    )
    got = {(r["index_type"], r["id"]): r["text"] for r in store.upsert(old, new).collect()}
    assert got == {("h", "1"): "a", ("h", "2"): "y", ("d", "2"): "z"}


@pytest.mark.parametrize("limit", [256, 0])
def test_vector_size_and_model_are_checked(spark, monkeypatch, limit):
    monkeypatch.setattr(store, "MAX_LITERAL_BUCKETS", limit)
    rows = spark.createDataFrame([("h", "1", [1.0, 2.0])], "index_type string, id string, vec array<double>")
    stats = store.index_stats(rows, model="m1")
    assert store.checked(rows, stats, model="m1").count() == 1
    bad = rows.withColumn("vec", F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="vector size differs"):
        store.checked(bad, stats).collect()
    with pytest.raises(Exception, match="model differs"):
        store.checked(rows, stats, model="m2").collect()
    other = rows.withColumn("index_type", F.lit("new")).withColumn("vec", F.array(F.lit(1.0)))
    assert store.checked(other, stats, model="m2").collect()[0]["vec"] == [1.0]


def test_union_outputs(spark):
    a = spark.createDataFrame([("1",)], "id string")
    b = spark.createDataFrame([("2", "x")], "id string, error string")
    out = store.union_outputs({"herbs": [a, b], "emergency": [b]}).collect()
    assert sorted((r["index_type"], r["id"]) for r in out) == [("emergency", "2"), ("herbs", "1"), ("herbs", "2")]
    name = spark.createDataFrame([("herbs_plants",), ("remedies",)], "n string").select(store.bucket_name(F.col("n")).alias("b"))
    assert [r["b"] for r in name.collect()] == ["herbs", "remedies"]


# --- sources and sinks --------------------------------------------------------------------------


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_markdown_files(spark, folder):
    put(folder, "b/one book.md", "một\nhai")
    put(folder, "a.md", "x")
    put(folder, "a.txt", "no")
    got = {os.path.relpath(r["path"], folder): r["text"] for r in files.read_markdown(spark, folder).collect()}
    assert got == {"b/one book.md": "một\nhai", "a.md": "x"}
    assert files.read_markdown(spark, os.path.join(folder, "a.md")).count() == 1
    assert sorted(r["name"] for r in files.list_files(spark, folder, "*.md").collect()) == ["a.md", "one book.md"]


def test_records_round_trip(spark, folder):
    out = spark.createDataFrame(
        [("a.md:#0", "a.md", '{"recipe_name":"R","source_plant":"S","usage_instructions":"U","ingredients":"gừng"}', None),
         ("a.md:#1", "a.md", None, "boom")],
        "id string, source_path string, data string, error string",
    )
    sinks.write_extraction(out, folder + "/x")
    good = files.read_records(spark, folder + "/x/status=ok", schema="RemedyRecipe", index_type="remedies").collect()
    assert len(good) == 1 and good[0]["id"] == "a.md:#0"
    assert good[0]["text"].startswith("Recipe: R\nSource plant: S\nIngredients: gừng\nPreparation:")
    assert json.loads(good[0]["metadata"])["index_type"] == "remedies"
    assert spark.read.text(folder + "/x/status=error").count() == 1


def test_questions_csv(spark, folder):
    path = put(folder, "t.csv", '﻿id,Độ khó,Câu hỏi,Đáp án\n2,Khó,"a, ""b""\nc", x \n1,,q,y\n3,Dễ, ,z\n')
    got = files.read_questions(spark, path).orderBy("id").collect()
    assert [(r["id"], r["difficulty"], r["question"], r["ground_truth"]) for r in got] == [
        (1, "Unknown", "q", "y"), (2, "Khó", 'a, "b"\nc', "x")]
    assert files.read_questions(spark, path, limit=1).count() == 1
    assert files.read_questions(spark, path, keep_blank=True).count() == 3
    with pytest.raises(ValueError):
        files.read_questions(spark, put(folder, "u.csv", "a,b\n1,2\n"))


def test_scores_csv(spark, folder):
    head = "user_input,response," + ",".join(fv.SCORE_METRICS)
    path = put(folder, "s.csv", f"{head}\nq,r,0.5,bad,,nan\n ,r,1,1,1,1\n")
    rows = files.read_scores(spark, path).collect()
    assert [[r[m] for m in fv.SCORE_METRICS] for r in rows] == [[0.5, None, None, None]]


def test_ocr_json(spark, folder):
    doc = {"pages": [{"page_num": 2, "results": [{"element_type": "heading", "text": "A", "box": [[1, 2], [5, 2], [5, 10], [1, 10]]}]}, {"results": [{"text": "b"}]}]}
    put(folder, "sach.json", json.dumps(doc))
    items = files.item_box(ocr.items_of_results(files.read_ocr_results(spark, folder))).orderBy("page_no").collect()
    assert [(r["doc"], r["page_num"], r["text"], r["y"], r["height"]) for r in items] == [("sach", 2, "A", 6.0, 8.0), ("sach", 1, "b", 0.0, 0.0)]


def test_buckets_on_disk(spark, folder):
    rows = spark.createDataFrame([("h", "1", [1.0]), ("d", "2", [1.0, 2.0])], "index_type string, id string, vec array<double>")
    sinks.write_buckets(rows, folder + "/b")
    sinks.write_buckets(rows.where("index_type = 'h'").withColumn("id", F.lit("9")), folder + "/b")
    assert {r["id"] for r in files.read_bucket(spark, folder + "/b").collect()} == {"9", "2"}
    one = files.read_bucket(spark, folder + "/b", "d", dim=2)
    assert one.count() == 1 and "PartitionFilters: [isnotnull(index_type" in one._jdf.queryExecution().executedPlan().toString()


def test_images_on_disk(spark, folder):
    for name, data in [("extracted_images/a.png", b"AA"), ("extracted_images/copy.png", b"AA"), ("b.jpg", b"BBB")]:
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
    cat = files.read_images(spark, folder)
    assert cat.count() == 3
    kept = im.dedupe(cat)
    assert kept.count() == 2
    a = kept.where("byte_size = 2").first()
    assert a["source_filename"] == "a.png" and a["mime_type"] == "image/png" and len(a["id"]) == 64
    assert files.find_image(kept, a["id"]).count() == 1
    assert im.insert_new(kept, cat).count() == 0
    refs = spark.createDataFrame([("c", f"{folder}/x.md", 0, "a.png"), ("c", f"{folder}/x.md", 1, "b.jpg"), ("c", f"{folder}/x.md", 2, "no.png")], "id string, path string, line_no int, source_filename string")
    recs = spark.createDataFrame([("c",), ("d",)], "id string")
    got = {r["id"]: r["images"] for r in im.attach_images(recs, refs, files.list_files(spark, folder)).collect()}
    assert got == {"c": [f"{folder}/extracted_images/a.png", f"{folder}/b.jpg"], "d": []}
    found = spark.createDataFrame([("q", 1, a["id"]), ("q", 2, a["id"])], "question string, pos int, image string")
    block = im.images_block(im.answer_images(found, kept, "question", "pos", "image"), "question").first()["images"]
    assert block == "Hình ảnh:\n![a.png](data:image/png;base64,QUE=)"
    assert im.answer_images(found, kept, "question", "pos", "image", max_bytes=1).count() == 0


def test_dataset_sinks(spark, folder):
    entries = ocr.section_entries(ocr.sections(ocr_items(spark), ["page_num", "item_no"]))
    sinks.write_dataset(ocr.dataset_totals(entries), entries, folder + "/ds")
    sinks.write_passages(ocr.qa_passages(entries), folder + "/qa")
    sinks.write_retrieval_docs(ocr.retrieval_docs(entries), folder + "/rd")
    assert spark.read.json(folder + "/ds/metadata").first()["total_sections"] == 2
    assert {r["passage_id"] for r in spark.read.json(folder + "/qa").collect()} == {"section_001_chunk_0", "section_002_chunk_0"}
    assert spark.read.json(folder + "/rd").count() == 2


def test_one_document_is_written_by_several_tasks(spark, folder):
    hot = spark.range(4000).selectExpr("if(id % 3 = 0, 'hot', concat('d', id)) AS doc", "id AS passage_id", "repeat('x', 20) AS text")
    with session_settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        sinks.write_passages(hot.repartition(4), folder + "/hot")
    back = spark.read.json(folder + "/hot").withColumn("file", F.col("_metadata.file_path"))
    assert back.count() == 4000 and back.where("doc = 'hot'").select("file").distinct().count() > 1


def test_metrics_sinks(spark, folder):
    one = spark.createDataFrame([(5,)], "size_bytes bigint")
    texts = spark.createDataFrame([(2, 3, 7)], "lines bigint, samples bigint, size_bytes bigint")
    runs = spark.sql("SELECT timestamp '2024-01-01 00:00:00' AS ts UNION ALL SELECT timestamp '2024-01-01 00:00:02.5'")
    sinks.write_metrics(metrics.pipeline_totals(one, one, texts, runs), folder + "/m")
    r = sinks.read_metrics(spark, folder + "/m").first()
    assert (r["num_files"], r["output_size_bytes"], r["processing_time_seconds"]) == (1, 12, 2.5)
    sinks.write_image_index(spark.createDataFrame([("s", "i", "p/q.png")], "source string, id string, path string"), folder + "/i")
    assert spark.read.json(folder + "/i").first()["filename"] == "q.png"
    sinks.write_scores(spark.createDataFrame([('a "b", c', 1.0)], "q string, s double"), folder + "/s")
    back = spark.read.option("header", "true").option("escape", '"').csv(folder + "/s").first()
    assert back["q"] == 'a "b", c'


# --- streams ------------------------------------------------------------------------------------


def record_line(ident, name):
    data = {"recipe_name": name, "source_plant": "s", "usage_instructions": "u"}
    return json.dumps({"data": data, "meta": {"id": ident, "source_path": "p"}})


def test_stream_ingest_equals_batch(spark, folder):
    src, out, ck = folder + "/in", folder + "/store", folder + "/ck"
    put(src, "1.jsonl", record_line("a", "old") + "\n{bad\n" + record_line("b", "b1") + "\n")
    q = ingest.ingest_records(spark, src, out, ck, "remedies", "RemedyRecipe", files_per_trigger=1)
    q.awaitTermination()
    put(src, "2.jsonl", record_line("a", "new") + "\n" + json.dumps({"error": "x", "meta": {"id": "z"}}) + "\n")
    put(src, "3.jsonl", record_line("c", "c1") + "\n")
    os.utime(src + "/2.jsonl", (2_000_000_000, 2_000_000_000))
    ingest.ingest_records(spark, src, out, ck, "remedies", "RemedyRecipe", files_per_trigger=1).awaitTermination()
    got = {r["id"]: r["text"].split("\n")[0] for r in ingest.read_bucket_store(spark, out).collect()}
    assert got == {"a": "Recipe: new", "b": "Recipe: b1", "c": "Recipe: c1"}
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) == 3


def test_failed_chunks_are_tried_again(spark, folder):
    src, out = folder + "/in", folder + "/out"

    def run(n, lines, extractor):
        put(src, f"{n}.json", "\n".join(json.dumps({"id": i, "chunk_text": i}) for i in lines) + "\n")
        chunks = spark.readStream.schema("id string, chunk_text string").json(src)
        ingest.extract_pending(chunks, out, folder + "/ck", "RemedyRecipe", extractor).awaitTermination()

    def fails_on_two(text, schema):
        if text == "2":
            raise ValueError("no")
        return "{}"

    run(1, ["1", "2", "2"], fails_on_two)
    run(2, ["3"], fails_on_two)  # 2 isn't in the input again, and fails again
    run(3, ["2", "1"], lambda text, schema: "{}")
    got = sorted((r["id"], r["batch"], r["data"] is not None) for r in ingest.read_batches(spark, out).collect())
    assert got == [("1", 0, True), ("2", 0, False), ("2", 1, False), ("2", 2, True), ("3", 1, True)]


def test_invalid_records_stay(spark, folder):
    lines = [
        {"data": {"recipe_name": "R", "odd": None, "n": 5}, "meta": {"id": "a"}},
        {"data": {"source_plant": "S"}, "meta": {"id": "b"}},
        {"data": {"recipe_name": "R"}},
    ]
    path = put(folder, "r.jsonl", "\n".join(map(json.dumps, lines)) + "\n{bad\n")
    rows = {r["id"]: r for r in files.read_records(spark, path, schema="RemedyRecipe", index_type="remedies").collect()}
    assert sorted(rows) == ["a", "b"] and rows["b"]["error"]
    assert json.loads(rows["a"]["metadata"]) == {"id": "a", "recipe_name": "R", "odd": None, "n": 5, "index_type": "remedies"}


def test_content_ids_show_values_as_literals(spark):
    import hashlib

    values = ["it's", 'a "b"', "both ' and \"", "t\tn\n\\", "\x01\xa0é", 5, -1.5, 2.0, True, None, ["x", 1, None], {"k": "v"}]
    rows = [(f"t{i}", json.dumps({"z": v, "a'": "x"})) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "t string, m string")
    ids = df.select("t", stable_id(F.col("t"), F.from_json("m", "map<string,variant>")).alias("id")).collect()
    for r, (t, m) in zip(ids, rows):
        blob = t + "\n" + str(sorted(json.loads(m).items()))
        assert r["id"] == hashlib.sha1(blob.encode()).hexdigest()


def test_check_of_vectors_is_never_left_out(spark):
    rows = spark.createDataFrame([("b", 1, [1.0, 2.0])], "index_type string, id int, vec array<double>")
    stats = spark.createDataFrame([("b", 3, None)], "index_type string, dim int, model string")
    with pytest.raises(Exception, match="vector size"):
        store.checked(rows, stats).select("id").collect()


def test_long_groups_are_cut_by_rank(spark):
    from folioworks.operators import scan

    rows = [(1, 0 if i else 10**9, i) for i in range(3000)] + [(2, 5, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, page long, i long")
    blocks = scan.with_blocks(df, ["k"], ["page", "i"], rows_per_block=300)
    sizes = [r["count"] for r in blocks.groupBy("k", "_block").count().collect()]
    assert max(sizes) <= 900 and len(sizes) >= 5
    got = scan.ordered_scan(df, ["k"], ["page", "i"], {"n": F.lit(1)}, {"before": "i"}, rows_per_block=300)
    want = scan.ordered_scan(df, ["k"], ["page", "i"], {"n": F.lit(1)}, {"before": "i"}, rows_per_block=None)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stream_extraction_resumes(spark, folder):
    src, out = folder + "/in", folder + "/out"
    seen = []

    def chunks():
        return spark.readStream.schema("id string, chunk_text string").json(src)

    put(src, "1.json", '{"id":"1","chunk_text":"a"}\n{"id":"1","chunk_text":"a"}\n{"id":"2","chunk_text":"b"}\n')
    ingest.extract_pending(chunks(), out, folder + "/ck", "RemedyRecipe").awaitTermination()
    put(src, "2.json", '{"id":"2","chunk_text":"b"}\n{"id":"3","chunk_text":"c"}\n')
    ingest.extract_pending(chunks(), out, folder + "/ck", "RemedyRecipe").awaitTermination()
    seen = sorted(r["id"] for r in ingest.read_batches(spark, out).collect())
    assert seen == ["1", "2", "3"]


def test_stream_results_are_appended(spark, folder):
    put(folder + "/in", "1.json", '{"q":"a","s":1.0}\n')
    for n in (2, 3):
        rows = spark.readStream.schema("q string, s double").json(folder + "/in")
        ingest.save_results(rows, folder + "/res", folder + "/ck").awaitTermination()
        put(folder + "/in", f"{n}.json", '{"q":"b","s":2.0}\n')
    assert spark.read.option("header", "true").csv(folder + "/res").count() == 2


# --- pipelines ----------------------------------------------------------------------------------


def test_postprocess(spark):
    df = spark.createDataFrame([("#A\nl à\n[IMAGE_PLACEHOLDER_1]", ["k"])], "text string, ids array<string>")
    got = pipelines.postprocess_markdown(df, images="ids").first()["text"]
    assert got == "# A\nlà\n![id: k](k.png)"


def test_documents_to_prompts(spark):
    body = "nội dung " * 60
    docs = spark.createDataFrame(
        [("raw/cay-canh--cay-thuoc/x.md", f"## 1. CÂY ỔI\n{body}\n## 2. CÂY MƠ\n{body}")], "path string, text string"
    )

    def extractor(text, schema):
        name = text.split("\n")[0].removeprefix("## ")
        return json.dumps({"plant_name": name, "family": "Họ", "other_names": ["a", "A", "b"]}, ensure_ascii=False)

    out = pipelines.extract_documents(docs, "MedicinalPlant", extractor)
    vec = F.when(F.contains("text", F.lit("ỔI")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    rows = pipelines.bucket_rows(out, "MedicinalPlant", "herbs", lambda _: vec)
    texts = {r["id"]: r["text"] for r in rows.collect()}
    # The heading's number is not part of what the extractor sees.
    assert texts["raw/cay-canh--cay-thuoc/x.md:#0"] == "Tên cây: CÂY ỔI\nTên gọi khác: a, b\nHọ: Họ"
    again = pipelines.extract_documents(docs, "MedicinalPlant", extractor, done=out.where("id LIKE '%#1'"))
    assert [r["id"] for r in again.collect()] == ["raw/cay-canh--cay-thuoc/x.md:#0"]

    routes = spark.createDataFrame([("herbs", True, [1.0, 0.0]), ("emergency", False, [0.0, -1.0])], "index_type string, boosted boolean, vec array<double>")
    asked = spark.createDataFrame([(1, "cây ổi?", [0.9, 0.1]), (2, "rắn?", [0.0, -1.0])], "question_id int, question string, vec array<double>")
    got = {r["question_id"]: r for r in pipelines.answer_prompts(asked, routes, rows, {"herbs": 1}).collect()}
    assert got[1]["context"].startswith("#1 id=raw/cay-canh--cay-thuoc/x.md:#0 source=raw/cay-canh--cay-thuoc/x.md score=0.9000\nfamily: Họ\nother_names: a, b\nTên cây")
    assert "CÂU HỎI: cây ổi?" in got[1]["prompt"]
    assert got[2]["prompt"] == fv.NO_CONTEXT_ANSWER


def test_exports_and_comparison(spark):
    out = pipelines.dataset_exports(ocr_items(spark), ["page_num", "item_no"])
    assert {k: v.count() for k, v in out.items()} == {"metadata": 1, "sections": 2, "passages": 2, "documents": 2}
    p = run_of(spark, [(1, "a", "x", "1"), (2, "b", "y", "0")])
    b = run_of(spark, [(1, "a", "x", "0"), (2, "b", "y", "1")])
    got = pipelines.compare_runs(p, b, ["m"])
    assert got["examples"].where("side = 'best'").first()["user_input"] == "a"
    answers = spark.createDataFrame([(1, "q", "![a](b) đáp", "g"), (2, "r", "x", "h")], "question_id int, question string, answer string, ground_truth string")
    found = spark.createDataFrame([(1, "hai", 0.1, 1), (1, "một", 0.9, 2)], "question_id int, content string, score double, pos int")
    recs = {r["question_id"]: r for r in pipelines.evaluation_records(answers, found).collect()}
    assert recs[1]["contexts"] == ["một", "hai"] and recs[1]["answer"] == "đáp" and recs[2]["contexts"] == []


def test_ids_from_content(spark):
    df = spark.sql("SELECT CAST(NULL AS STRING) AS id, 't' AS text, map('b', 'x', 'a', 'y') AS metadata UNION ALL SELECT 'own', 't', map('a', 'y')")
    import hashlib

    want = hashlib.sha1("t\n[('a', 'y'), ('b', 'x')]".encode()).hexdigest()
    assert {r["id"] for r in store.with_ids(df).collect()} == {"own", want}


def test_registries(spark):
    from folioworks.functions import schemas, splitters, templates

    splitters.register_splitter("pages", lambda t: F.split(t, "---"), "my-book")
    schemas.register_schema("Note", (("title", "req", ()), ("tags", "strings", ())))
    templates.register_template("notes", lambda get: F.concat(F.lit("Note: "), get("title"), F.lit(" / "), get("tags")))
    try:
        df = spark.createDataFrame([("x/my-book/1.md", "a---b")], "path string, text string")
        assert [r["chunk_text"] for r in segment.chunk_records(df).collect()] == ["a", "b"]
        r = spark.createDataFrame([('{"title":"T","tags":"u"}',)], "j string").select(F.parse_json("j").alias("data"), F.parse_json(F.lit("{}")).alias("meta"), F.lit("1").alias("id"))
        rows = records.retrieval_records(records.coerce_records(r, "Note"), "notes")
        assert rows.first()["text"] == "Note: T / u"
        other = records.retrieval_records(records.coerce_records(r, "Note"), "unknown")
        assert json.loads(other.first()["text"]) == {"title": "T", "tags": ["u"]}
    finally:
        splitters.EXTRA_PATHS.clear()
        del splitters.SPLITTERS["pages"], schemas.SCHEMAS["Note"], templates.TEMPLATES["notes"]


def test_shared_folder_comes_from_the_session(spark):
    from folioworks import session

    class Conf:
        def get(self, key, default=None):
            return "hdfs://shared/ck/" if key == "spark.checkpoint.dir" else default

    class Fake:
        conf = Conf()

    assert session.shared_dir(Fake()) == "hdfs://shared/ck"


def test_wrapper_documents(spark):
    doc = {"plants": [{"plant_name": "A"}, {"plant_name": "B"}], "recipes": None}
    df = spark.createDataFrame([("1", json.dumps(doc))], "id string, j string").select("id", F.parse_json("j").alias("data"))
    rows = records.explode_wrapper(df, "DocumentContent")
    got = [(r["schema"], r["record"]["plant_name"]) for r in records.coerce_records(rows, "MedicinalPlant").collect()]
    assert got == [("MedicinalPlant", "A"), ("MedicinalPlant", "B")]


def test_page_layout(spark, folder):
    box = [[1, 2], [5, 2], [5, 10], [1, 10]]
    low = [[0, 40], [5, 40], [5, 50], [0, 50]]
    doc = {"pages": [{"page_num": 1, "results": [
        {"element_type": "paragraph", "text": "sau", "box": low}, {"element_type": "heading", "text": "trước", "box": box},
        {"element_type": "image", "text": "x", "box": box}, {"text": "chân trang", "skip": True, "box": low}]}]}
    put(folder, "s.json", json.dumps(doc))
    items = files.item_box(ocr.items_of_results(files.read_ocr_results(spark, folder)))
    got = [(r["reading_no"], r["text"], r["spacing"]) for r in ocr.page_layout(items).orderBy("reading_no").collect()]
    assert got == [(1, "trước", 1.0), (2, "sau", (45 - 6) / 8)]


def test_images_that_exist(spark):
    docs = spark.createDataFrame([("b/x.md", "a ![k](img/k.png)\n<img src='/abs/z.gif'>\n![q](no.jpg) ![h](http://h/k.png)")], "path string, text string")
    known = spark.createDataFrame([("b/extracted_images/k.png",), ("/abs/z.gif",)], "path string")
    found = im.existing_images(im.local_images(docs, "path"), known)
    cited = spark.createDataFrame([("b/x.md", 1), ("b/x.md", 60)], "path string, line int")
    got = [(r["line"], r["rank"], r["url"]) for r in im.images_near_line(cited, found, "path", "line").orderBy("line", "rank").collect()]
    assert got == [(1, 1, "b/extracted_images/k.png"), (1, 2, "/abs/z.gif")]


def test_small_blocks_need_no_range_each(spark, monkeypatch):
    from folioworks.operators import scan

    monkeypatch.setattr(scan, "RANGES", 4)
    rows = [(1, 0 if i % 3 else 10**9, i) for i in range(3000)] + [(2, 5, i) for i in range(50)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k int, page long, i long").repartition(5)
    blocks = scan.with_blocks(df, ["k"], ["page", "i"], rows_per_block=20)
    assert blocks.rdd.getNumPartitions() <= 4
    sizes = [r["count"] for r in blocks.groupBy("k", "_block").count().collect()]
    assert max(sizes) <= 20 and len(sizes) >= 150
    how = ["k"], ["page", "i"], {"n": F.col("i")}, {"before": "i"}
    climbs = {"at": (F.col("i"), F.lit(7).cast("long"))}
    got = scan.ordered_scan(df, *how, 20, climbs).collect()
    assert sorted(map(str, got)) == sorted(map(str, scan.ordered_scan(df, *how, None, climbs).collect()))


def test_scores_of_a_block_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    questions, vectors = rng.normal(size=(2000, 16)), rng.normal(size=(6000, 16))
    run = search._Running(np.arange(2000), questions, 4, 6)
    tracemalloc.start()
    run.add(vectors, np.arange(6000))
    place, ids, scores = run.columns()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    want = np.sort(np.round(questions @ vectors.T, 6), axis=1)[:, :-5:-1]
    assert np.array_equal(place, np.repeat(np.arange(2000), 4)) and np.allclose(scores.reshape(-1, 4), want, atol=2e-6)
