"""Record and bucket queries. Records are JSON texts made from events and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioworks.functions import schemas as sc
from folioworks.functions import templates as tp
from folioworks.functions.table_functions import register_splitter_function
from folioworks.functions.vectors import as_doubles
from folioworks.operators import evaluation, records, store
from folioworks.operators.bucket_table import BucketTable
from folioworks.plans.book_queries import WS
from folioworks.plans.document_queries import first_of_each_sql, spaces_sql
from folioworks.plans.registry import query, spread, table
from folioworks.session import shared_dir

# --- JSONL --------------------------------------------------------------------------------------

_OBJECT = (
    "'{\"data\": ' || props || ', \"meta\": {\"source_path\": \"' || event_type || '.md\", ' ||"
    " CASE WHEN event_id % 2 = 0 THEN '\"id\": \"e' || CAST(event_id AS STRING) || '\"' ELSE '\"chunk_index\": ' || CAST(event_id AS STRING) END || '}}'"
)
_LINE = (
    f"CASE event_id % 7 WHEN 0 THEN {_OBJECT} WHEN 1 THEN {_OBJECT} || {_OBJECT} WHEN 2 THEN 'rác ' || {_OBJECT}"
    " WHEN 3 THEN '{bad' WHEN 4 THEN '   ' WHEN 5 THEN '{\"error\": \"x\", \"meta\": {\"id\": \"z\"}}' ELSE '  ' || " + _OBJECT + " || '  ' END"
)


@query(
    "jsonl_records",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_id % 2 = 0 THEN 'e' || event_id ELSE event_type || '.md:#' || event_id END AS id
FROM events WHERE event_id % 7 IN (0, 1, 2, 6)""",
)
def jsonl_records(spark, sf_dir):
    lines = spread(table(spark, sf_dir, "events")).selectExpr("event_id", f"{_LINE} AS value")
    parsed = records.parse_records(lines)
    return parsed.select("event_id", F.try_variant_get("data", "$.k", "bigint").alias("k"), "id")


# --- coercion -----------------------------------------------------------------------------------

_PROTOCOL = (
    "'{\"condition_name\": ' || CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN '\"Rắn cắn\"' WHEN 2 THEN '[\"a\", \" b \", \"\"]' WHEN 3 THEN '5' ELSE props END"
    " || ', \"clinical_signs\": ' || CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN '[\"sốt\", \"ho\"]' WHEN 2 THEN '\"  sốt \"' WHEN 3 THEN '\"  \"' WHEN 4 THEN props ELSE '7' END"
    " || ', \"specific_antidote\": ' || CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '[\"x\", \"y \"]' WHEN 2 THEN '\"' || event_type || '\"' ELSE props END"
    " || CASE WHEN event_id % 3 = 0 THEN '' ELSE ', \"category\": \"Sơ cứu\"' END || '}'"
)
_PROPS = "'{\"k\": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}'"


@query(
    "coerce_records",
    f"""SELECT event_id,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Rắn cắn' WHEN 2 THEN 'a, b' WHEN 3 THEN '5' ELSE {_PROPS} END AS condition_name,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Sơ cứu' END AS category,
  CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'sốt|ho' WHEN 2 THEN 'sốt' WHEN 3 THEN '' WHEN 4 THEN {_PROPS} ELSE '7' END AS clinical_signs,
  CAST(CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS BIGINT) AS n_signs,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x; y' WHEN 2 THEN event_type ELSE {_PROPS} END AS specific_antidote FROM events""",
)
def coerce_records(spark, sf_dir):
    raw = spread(table(spark, sf_dir, "events")).selectExpr("event_id", f"try_parse_json({_PROTOCOL}) AS data")
    r = records.coerce_records(raw, "EmergencyProtocol")
    return r.select(
        "event_id", "record.condition_name", "record.category",
        F.array_join("record.clinical_signs", "|").alias("clinical_signs"),
        F.size("record.clinical_signs").alias("n_signs"), "record.specific_antidote",
    )


_PLANT = (
    "'{' || CASE WHEN event_id % 9 = 0 THEN '' ELSE '\"plant_name\": \"' || event_type || '\", ' END"
    " || '\"treats\": ' || CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '\" ho gà \"' WHEN 2 THEN '[\"a\", \"b\"]' ELSE '\"\"' END"
    " || ', ' || CASE event_id % 3 WHEN 0 THEN '\"botanical_features\": \"lá\", \"botanical_description\": \"thân\"' WHEN 1 THEN '\"botanical_features\": null, \"botanical_description\": \"thân\"' ELSE '\"other\": 1' END"
    " || CASE WHEN event_id % 2 = 0 THEN ', \"properties\": \"cay\"' ELSE ', \"properties_and_dosage\": \"ấm\"' END"
    " || ', \"parts_used\": ' || CASE WHEN event_id % 5 = 0 THEN '{\"part\": \"lá\"}' ELSE '[{\"part\": \"rễ\", \"usage_description\": \"sắc\"}, {\"part\": \"hạt\"}]' END"
    " || ', \"therapeutic_applications\": [{\"indication\": [\"ho\", \" sốt\"], \"ingredients\": [\"x\", \"y\"]}, \"rác\", {\"indication\": null}, {\"indication\": \" \"}]}'"
)


@query(
    "coerce_plants",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'missing: plant_name' END AS error,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS plant_name,
  CASE event_id % 4 WHEN 1 THEN 'ho gà' WHEN 2 THEN 'a|b' ELSE '' END AS treats,
  CASE event_id % 3 WHEN 0 THEN 'lá' WHEN 1 THEN 'thân' END AS botanical_features,
  CASE WHEN event_id % 2 = 0 THEN 'cay' ELSE 'ấm' END AS properties, CASE WHEN event_id % 2 = 0 THEN 'cay' ELSE 'ấm' END AS properties_and_dosage,
  CASE WHEN event_id % 5 = 0 THEN 'lá' ELSE 'rễ sắc|hạt' END AS parts_used, 'ho, sốt:x, y:' AS applications FROM events""",
)
def coerce_plants(spark, sf_dir):
    raw = spread(table(spark, sf_dir, "events")).selectExpr("event_id", f"try_parse_json({_PLANT}) AS data")
    r = records.coerce_records(raw, "MedicinalPlant")
    return r.select(
        "event_id", "error", "record.plant_name", F.array_join("record.treats", "|").alias("treats"),
        "record.botanical_features", "record.properties", "record.properties_and_dosage",
        F.array_join(
            F.transform("record.parts_used", lambda p: F.concat_ws(" ", p["part"], p["usage_description"])), "|"
        ).alias("parts_used"),
        F.array_join(
            F.transform(
                "record.therapeutic_applications",
                lambda a: F.concat_ws(":", a["indication"], a["ingredients"], a["usage_instructions"]),
            ),
            "|",
        ).alias("applications"),
    )


# --- cleaning -----------------------------------------------------------------------------------

_NESTED = """SELECT doc_id, named_struct('text', text, 'items', split(text, ','), 'parts', array(named_struct('note', text || ' ' || text))) AS record FROM {documents}"""


def _clean_sql(expr: str, out: str) -> str:
    """CTEs cleaning a text column: repeated lines, then repeated sentences."""
    cut = f"string_split(regexp_replace({spaces_sql('t')}, '([.!?。؛;])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"""{out}_l AS (SELECT doc_id, unnest(string_split({expr}, chr(10))) AS line, unnest(range(len(string_split({expr}, chr(10))))) AS i FROM documents),
{out}_p AS (SELECT *, lag(trim(line, {WS})) OVER (PARTITION BY doc_id ORDER BY i) AS above FROM {out}_l),
{out}_d AS (SELECT doc_id, trim(string_agg(rtrim(line, {WS}), chr(10) ORDER BY i), {WS}) AS t FROM {out}_p WHERE above IS NULL OR above <> trim(line, {WS}) GROUP BY doc_id),
{out}_s AS (SELECT doc_id, unnest({cut}) AS item, unnest(range(len({cut}))) AS k FROM {out}_d),
{first_of_each_sql(out + '_s').replace('n AS (', out + '_n AS (').replace('r AS (', out + '_r AS (', 1).replace('FROM n WHERE', f'FROM {out}_n WHERE').replace('firsts AS (', out + ' AS (').replace('FROM r WHERE', f'FROM {out}_r WHERE')}"""


@query(
    "clean_records",
    f"""WITH {_clean_sql('text', 'a')}, {_clean_sql("(text || ' ' || text)", 'b')},
items AS (SELECT doc_id, unnest(string_split(text, ',')) AS item, unnest(range(len(string_split(text, ',')))) AS k FROM documents),
{first_of_each_sql('items', "'|'")}
SELECT d.doc_id, coalesce(a.t, '') AS text, coalesce(f.t, '') AS items, coalesce(b.t, '') AS note FROM documents d
LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN firsts f ON f.doc_id = d.doc_id""",
)
def clean_records(spark, sf_dir):
    nested = spark.sql(_NESTED, documents=spread(table(spark, sf_dir, "documents")))
    out = records.clean_records(nested, "record")
    return out.select(
        "doc_id", "record.text", F.array_join("record.items", "|").alias("items"),
        F.expr("record.parts[0].note").alias("note"),
    )


# --- retrieval text -----------------------------------------------------------------------------


@query(
    "format_text",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'Tên cây: ' || event_type || chr(10) END
  || CASE WHEN event_id % 3 = 2 THEN '' ELSE 'Đặc điểm thực vật: ' || CASE event_id % 3 WHEN 0 THEN 'lá' ELSE 'thân' END || chr(10) END
  || 'Tính vị/Công năng/Liều dùng: ' || CASE WHEN event_id % 2 = 0 THEN 'cay' ELSE 'ấm' END || chr(10)
  || 'Bộ phận dùng:' || chr(10) || CASE WHEN event_id % 5 = 0 THEN '- lá' ELSE '- rễ: sắc' || chr(10) || '- hạt' END
  || CASE event_id % 4 WHEN 1 THEN chr(10) || 'Chỉ định/Trị: ho gà' WHEN 2 THEN chr(10) || 'Chỉ định/Trị: a, b' ELSE '' END
  || chr(10) || 'Ứng dụng cụ thể:' || chr(10) || '- Chỉ định: ho, sốt | Thành phần: x, y' AS text FROM events""",
)
def format_text(spark, sf_dir):
    raw = spread(table(spark, sf_dir, "events")).selectExpr("event_id", f"try_parse_json({_PLANT}) AS data")
    r = records.coerce_records(raw, "MedicinalPlant")
    text = tp.retrieval_text(F.col("record"), r.schema["record"].dataType, "herbs")
    return r.select("event_id", text.alias("text"))


_DISEASE = (
    "'{\"disease\": \"' || event_type || '\", \"overview\": ' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '\"chung\"' END"
    " || ', \"classification\": ' || CASE event_id % 3 WHEN 0 THEN '\"một\"' WHEN 1 THEN '[\"một\", \"hai\"]' ELSE 'null' END"
    " || ', \"patterns\": ' || CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '{\"syndrome_name\": \"thể A\", \"formulas\": \"thang X\"}'"
    " WHEN 2 THEN '[{\"pattern_name\": \"thể B\", \"symptoms\": \"sốt\", \"formulas\": [{\"name\": \"thang Y\"}, \"thang Z\"]}, \"thể C\"]' ELSE '[]' END"
    " || ', \"experience_formulas\": ' || CASE WHEN event_id % 5 = 0 THEN '{\"remedy\": \"gia truyền\"}' ELSE '[]' END || '}'"
)


@query(
    "format_disease_text",
    """SELECT event_id, 'Endocrine topic: ' || event_type || CASE WHEN event_id % 2 = 0 THEN '' ELSE chr(10) || 'Overview: chung' END
  || CASE event_id % 3 WHEN 0 THEN chr(10) || 'Classification: một' WHEN 1 THEN chr(10) || 'Classification: một, hai' ELSE '' END
  || CASE event_id % 4 WHEN 1 THEN chr(10) || 'Patterns:' || chr(10) || ' - Pattern: thể A | Formulas: thang X'
     WHEN 2 THEN chr(10) || 'Patterns:' || chr(10) || ' - Pattern: thể B | Symptoms: sốt | Formulas: thang Y, thang Z' || chr(10) || ' - Pattern: thể C' ELSE '' END
  || CASE WHEN event_id % 5 = 0 THEN chr(10) || 'Experience formulas: gia truyền' ELSE '' END AS text FROM events""",
)
def format_disease_text(spark, sf_dir):
    raw = spread(table(spark, sf_dir, "events")).selectExpr("event_id", f"try_parse_json({_DISEASE}) AS data")
    r = records.coerce_records(raw, "EndocrineDisease")
    text = tp.retrieval_text(F.col("record"), r.schema["record"].dataType, "diseases")
    return r.select("event_id", text.alias("text"))


@query(
    "placeholder_records",
    f"SELECT doc_id, left(trim(text, {WS}), 200) AS recipe_name, left(trim(text, {WS}), 200) AS usage_instructions, CAST(0 AS BIGINT) AS n_ingredients FROM documents",
)
def placeholder_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    r = docs.select("doc_id", sc.placeholder(F.col("text"), "RemedyRecipe").alias("r"))
    return r.select("doc_id", "r.recipe_name", "r.usage_instructions", F.size("r.ingredients").alias("n_ingredients"))


# --- buckets ------------------------------------------------------------------------------------

_FEEDS = {
    "click": ["herbs"], "view": ["herbs"], "signup": ["diseases"], "purchase": ["remedies"],
    "error": ["diseases", "emergency"],
}


@query(
    "bucket_union",
    """SELECT event_id, value, 'herbs' AS index_type FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT event_id, value, 'diseases' FROM events WHERE event_type IN ('signup', 'error')
UNION ALL SELECT event_id, value, 'remedies' FROM events WHERE event_type = 'purchase'
UNION ALL SELECT event_id, value, 'emergency' FROM events WHERE event_type = 'error'""",
)
def bucket_union(spark, sf_dir):
    fed = store.fan_out(table(spark, sf_dir, "events"), "event_type", _FEEDS)
    return fed.select("event_id", "value", "index_type")


def _bucket(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr(
        "concat('b', label) AS index_type", "vec_id AS id", "cast(embedding as array<double>) AS vec"
    )


@query(
    "index_stats",
    """SELECT 'b' || label AS index_type, count(*) AS n_rows, min(len(embedding)) AS min_dim, max(len(embedding)) AS dim, 'bge-m3' AS model FROM embeddings GROUP BY label""",
)
def index_stats(spark, sf_dir):
    return store.index_stats(_bucket(spark, sf_dir), model="bge-m3")


_UPSERT_SQL = """WITH old AS (SELECT 'b' || label AS index_type, vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
incoming AS (SELECT 'b' || label AS index_type, CASE WHEN vec_id % 3 = 0 THEN vec_id ELSE vec_id + 1000000 END AS id,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 2) AS vec, vec_id * 2 AS seq FROM embeddings
  UNION ALL SELECT 'b' || label, vec_id - vec_id % 2, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3), vec_id * 2 + 1 FROM embeddings),
fresh AS (SELECT index_type, id, arg_max(vec, seq) AS vec FROM incoming GROUP BY index_type, id),
merged AS (SELECT * FROM fresh UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.index_type = o.index_type AND f.id = o.id))
SELECT index_type, id, len(vec) AS dim, round(vec[1], 6) AS first, round(list_inner_product(vec, vec), 6) AS norm2 FROM merged"""


@query("index_upsert", _UPSERT_SQL)
def index_upsert(spark, sf_dir):
    old = _bucket(spark, sf_dir)
    one, two = _incoming(spark, sf_dir)
    incoming = store.checked(one.unionByName(two), store.index_stats(old))
    return _merged_shown(store.upsert(old, incoming))


@query("index_upsert_bucketed", _UPSERT_SQL)
def index_upsert_bucketed(spark, sf_dir):
    """The same as two upserts into a table that is bucketed by key."""
    number = uuid.uuid4().hex
    kept = BucketTable(f"vectors_{number}", f"{shared_dir(spark)}/tables/{number}", 8, "seq")
    old = _bucket(spark, sf_dir)
    kept.create(old.withColumn("seq", F.lit(None).cast("bigint")))
    for rows in _incoming(spark, sf_dir):
        kept.upsert(store.checked(rows, store.index_stats(old)))
    return _merged_shown(kept.read(spark))


def _incoming(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    one = e.selectExpr(
        "concat('b', label) AS index_type", "CASE WHEN vec_id % 3 = 0 THEN vec_id ELSE vec_id + 1000000 END AS id",
        "transform(cast(embedding as array<double>), x -> x * 2) AS vec", "vec_id * 2 AS seq",
    )
    two = e.selectExpr(
        "concat('b', label) AS index_type", "vec_id - vec_id % 2 AS id",
        "transform(cast(embedding as array<double>), x -> x * 3) AS vec", "vec_id * 2 + 1 AS seq",
    )
    return one, two


def _merged_shown(merged):
    v = as_doubles(F.col("vec"))
    return merged.select(
        "index_type", "id", F.size("vec").alias("dim"), F.round(F.get("vec", 0), 6).alias("first"),
        F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"),
    )


@query(
    "resume_pending",
    """SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""",
)
def resume_pending(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    done = table(spark, sf_dir, "labels").selectExpr("doc_id AS id", "CASE WHEN quality = 1 THEN '{}' END AS data")
    return records.pending(chunks, done).select(F.col("id").alias("doc_id"), "source")


_META = """'{"source_path": "' || event_type || '", "k": 0, "z": "' || CAST(event_id AS STRING) || '"}'"""


@query(
    "merge_metadata",
    """SELECT event_id, '{"source_path":"' || event_type || '","k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"z":"' || event_id || '","index_type":"herbs"}' AS metadata FROM events""",
)
def merge_metadata(spark, sf_dir):
    raw = spread(table(spark, sf_dir, "events")).selectExpr("event_id", f"{_META} AS meta", "props")
    merged = records.merge_json(F.col("meta"), F.col("props"), F.lit('{"index_type": "herbs"}'))
    return raw.select("event_id", merged.alias("metadata"))


# --- slots --------------------------------------------------------------------------------------

_SENTENCE = (("title", "req", ()), ("tags", "strings", ()))


def _sentences(text: str) -> list[str]:
    return [s for s in text.split(". ") if s.strip("\n\t ")]


def _sentence_text(get) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Title: "), get("title")), F.concat(F.lit("Tags: "), get("tags")))


@query(
    "registered_slots",
    """WITH c AS (SELECT doc_id, source, lang, list_filter(string_split(text, '. '), lambda x: trim(x, chr(10) || chr(9) || ' ') <> '') AS parts FROM documents),
u AS (SELECT doc_id, source, lang, unnest(parts) AS chunk, generate_subscripts(parts, 1) - 1 AS chunk_index FROM c)
SELECT doc_id, chunk_index, md5('Title: ' || trim(chunk, chr(10) || chr(9) || ' ') || chr(10) || 'Tags: ' || CASE WHEN chunk_index % 2 = 0 THEN source || ', ' || lang ELSE lang END) AS digest,
  CASE WHEN chunk_index % 3 = 0 THEN NULL ELSE length(chunk) END::DOUBLE AS size, chunk_index::DOUBLE AS place FROM u""",
)
def registered_slots(spark, sf_dir):
    """A splitter called from SQL, a schema, a template and a list of metrics, none of them known to the library."""
    register_splitter_function(spark, "sentences_of", _sentences)
    sc.register_schema("Sentence", _SENTENCE)
    tp.register_template("sentences", _sentence_text)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    cut = spark.sql(
        "SELECT doc_id, source, lang, chunk_index, chunk_text FROM sentences_of(TABLE({docs}), 'text')", docs=docs
    )
    title = F.trim("chunk_text", F.lit("\n\t ")).alias("title")
    both = F.to_json(F.struct(title, F.array("source", "lang").alias("tags")))
    one = F.to_json(F.struct(title, F.col("lang").alias("tags")))  # a lone string
    raw = cut.withColumn("data", F.parse_json(F.when(F.col("chunk_index") % 2 == 0, both).otherwise(one)))
    made = records.coerce_records(raw, "Sentence")
    shown = tp.retrieval_text(F.col("record"), sc.struct_type(_SENTENCE), "sentences")
    length = F.length("chunk_text").cast("string")
    run = made.select(
        "doc_id", "chunk_index", shown.alias("user_input"), F.col("chunk_index").cast("string").alias("place"),
        F.when(F.col("chunk_index") % 3 == 0, "none").otherwise(length).alias("size"),
    )
    run = evaluation.prepare_run(run, metrics=("size", "place"))
    return run.select("doc_id", "chunk_index", F.md5("user_input").alias("digest"), "size", "place")
