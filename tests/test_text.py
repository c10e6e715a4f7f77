"""Hand-written cases for the text, splitter and markdown rules."""

import itertools
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions import chunks as ch
from folioworks.functions import markdown as md
from folioworks.functions import splitters as sp
from folioworks.functions import text as tx
from folioworks.functions.core import interleave, pieces_where, to_lines


def test_segments(one):
    got = one(lambda t: pieces_where(to_lines(t), lambda x: x.startswith("#")), "intro\n# A\n\nx\n\n# B\ny")
    assert got == ["# A\n\nx", "# B\ny"]


def test_section_chunks_lose_a_hash(one):
    assert one(sp.by_section, "# A\nx\n# B\ny") == ["# A\nx", "B\ny"]


def test_paragraphs(one):
    assert one(sp.by_paragraph, "a\r\n\r\n b \n\n\n\nc") == ["a", "b", "c"]


def test_repeated_lines(one):
    assert one(tx.drop_repeated_lines, "a\na \n\n\na\nb") == "a\n\na\nb"


def test_repeated_sentences(one):
    assert one(tx.drop_repeated_sentences, "One. Two! one. Three") == "One. Two! Three"


def test_blank_edges(one):
    assert one(tx.trim_blank_edges, "\n  \n  a\n\n b \n \n") == "  a\n\n b "
    assert one(tx.trim_blank_edges, " \n  ") == ""


def test_section_breaks(one):
    assert one(md.insert_breaks, "## A\nx\n## B\ny\n# C") == "## A\nx\n</break>\n## B\ny\n</break>\n# C"
    assert one(md.insert_breaks, "## A\n### a\n## B") == "## A\n### a\n## B\n</break>"
    assert one(md.insert_breaks, "plain") == "plain"


def test_recipe_options(one):
    got = one(sp.recipe_options, "### 1. NƯỚC X\ntwo ways\n#### a) P\np\n#### b) Q\nq")
    assert got == ["### 1. NƯỚC X - P\ntwo ways\n#### a) P\np", "### 1. NƯỚC X - Q\ntwo ways\n#### b) Q\nq"]
    assert one(sp.recipe_options, "### 1. NƯỚC X\n#### a) P\np") == ["### 1. NƯỚC X\n#### a) P\np"]


def test_variants(one):
    entry = "\n".join(
        ["#### 84 MƯỚP", "mở đầu", "1. chung", "![](![id: k](k.png))", "", "MƯỚP KHÍA", "thân khía", "MƯỚP HƯƠNG",
         "thân hương", "2. cách dùng", "nấu canh"]
    )
    got = one(sp.variants, entry)
    assert [g.split("\n")[0] for g in got] == ["#### 84 MƯỚP - MƯỚP KHÍA", "#### 84 MƯỚP - MƯỚP HƯƠNG"]
    assert "![](![id: k](k.png))\n\nMƯỚP KHÍA\nthân khía\n2. cách dùng" in got[0]
    assert "thân hương\n2. cách dùng\nnấu canh" in got[1] and "thân khía" not in got[1]


def test_protocols_skip_the_contents_page(one):
    body = "\n".join(f"dòng chữ thường thứ {i} của bài này" for i in range(25))
    text = "\n".join(
        ["1.", "RẮN CẮN", "2.", "SAY NẮNG", "3.", "SỐC", "4.", "BỎNG", "1. RẮN CẮN", body, "2.", "", "SAY NẮNG", body]
    )
    got = one(sp.protocols, text)
    assert [g.split("\n")[0] for g in got][-2:] == ["1. RẮN CẮN", "2."]
    assert all(len(g) >= 300 for g in got)


def test_line_repair(one):
    for raw, want in [("#A", "# A"), ("-x", "- x"), ("1.x", "1. x"), (">q", "> q"), ("**b", "* *b")]:
        assert one(md.repair_line, raw) == want
    assert one(lambda t: md.repair_line(t, strict=True), "**b") == "**b"
    assert one(lambda t: md.repair_line(t, strict=True), "1.5 g") == "1.5 g"


def test_sanitize(one):
    assert one(tx.sanitize_chunk, "#### (7) ABC <!-- p --> ![](![id: k](k.png))") == "#### ABC [[IMAGE:k]]"
    assert one(tx.sanitize_chunk, "6. x\n## Page 11\n\n\n![a](b) </break> y") == "x\n\n[[IMAGE]] y"


def test_spelling_leaves_protected_parts_alone(one):
    assert one(md.correct_spelling, "đây l à thu ốc , $l à$ <b>l à</b>") == "đây là thu ốc, $l à$ <b>l à</b>"
    assert one(md.correct_spelling, "# l à\n| l à |\nl  à , l\tà") == "# l à\n| l à |\nlà, là"
    assert one(md.correct_spelling, "5 . 2 g ( x ) b ệ n h") == "5.2 g (x) bệnh"


def test_custom_rules(one):
    assert one(lambda t: md.apply_rules(t, [(r"[ab]+c", "z"), (r"\bfoo\b", "bar")]), "abc foo") == "z bar"


def test_rules_that_leave_spaces_behind(one):
    rules = [(r"\bfoo\b", ""), (r"\ba\s+b\b", "ab")]
    assert one(lambda t: md.apply_rules(t, rules), "a foo b") == "ab"


def test_image_placeholders(one):
    text = "[IMAGE_PLACEHOLDER_9] [IMAGE_PLACEHOLDER_4] [IMAGE_PLACEHOLDER_5]"
    ids = F.array(F.lit("p"), F.lit("q"))
    assert one(lambda t: md.inject_image_ids(t, ids), text) == "![id: p](p.png) ![id: q](q.png) ![id: p](p.png)"
    assert one(lambda t: md.inject_image_ids(t, F.lit(None).cast("array<string>")), text) == text


def test_header_paths_ignore_code(one):
    text = "top\n# A\n```\n# no\n```\n## B\nx\n# C"
    got = [(n["header_path"], n["text"]) for n in one(md.header_nodes, text)]
    assert got == [("/", "top"), ("/", "# A\n```\n# no\n```"), ("/A/", "## B\nx"), ("/", "# C")]


def test_tables(one):
    cells = one(md.table_cells, "x\n| a | b |\n|---|---|\n| 1 | 2 | 3 |\n\n| lone |")
    assert [(c["row_no"], c["col_no"], c["cell"]) for c in cells] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, "2")]


def test_answers(one):
    assert one(tx.clean_answer, "Hình ảnh: a ![x\ny](z) b") == "a  b"
    long = one(tx.clean_answer, "x" * 3100)
    assert long == "x" * 3000 + "\n...(truncated for safety)"
    placed = one(lambda t: tx.images_before_sources(t, F.lit("IMG")), "a\nNguồn: 1\nb\nnguồn: 2")
    assert placed == "a\nNguồn: 1\nb\nIMG\nnguồn: 2"


def test_names(one):
    assert one(tx.fold_accents, "  Đào   Nguyễn Ắ ") == "đao nguyen a"
    assert one(tx.name_tokens, "Cây Đào lá to") == ["dao", "to"]
    assert one(tx.focus_tokens, "Cho xem cây ổi rừng nhìn ra sao") == ["oi", "rung"]
    assert one(tx.focus_tokens, "ổi là gì") == ["oi", "gi"]


def test_json_and_ids(one):
    assert one(tx.json_object_in, '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(tx.json_object_in, "no json") == "no json"
    assert one(tx.line_hint, "a.md:#53") == 53
    assert one(tx.line_hint, "a.md:#0") is None


@pytest.mark.parametrize("size,want", [(0, "0.0 B"), (1023, "1023.0 B"), (1536, "1.5 KB"), (5 * 1024**4, "5.0 TB")])
def test_sizes(spark, size, want):
    got = spark.range(1).select(tx.human_size(F.lit(size)).alias("s")).first()["s"]
    assert got == want


# --- properties ---------------------------------------------------------------------------------


def model_chunks(text, size=512, overlap=50, low=100):
    """A plain restatement of the chunking rule: windows that end after the last stop mark."""
    if len(text) <= size:
        return [(text, 0)]
    out, at = [], 0
    while True:
        end = min(at + size, len(text))
        if end < len(text):
            ends = [text.rfind(stop, at, end) for stop in (". ", "! ", "? ", "。", "！", "？")]
            good = [e + 1 for e in ends if e > at + low]
            end = good[0] if good else end
        piece = text[at:end].strip()
        if len(piece) >= low:
            out.append((piece, at))
        at = end - overlap
        if at >= len(text) - low:
            return out


words = st.lists(st.sampled_from(["lá", "rễ.", "hoa!", "quả?", "thân 。", "x", "\n", "được "]), max_size=700)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs=st.lists(words, min_size=1, max_size=6))
def test_overlapping_chunks_follow_the_model(spark, docs):
    texts = [" ".join(d) for d in docs]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", ch.overlapping(F.col("t")).alias("c")).collect()
    for r in rows:
        assert [(c["text"], c["position"]) for c in r["c"]] == model_chunks(texts[r["i"]])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab \n.!Á", max_size=60), min_size=1, max_size=8))
def test_cleaning_is_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for fn in (tx.drop_repeated_lines, tx.drop_repeated_sentences, tx.normalize_spaces):
        got = df.select(fn(F.col("t")).alias("a"), fn(fn(F.col("t"))).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got)


def test_packed_paragraphs_keep_all_text(one):
    text = "\n\n".join("p" * n for n in (300, 300, 300, 900, 10, 10))
    got = one(lambda t: ch.packed_paragraphs(t, 800), text)
    assert "\n\n".join(got) == text
    assert [len(g) for g in got] == [602, 300, 900, 22]


def test_sections_cover_the_text(one):
    text = "\n".join(f"# H{i}\nbody {i}" for i in range(50))
    assert "\n".join(one(sp.by_heading, text)) == text
    assert re.sub(r"\n</break>", "", one(md.insert_breaks, text)) == text


@pytest.mark.parametrize("space", ["\t", "\x0b", "\xa0", " ", " ", " ", "　", "  "])
def test_rules_see_every_kind_of_space(one, space):
    assert one(md.apply_rules, f"đây l{space}à") == "đây là"


def test_strip_covers_the_same_characters(one):
    from folioworks.functions.core import WHITESPACE, strip

    assert WHITESPACE.strip() == "" and one(strip, WHITESPACE + "a b" + WHITESPACE) == "a b"


def test_spelling_looks_for_tags_once_and_for_rows_by_line(spark):
    """Against swapping all seven kinds of spans in the whole text; whole lines are not searched for there any more."""

    def by_kinds(text):
        def guard(t, k):
            if k == len(fv.PROTECTED_SPANS):
                return md.apply_rules(t)
            pattern = F.lit(fv.PROTECTED_SPANS[k][1])
            inner = guard(F.regexp_replace(t, pattern, F.lit(f"_{chr(0xE000 + k)}_")), k + 1)
            gaps = F.split(inner, f"_{chr(0xE000 + k)}_", -1)
            return interleave(gaps, F.regexp_extract_all(t, pattern, F.lit(0)))

        return guard(text, 0)

    parts = ["l à", "<b>", "</b>", "<br/>", "<", ">", "</", "\n", "# l à", "| l à |", " ", "$l à$", "\t| l à | \t", "$"]
    texts = ["".join(p) for p in itertools.product(parts, repeat=3)] + ["## <b\nl à> l à\n# | l à |\n|l à $x|\nl à$ |"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", md.correct_spelling(F.col("t")).alias("got"), by_kinds(F.col("t")).alias("want")).collect()
    assert [r for r in rows if r["got"] != r["want"]] == []
    plan = df.select(md.correct_spelling(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2 * 5  # the column's name shows them again
