"""Retrieval text of a record, per bucket.

Each template is a function of a getter: ``get(name)`` is the record's column or NULL when the
record has no such field, so one template serves every schema stored in the bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.functions.core import strip

Getter = Callable[[str], Column]


def getter(record: Column, schema: T.StructType) -> Getter:
    """String fields as they are, string lists joined by commas, nested lists as arrays."""
    types = {f.name: f.dataType for f in schema.fields}

    def get(name: str) -> Column:
        t = types.get(name)
        if t is None:
            return F.lit(None).cast("string")
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            return F.array_join(record[name], ", ")
        return record[name]

    get.types, get.record = types, record
    return get


def _first(get: Getter, *names: str) -> Column:
    return F.coalesce(*[F.nullif(get(n), F.lit("")) for n in names if _is_text(get, n)], F.lit(""))


def _is_text(get: Getter, name: str) -> bool:
    t = get.types.get(name)
    return t is None or isinstance(t, T.StringType) or (isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType))


def _line(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def _always(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), F.coalesce(value, F.lit("")))


def _nested(get: Getter, name: str, item: Callable[[Column], Column], head: str) -> Column:
    """``head`` and one line per entry that yields any text; NULL without such lines."""
    t = get.types.get(name)
    if not (isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType)):
        return F.lit(None).cast("string")
    rows = F.filter(F.transform(get(name), item), lambda x: x.isNotNull())
    return F.when(F.size(rows) > 0, F.concat(F.lit(head), F.array_join(rows, "\n")))


def _trimmed(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def _bits(prefix: str, *parts: Column) -> Column:
    joined = F.concat_ws(" | ", *parts)
    return F.when(joined != "", F.concat(F.lit(prefix), joined))


def _formula_names(formulas: Column) -> Column:
    names = F.transform(formulas, lambda f: F.coalesce(f["formula_name"], F.lit("")))
    return F.array_join(F.filter(names, lambda n: n != ""), ", ")


def _has(get: Getter, name: str) -> bool:
    return name in get.types


def herbs(get: Getter) -> Column:
    def part(p: Column) -> Column:
        name, usage = _trimmed(p["part"]), _trimmed(p["usage_description"])
        return F.when((name != "") & (usage != ""), F.concat(F.lit("- "), name, F.lit(": "), usage)).when(
            name != "", F.concat(F.lit("- "), name)
        )

    def application(a: Column) -> Column:
        return _bits(
            "- ",
            _line("Chỉ định: ", _trimmed(a["indication"])),
            _line("Thành phần: ", _trimmed(a["ingredients"])),
            _line("Cách dùng: ", _trimmed(a["usage_instructions"])),
        )

    return F.concat_ws(
        "\n",
        _line("Tên cây: ", _first(get, "plant_name", "name")),
        _line("Tên gọi khác: ", _first(get, "other_names")),
        _line("Tên khoa học: ", _first(get, "scientific_name")),
        _line("Họ: ", _first(get, "family")),
        _line("Thành phần hóa học: ", _first(get, "chemical_composition")),
        _line("Đặc điểm thực vật: ", _first(get, "botanical_features", "botanical_description")),
        _line("Phân bố/Sinh thái: ", _first(get, "distribution_and_ecology")),
        _line("Công dụng ẩm thực: ", _first(get, "culinary_uses")),
        _line(
            "Tính vị/Công năng/Liều dùng: ", _first(get, "properties_and_dosage", "properties", "medicinal_properties")
        ),
        _line("Tác dụng dược lý: ", _first(get, "pharmacological_effects")),
        _nested(get, "parts_used", part, "Bộ phận dùng:\n"),
        _line("Chỉ định/Trị: ", _first(get, "treats")),
        _line("Bài thuốc: ", _first(get, "remedies")),
        _nested(get, "therapeutic_applications", application, "Ứng dụng cụ thể:\n"),
        _line("Chống chỉ định/Lưu ý: ", _first(get, "contraindications_warnings")),
    )


def remedies(get: Getter) -> Column:
    return F.concat_ws(
        "\n",
        _always("Recipe: ", _first(get, "recipe_name")),
        _always("Source plant: ", _first(get, "source_plant")),
        _always("Ingredients: ", _first(get, "ingredients")),
        _always("Preparation: ", _first(get, "preparation_steps")),
        _always("Usage: ", _first(get, "usage_instructions")),
        _always("Benefits: ", _first(get, "health_benefits")),
    )


def diseases(get: Getter) -> Column:
    name = _first(get, "disease_name", "syndrome_name", "disease")
    names = _formula_names(get("formulas")) if _has(get, "formulas") else F.lit("")
    by_pattern = F.concat_ws(
        "\n",
        _always("Endocrine disease: ", name),
        _always("Pattern: ", _first(get, "pattern_name")),
        _line("Symptoms: ", _first(get, "symptoms")),
        _line("Treatment principle: ", _first(get, "treatment_principle")),
        _line("Formulas: ", names),
    )

    def pattern(p: Column) -> Column:
        return _bits(
            " - ",
            _line("Pattern: ", p["pattern_name"]),
            _line("Principle: ", p["treatment_principle"]),
            _line("Symptoms: ", p["symptoms"]),
            _line("Formulas: ", _formula_names(p["formulas"])),
        )

    kinds = F.lit("")
    if _has(get, "classification"):
        kinds = F.array_join(F.filter(get.record["classification"], lambda x: _trimmed(x) != ""), ", ")
    by_topic = F.concat_ws(
        "\n",
        _always("Endocrine topic: ", name),
        _line("Overview: ", _first(get, "overview")),
        _line("Classification: ", kinds),
        _line("Clinical signs: ", _first(get, "clinical_signs", "symptoms")),
        _line("Diagnosis: ", _first(get, "diagnosis")),
        _line("TCM view: ", _first(get, "tcm_view")),
        _line("Treatment principle: ", _first(get, "treatment_principle")),
        _line("Prescribed remedy: ", _first(get, "prescribed_remedy")),
        _nested(get, "patterns", pattern, "Patterns:\n"),
        _line(
            "Experience formulas: ",
            _formula_names(get("experience_formulas")) if _has(get, "experience_formulas") else F.lit(""),
        ),
    )
    return F.when(_first(get, "pattern_name") != "", by_pattern).otherwise(by_topic)


def emergency(get: Getter) -> Column:
    return F.concat_ws(
        "\n",
        _always("Condition: ", _first(get, "condition_name")),
        _always("Signs: ", _first(get, "clinical_signs")),
        _always("First aid: ", _first(get, "first_aid_steps")),
        _always("Antidote: ", _first(get, "specific_antidote")),
    )


TEMPLATES: dict[str, Callable[[Getter], Column]] = {
    "herbs": herbs,
    "remedies": remedies,
    "diseases": diseases,
    "emergency": emergency,
}


def register_template(index_type: str, template: Callable[[Getter], Column]) -> None:
    TEMPLATES[index_type] = template


def retrieval_text(record: Column, schema: T.StructType, index_type: str) -> Column:
    """The bucket's template, or the record as JSON for a bucket without one."""
    template = TEMPLATES.get(index_type)
    return F.to_json(record) if template is None else strip(template(getter(record, schema)))
