"""Domain record schemas as field lists, and the coercion of model output to them.

A field is (name, kind, aliases). The kind says what is accepted:

* ``req``        a string that must be there
* ``req_text``   a string made from whatever is there; nothing becomes ""
* ``named``      a string looked up under aliases; nothing becomes ""
* ``opt``        a string or NULL
* ``opt_text``   a string made from whatever is there, or NULL
* ``strings``    a list of strings; a lone string or nothing is a list too
* ``texts``      like ``strings``, and any other value becomes one text
* ``int``        a whole number or NULL
* ``Nested``     a list of records; a lone record is a list too
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.functions.core import bind, interleave, strip


@dataclass(frozen=True)
class Nested:
    fields: tuple
    from_string: str | None = None  # field that takes a lone string, if one may stand for a record
    keep_if: str | None = None  # entries without this field are dropped


def _f(name, kind, *aliases):
    return (name, kind, aliases)


IMAGE = (
    _f("stored_path", "opt"), _f("sha256", "opt"), _f("db_id", "opt"), _f("mime_type", "opt"),
    _f("width", "int"), _f("height", "int"), _f("byte_size", "int"),
)
IMAGES = _f("images", Nested(IMAGE))
PART_USAGE = (_f("part", "named"), _f("usage_description", "opt"))
APPLICATION = (_f("indication", "req_text"), _f("ingredients", "comma_text"), _f("usage_instructions", "named"))
INGREDIENT = (_f("name", "named", "ingredient", "herb", "drug"), _f("amount", "opt", "dose", "quantity"))
FORMULA = (
    _f("formula_name", "named", "name", "prescribed_remedy", "remedy"),
    _f("ingredients", Nested(INGREDIENT, from_string="name")),
    _f("preparation", "opt"), _f("usage_instructions", "opt", "usage"), _f("notes", "opt"),
)
FORMULAS = Nested(FORMULA, from_string="formula_name")
PATTERN = (
    _f("pattern_name", "named", "syndrome_name", "name", "pattern"),
    _f("symptoms", "opt"), _f("treatment_principle", "opt"), _f("formulas", FORMULAS),
)

SCHEMAS: dict[str, tuple] = {
    "MedicinalPlant": (
        _f("plant_name", "req"), _f("other_names", "strings"), _f("scientific_name", "opt"), _f("family", "opt"),
        _f("botanical_features", "filled", "botanical_description"), _f("distribution_and_ecology", "opt"),
        _f("parts_used", Nested(PART_USAGE)),
        _f("properties", "filled", "properties_and_dosage"), _f("properties_and_dosage", "filled", "properties"),
        _f("pharmacological_effects", "strings"), _f("treats", "strings"), _f("contraindications_warnings", "opt"),
        IMAGES, _f("therapeutic_applications", Nested(APPLICATION, keep_if="indication")),
    ),
    "RemedyRecipe": (
        _f("recipe_name", "req"), _f("source_plant", "req"), _f("ingredients", "strings"),
        _f("preparation_steps", "strings"), _f("usage_instructions", "req"), _f("health_benefits", "strings"),
        _f("indications", "opt"), _f("dosage", "opt"), _f("contraindications_warnings", "opt"), IMAGES,
    ),
    "MedicinalVegetable": (
        _f("plant_name", "req"), _f("other_names", "strings"), _f("scientific_name", "opt"), _f("family", "opt"),
        _f("botanical_description", "req"), _f("culinary_uses", "req"), _f("medicinal_properties", "req"),
        _f("distribution_and_ecology", "opt"), _f("chemical_composition", "opt"), _f("parts_used", "opt"),
        _f("dosage", "opt"), _f("contraindications_warnings", "opt"), _f("remedies", "strings"), IMAGES,
    ),
    "EndocrineSyndrome": (
        _f("syndrome_name", "req"), _f("symptoms", "req"), _f("treatment_principle", "req"),
        _f("prescribed_remedy", "req"), IMAGES,
    ),
    "EndocrinePatternRecord": (
        _f("disease_name", "named", "disease", "condition", "chapter"),
        _f("pattern_name", "named", "syndrome_name", "pattern", "name"),
        _f("symptoms", "opt"), _f("treatment_principle", "opt"), _f("formulas", FORMULAS), _f("notes", "opt"), IMAGES,
    ),
    "EndocrineDisease": (
        _f("disease_name", "named", "disease", "condition_name", "title"), _f("overview", "opt"),
        _f("classification", "strings"), _f("clinical_signs", "opt"), _f("diagnosis", "opt"),
        _f("western_medicine_notes", "opt"), _f("tcm_view", "opt"),
        _f("patterns", Nested(PATTERN, from_string="pattern_name")), _f("experience_formulas", FORMULAS),
        _f("warnings", "opt"), IMAGES,
    ),
    "EmergencyProtocol": (
        _f("condition_name", "req_text"), _f("category", "req_text"), _f("clinical_signs", "texts"),
        _f("diagnostic_tests", "opt_text"), _f("first_aid_steps", "texts"), _f("professional_treatment", "texts"),
        _f("medications", "texts"), _f("specific_antidote", "opt_text"), _f("contraindications_warnings", "opt_text"),
        _f("prevention", "opt_text"), IMAGES,
    ),
}

# A lone string that stands for a whole record, per schema.
STRING_RECORD = {"EndocrinePatternRecord": "pattern_name", "EndocrineDisease": "disease_name"}

# Wrapper documents: the list fields to explode and the schema of their entries.
WRAPPERS = {
    "DocumentContent": {"plants": "MedicinalPlant", "recipes": "RemedyRecipe"},
    "VegetableDocumentContent": {"vegetables": "MedicinalVegetable"},
    "EndocrineDocumentContent": {
        "syndromes": "EndocrineSyndrome", "diseases": "EndocrineDisease", "medicinal_plants": "MedicinalPlant",
    },
    "EmergencyDocumentContent": {"protocols": "EmergencyProtocol"},
}


def register_schema(name: str, fields: tuple) -> None:
    SCHEMAS[name] = fields


def struct_type(fields: tuple) -> T.StructType:
    def one(kind):
        if isinstance(kind, Nested):
            return T.ArrayType(struct_type(kind.fields))
        if kind in ("strings", "texts"):
            return T.ArrayType(T.StringType())
        return T.LongType() if kind == "int" else T.StringType()

    return T.StructType([T.StructField(name, one(kind)) for name, kind, _ in fields])


# --- reading variants ---------------------------------------------------------------------------


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _kind(v: Column) -> Column:
    """STRING, ARRAY, OBJECT, VOID or a number's or boolean's type; VOID for a missing value."""
    return F.coalesce(F.substring_index(F.schema_of_variant(v), "<", 1), F.lit("VOID"))


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _items(v: Column) -> Column:
    return F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")
    )


def spaced_json(text: Column) -> Column:
    """JSON with a space after every comma and colon between values."""
    literal = r'"(?:[^"\\]|\\.)*+"'
    gaps = F.transform(F.split(text, literal, -1), lambda g: F.regexp_replace(g, "([,:])", "$1 "))
    return interleave(gaps, F.regexp_extract_all(text, F.lit(literal), F.lit(0)))


def as_text(v: Column) -> Column:
    """A string as it is, a record as JSON, anything else as written."""

    def shown(kind: Column) -> Column:
        return (
            F.when(kind == "VOID", F.lit(None).cast("string"))
            .when(kind.isin("OBJECT", "ARRAY"), spaced_json(F.to_json(v)))
            .when(kind == "BOOLEAN", F.initcap(_string(v)))
            .otherwise(_string(v))
        )

    return bind(_kind(v), shown)


def _joined_text(v: Column, sep: str) -> Column:
    """A list's filled entries joined, any other value as text."""
    texts = F.transform(_items(v), lambda e: strip(F.coalesce(as_text(e), F.lit("None"))))
    joined = F.array_join(F.filter(texts, lambda t: t != ""), sep)
    return F.when(_kind(v) == "ARRAY", joined).otherwise(as_text(v))


def _strings(v: Column) -> Column:
    lone = F.filter(F.array(strip(_string(v))), lambda s: s != "")

    def listed(kind: Column) -> Column:
        return (
            F.when(kind == "VOID", F.array().cast("array<string>"))
            .when(kind == "ARRAY", F.try_variant_get(v, "$", "array<string>"))
            .when(kind == "STRING", lone)
            .otherwise(F.array(as_text(v)))
        )

    return bind(_kind(v), listed)


def _value(v: Column, name: str, kind, aliases: tuple[str, ...]) -> Column:
    if isinstance(kind, Nested):
        return bind(field(v, name), lambda x: _nested(x, kind))
    if kind in ("strings", "texts"):
        return bind(field(v, name), _strings)
    if kind == "int":
        return F.try_variant_get(v, f"$.{name}", "bigint")
    if kind == "req_text":
        return F.coalesce(bind(field(v, name), lambda x: _joined_text(x, ", ")), F.lit(""))
    if kind == "comma_text":
        return bind(field(v, name), lambda x: _joined_text(x, ", "))
    if kind == "opt_text":
        return bind(field(v, name), lambda x: _joined_text(x, "; "))

    def text(n: str) -> Column:
        return F.try_variant_get(v, f"$.{n}", "string")

    if kind == "filled":
        # The alias also stands in for an empty value.
        stand_in = F.when(strip(text(aliases[0])) != "", text(aliases[0]))
        return F.coalesce(F.nullif(text(name), F.lit("")), stand_in, text(name))
    # Any other alias counts only where the name itself is missing.
    alias = F.coalesce(*[F.nullif(text(n), F.lit("")) for n in aliases]) if aliases else F.lit(None).cast("string")
    value = F.when(field(v, name).isNull(), alias).otherwise(text(name)) if aliases else text(name)
    return F.coalesce(value, F.lit("")) if kind == "named" else value


def _nested(v: Column, spec: Nested) -> Column:
    types = struct_type(spec.fields)
    none = F.array().cast("array<variant>")

    def lone_string(e: Column) -> Column:
        values = [
            (strip(_string(e)) if f.name == spec.from_string else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in types.fields
        ]
        return F.struct(*values)

    def entry(e: Column) -> Column:
        def shaped(kind: Column) -> Column:
            out = F.when(kind == "OBJECT", build(e, spec.fields))
            if spec.from_string is not None:
                out = out.when((kind == "STRING") & (strip(_string(e)) != ""), lone_string(e))
            return out

        return bind(_kind(e), shaped)

    def listed(kind: Column) -> Column:
        return (
            F.when(kind == "ARRAY", _items(v)).when(kind.isin("OBJECT", "STRING"), F.array(v)).otherwise(none)
        )

    kept = F.filter(F.transform(bind(_kind(v), listed), entry), lambda e: e.isNotNull())
    if spec.keep_if is not None:
        kept = F.filter(kept, lambda e: strip(e[spec.keep_if]) != "")
    return kept


def build(v: Column, fields: tuple) -> Column:
    """The record of one variant as a struct."""
    return F.struct(*[_value(v, name, kind, aliases).alias(name) for name, kind, aliases in fields])


def coerce(v: Column, schema: str) -> Column:
    """Coerce a variant to a schema; a lone string may stand for a record of some schemas."""
    fields = SCHEMAS[schema]
    name = STRING_RECORD.get(schema)
    if name is None:
        return build(v, fields)
    wrapped = F.when(
        _kind(v) == "STRING", F.parse_json(F.to_json(F.struct(strip(_string(v)).alias(name))))
    ).otherwise(v)
    return bind(wrapped, lambda w: build(w, fields))


def problems(v: Column, schema: str) -> Column:
    """Names of required strings that are missing or no strings; empty for a valid record."""
    checks = [
        F.when(_kind(field(v, name)) != "STRING", F.lit(name)) for name, kind, _ in SCHEMAS[schema] if kind == "req"
    ]
    return F.filter(F.array(*checks).cast("array<string>"), lambda n: n.isNotNull())


def placeholder(text: Column, schema: str) -> Column:
    """A stand-in record: the opening of the text in every required string, nothing elsewhere."""

    def one(name: str, kind, t: T.DataType) -> Column:
        if isinstance(t, T.ArrayType):
            return F.array().cast(t)
        if kind in ("req", "req_text", "named"):
            return F.left(strip(text), F.lit(200))
        return F.lit(None).cast(t)

    fields = SCHEMAS[schema]
    types = struct_type(fields).fields
    return F.struct(*[one(n, k, t.dataType).alias(n) for (n, k, _), t in zip(fields, types)])
