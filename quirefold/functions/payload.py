"""JSON payloads built from, and read by, a schema tree that is compiled to expressions.

A node is a dict: ``{"type": "dict", "fields": {name: node}}``, ``{"type": "list",
"items": [node]}`` or a leaf ``{"type": "string|int|float|bool|null|uuid", "value": x}`` or
``{"source": name}``. In schemas of replies a leaf with ``"each": True`` stands for all
elements of its list.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import apply_placeholders

#: Where a node's value can come from.
SOURCES = ["text", "src_lang", "target_lang", "context", "character_info", "links", "meta_id"]


def _leaf(node: dict) -> Column:
    if "source" in node:
        if node["source"] not in SOURCES:
            raise ValueError(f"unknown source {node['source']!r}")
        return F.col(node["source"])
    kind, value = node.get("type", "null"), node.get("value")
    if kind == "string":
        return apply_placeholders(F.lit(value or ""), F.col("text"), F.col("src_lang"), F.col("target_lang"))
    if kind == "uuid":
        return F.uuid()
    casts = {"int": "long", "float": "double", "bool": "boolean"}
    if kind in casts:
        return F.lit(value).cast(casts[kind])
    return F.lit(None).cast("string")


def _build(node: dict) -> Column:
    if node.get("type") == "dict":
        return F.struct(*(_build(n).alias(k) for k, n in node["fields"].items()))
    if node.get("type") == "list":
        parts = [F.to_json(F.struct(_build(n).alias("v")), {"ignoreNullFields": "false"}) for n in node["items"]]
        values = [F.substring(p, F.lit(6), F.length(p) - 6) for p in parts]
        joined = F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]"))
        return F.parse_json(joined)
    return _leaf(node)


def build_payload(schema: dict) -> Column:
    """JSON of the schema filled from columns text, src_lang, ...; strings have their
    placeholders replaced; lists may mix types; nulls are written."""
    return F.to_json(_build(schema), {"ignoreNullFields": "false"})


def encode_pairs(payload: Column, keys: list[str], doseq: bool = True) -> Column:
    """``k=v`` pairs of a JSON object, URL-encoded, in the order of ``keys``; absent keys
    are left out. A list gives a pair for each element, or its JSON in one; true and false
    in words, null empty."""
    out = []
    for k in keys:
        value = F.try_variant_get(F.try_parse_json(payload), f"$.{k}", "variant")
        kind = F.schema_of_variant(value)
        name = F.url_encode(F.lit(k))
        text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
        single = F.concat(name, F.lit("="), F.url_encode(text(value)))
        many = F.transform(F.try_variant_get(value, "$", "array<string>"), lambda e: F.concat(name, F.lit("="), F.url_encode(F.coalesce(e, F.lit("")))))
        listed = F.when(kind.startswith("ARRAY"), many if doseq else F.array(F.concat(name, F.lit("="), F.url_encode(F.to_json(value)))))
        out.append(F.when(value.isNotNull(), F.coalesce(listed, F.array(single))).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.flatten(F.array(*out)), "&")


def paths(schema: dict, source: str) -> list[tuple[str, bool]]:
    """JSON paths of the nodes marked with a source, in order, and whether each stands for all elements."""

    def walk(node: dict, path: str) -> list[tuple[str, bool]]:
        if node.get("source") == source:
            return [(path, bool(node.get("each")))]
        found = []
        for k, n in node.get("fields", {}).items():
            found += walk(n, f"{path}['{k}']")
        for i, n in enumerate(node.get("items", [])):
            found += walk(n, path if n.get("each") and "source" in n else f"{path}[{i}]")
        return found

    return walk(schema, "$")


def collect(payload: Column, schema: dict, source: str) -> Column:
    """Array of the JSON texts at marked nodes, in order; missing keys and short lists are skipped."""
    v = F.try_parse_json(payload)
    found = []
    for path, each in paths(schema, source):
        if each:
            found.append(F.coalesce(F.transform(F.try_variant_get(v, path, "array<variant>"), lambda e: F.to_json(e)), F.array().cast("array<string>")))
        else:
            found.append(F.array_compact(F.array(F.to_json(F.try_variant_get(v, path, "variant")))))
    return F.flatten(F.array(*found)) if found else F.array().cast("array<string>")


#: Strings (after the escapes of quotes and backslashes are spelt in hexadecimal), keys with their colon, and other scalars.
_SCALAR = r'"[^"]*"(?:\s*:)?|-?[0-9][0-9.eE+-]*|true|false|null'


def flatten_strings(payload: Column) -> Column:
    """The non-empty scalars of any JSON text in the order of the text, booleans in lower
    case, nulls dropped, as strings.

    The text is read once for whether it is JSON and once for its scalars, at any depth the
    reader takes and without a shuffle. Null, unreadable and empty JSON have no strings.
    """
    hexed = F.replace(F.replace(payload, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    tokens = F.filter(F.regexp_extract_all(hexed, F.lit(_SCALAR), F.lit(0)), lambda t: ~t.endswith(":") & (t != "null"))
    values = F.transform(tokens, lambda t: F.try_variant_get(F.try_parse_json(t), "$", "string"))
    found = F.filter(values, lambda s: s.isNotNull() & (s != ""))
    return F.when(F.try_parse_json(payload).isNotNull(), found).otherwise(F.array().cast("array<string>"))


def read_response(payload: Column, schema: dict) -> Column:
    """struct(text, error, alternatives) of a reply: marked fragments joined (null if none),
    the first error that is not empty, alternatives distinct in order."""

    def texts(source: str) -> Column:
        plain = F.transform(collect(payload, schema, source), lambda j: F.try_variant_get(F.try_parse_json(j), "$", "string"))
        return F.filter(plain, lambda s: s.isNotNull() & (s != ""))

    text, errors = texts("text"), texts("error")
    return F.struct(
        F.nullif(F.array_join(text, ""), F.lit("")).alias("text"),
        F.get(errors, F.lit(0)).alias("error"),
        F.array_distinct(texts("alternatives")).alias("alternatives"),
    )


def seal(df: DataFrame, cols: list[str], key: Column | str) -> DataFrame:
    """The named columns as AES-GCM cipher texts with their time of sealing, others in clear.

    The key is an expression of the caller's, such as a column of a secrets table, so that
    no plan has it in it. A null stays null; a failure fails the row.
    """
    now = F.unix_seconds(F.current_timestamp()).cast("string")
    k = F.expr(key) if isinstance(key, str) else key

    def one(c: str) -> Column:
        sealed = F.base64(F.aes_encrypt(F.encode(F.col(c).cast("string"), "UTF-8"), k, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.encode(now, "UTF-8")))
        return F.when(F.col(c).isNotNull(), F.concat(now, F.lit("."), sealed))

    return df.withColumns({c: one(c) for c in cols})


def open_alternatives(df: DataFrame, col: str, keys: list[Column], max_age: int | None = None) -> Column:
    """The clear texts of an array of sealed ones in their order. What no key opens, is too old, null
    or empty is dropped; texts that are equal once open stay once, the first. A null array is empty."""
    clear = F.transform(F.coalesce(F.col(col), F.array().cast("array<string>")), lambda x: open_sealed(df, x, keys, max_age))
    return F.array_distinct(F.filter(clear, lambda x: x != ""))


def open_sealed(df: DataFrame, col: str | Column, keys: list[Column], max_age: int | None = None) -> Column:
    """The clear text of a sealed column under the first key that opens it; null if none
    does or it was sealed over ``max_age`` seconds ago. The time is authenticated with it."""
    at, body = F.substring_index(col, ".", 1), F.substring_index(col, ".", -1)
    clear = F.coalesce(
        *(F.decode(F.try_aes_decrypt(F.unbase64(body), k, F.lit("GCM"), F.lit("DEFAULT"), F.encode(at, "UTF-8")), "UTF-8") for k in keys)
    )
    if max_age is None:
        return clear
    return F.when(F.unix_seconds(F.current_timestamp()) - at.try_cast("long") <= max_age, clear)


def render_context(context: Column, roster: Column, glossary: Column) -> Column:
    """Reference text: roster lines, glossary lines, numbered dialogue, oldest first.
    Null fields are left out, an empty part too; with nothing at all the text is empty."""
    people = F.transform(
        roster,
        lambda r: F.concat(
            F.lit("[character] Name: "), F.coalesce(r["name_en"], F.lit("?")),
            F.when(r["name_ja"].isNotNull(), F.concat(F.lit(" ("), r["name_ja"], F.lit(")"))).otherwise(""),
            F.when(r["gender"].isNotNull(), F.concat(F.lit(" | Gender: "), r["gender"])).otherwise(""),
        ),
    )
    words = F.transform(glossary, lambda g: F.concat(g["original"], F.lit(" = "), g["english"]))
    lines = F.transform(
        context,
        lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), F.when(c["speaker"].isNotNull(), F.concat(F.lit("["), c["speaker"], F.lit("]: "))).otherwise(""), c["source"], F.lit(" -> "), c["english"]),
    )
    return F.array_join(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in (people, words, lines))), "\n")
