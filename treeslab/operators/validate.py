"""Documents against the format's rules: one row for each violation.

Structural rules run as columns, over tables or within the row of a text. Type descriptors are recursive; their distinct texts, few in any
corpus, are checked by one function that the workers run on each distinct text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeslab.functions import types as Y
from treeslab.functions.codec import let
from treeslab.functions.spaces import SHAPE
from treeslab.operators.meta import FILTERS, USER_FILTER
from treeslab.sources.documents import DOCUMENT, VERSIONS, Tables

UUID_RULE = r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$"
# Names that the format allows. (Fixed values.)
PADDING = {"H5T_STR_NULLTERM", "H5T_STR_NULLPAD", "H5T_STR_SPACEPAD"}
CHARSETS = {"H5T_CSET_ASCII", "H5T_CSET_UTF8"}
ALLOC = ["H5D_ALLOC_TIME_DEFAULT", "H5D_ALLOC_TIME_EARLY", "H5D_ALLOC_TIME_INCR", "H5D_ALLOC_TIME_LATE"]
FILL = ["H5D_FILL_TIME_IFSET", "H5D_FILL_TIME_ALLOC", "H5D_FILL_TIME_NEVER"]
LAYOUTS = ["H5D_COMPACT", "H5D_CHUNKED", "H5D_CONTIGUOUS"]
SCALES = ["H5Z_SO_FLOAT_DSCALE", "H5Z_SO_FLOAT_ESCALE", "H5Z_SO_INT"]
CODINGS = ["H5_SZIP_EC_OPTION_MASK", "H5_SZIP_NN_OPTION_MASK"]


# Bit layouts of numbers of the user's own. (Fixed values.) Words and what they may be; numbers and the least that they may be.
PADS = ("H5T_PAD_ZERO", "H5T_PAD_ONE", "H5T_PAD_BACKGROUND")
LAYOUT_WORDS = {"byteOrder": ("H5T_ORDER_LE", "H5T_ORDER_BE"), "lsbPad": PADS, "msbPad": PADS}
LAYOUT_NUMBERS = {"size": 1, "precision": 1, "bitOffset": 0}
FLOAT_WORDS = {"intlbPad": PADS, "msbitPad": PADS, "mantNorm": ("H5T_NORM_IMPLIED", "H5T_NORM_MSBSET", "H5T_NORM_NONE")}
FLOAT_NUMBERS = {"expBias": 1, "expBits": 1, "expBitPos": 1, "mantBits": 1, "mantBitPos": 0, "signBitPos": 1}
SIGNS = {"signType": ("H5T_SGN_NONE", "H5T_SGN_2")}


def _layout_problem(item: dict, kind: str) -> str | None:
    """What is wrong with a number type that is described by its bits."""
    words = LAYOUT_WORDS | (FLOAT_WORDS if kind == "H5T_FLOAT" else SIGNS if kind == "H5T_INTEGER" else {})
    numbers = LAYOUT_NUMBERS | (FLOAT_NUMBERS if kind == "H5T_FLOAT" else {})
    for name in (*LAYOUT_NUMBERS, *(["byteOrder"] if kind == "H5T_BITFIELD" else [])):
        if name not in item:
            return f"a type of bits has {name}"
    for name, value in item.items():
        if name in words and value not in words[name]:
            return f"no such {name}"
        if name in numbers and (not isinstance(value, int) or isinstance(value, bool) or value < numbers[name]):
            return f"{name} is a whole number of {numbers[name]} or more"
        if name not in words and name not in numbers and name != "class" and kind != "H5T_INTEGER":
            return f"a type of bits has no {name}"
    return None


def type_problem(item: Any) -> str | None:
    """What is wrong with a type descriptor, or None."""
    if isinstance(item, str):
        ok = item.startswith("datatypes/") and Y.UUID.match(item[10:])
        return None if ok else "a named type is datatypes/<uuid>"
    if not isinstance(item, dict):
        return "a type is an object or a reference"
    kind = item.get("class")
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    try:
        if kind in ("H5T_INTEGER", "H5T_FLOAT"):
            if isinstance(item.get("base"), str):
                letter, bits, _ = Y.number(item["base"])
                fits = (letter == "F") == (kind == "H5T_FLOAT") and bits in ((32, 64) if letter == "F" else (8, 16, 32, 64)) and item["base"][-2:] in ("LE", "BE")
                return None if fits else "no such number type"
            return _layout_problem(item, kind) if {"size", "precision", "bitOffset", "byteOrder"} & set(item) else "a number type has a base"
        if kind == "H5T_STRING":
            length = item.get("length")
            if not (length == Y.VARIABLE or (whole(length) and length > 0)):
                return "a string has a length"
            if item.get("strPad") not in PADDING or item.get("charSet", "H5T_CSET_ASCII") not in CHARSETS:
                return "no such padding or character set"
            return None
        if kind == "H5T_COMPOUND":
            fields = item.get("fields")
            if not isinstance(fields, list) or not fields:
                return "a compound has fields"
            for x in fields:
                if not isinstance(x, dict) or not isinstance(x.get("name"), str) or "type" not in x:
                    return "a field has a name and a type"
                if problem := type_problem(x["type"]):
                    return problem
            return None
        if kind == "H5T_ARRAY":
            dims = item.get("dims")
            if not isinstance(dims, list) or not dims or not all(whole(d) and d > 0 for d in dims):
                return "an array type has dims"
            return type_problem(item.get("base"))
        if kind == "H5T_VLEN":
            return type_problem(item.get("base"))
        if kind == "H5T_ENUM":
            if not Y.members_of(item) or not all(whole(v) for v in Y.members_of(item).values()):
                return "an enumeration has whole numbers"
            base = item.get("base")
            base = {"class": "H5T_INTEGER", "base": base} if isinstance(base, str) else base
            return type_problem(base) if isinstance(base, dict) and base.get("class") == "H5T_INTEGER" else "an enumeration is of integers"
        if kind == "H5T_OPAQUE":
            return None if whole(item.get("size")) and item["size"] > 0 else "an opaque type has a size"
        if kind == "H5T_REFERENCE":
            return None if item.get("base") in ("H5T_STD_REF_OBJ", "H5T_STD_REF_DSETREG") else "no such reference"
        if kind == "H5T_BITFIELD":
            if isinstance(item.get("base"), str):
                letter, bits, _ = Y.number(item["base"])
                return None if letter != "F" and bits in (8, 16, 32, 64) and item["base"][-2:] in ("LE", "BE") else "no such bit field"
            return _layout_problem(item, kind) if "size" in item else "a bit field has a base"
    except (KeyError, TypeError, ValueError, AttributeError) as error:
        return str(error)
    return f"no such class of types: {kind}"


def text_problem(text: str | None) -> str | None:
    """What is wrong with a type descriptor's text, or None."""
    try:
        return type_problem(json.loads(text) if text[:1] == "{" else text) if text else "a type is missing"
    except ValueError:
        return "a type is no JSON"


def _type_problems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(problem=[text_problem(x) for x in batch["type_json"]])


def _list_problems(lists: pa.Array) -> pa.Array:
    """The problems of lists of types' texts; a text is looked at once in a batch."""
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    found = pa.array([text_problem(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    found = pc.if_else(flat.is_null(), pa.scalar(text_problem(None)), found)
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0)).cast(pa.int32())
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), found)


def _broken(rules: dict[str, Column]) -> Column:
    """The names of broken rules; a rule that is null holds."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())


def _rules(frame: DataFrame, where: Column, rules: dict[str, Column]) -> DataFrame:
    """file_id, place, rule of broken rules."""
    return frame.select("file_id", where.alias("place"), F.explode(_broken(rules)).alias("rule"))


def _all(items: Column, ok) -> Column:  # noqa: ANN001
    return F.forall(items, ok)


def space_rules(shape: Column) -> dict[str, Column]:
    kind = shape["class"]
    limit = lambda x: (x == "H5S_UNLIMITED") | (x.try_cast("bigint") > 0)
    return {
        "no such dataspace": kind.isin("H5S_NULL", "H5S_SCALAR", "H5S_SIMPLE"),
        "a simple space has extents of 0 or more": (kind != "H5S_SIMPLE") | (F.coalesce(F.size(shape["dims"]) > 0, F.lit(False)) & F.coalesce(_all(shape["dims"], lambda d: d >= 0), F.lit(False))),
        "only a simple space has extents": (kind == "H5S_SIMPLE") | (shape["dims"].isNull() & shape["maxdims"].isNull()),
        "greatest extents are over 0 or unlimited": _all(shape["maxdims"], lambda x: F.coalesce(limit(x), F.lit(False))),
    }


def file_rules(version: Column, root: Column) -> dict[str, Column]:
    return {"no such version": F.coalesce(version.isin(*VERSIONS), F.lit(False)), "a root is missing": root.isNotNull()}


def _is_path(x: Column) -> Column:
    return x.rlike("^(/[^/]+)+$")


def alias_rules(alias: Column, ok=_is_path) -> dict[str, Column]:  # noqa: ANN001
    return {"an alias is a path": alias.isNull() | ((F.size(alias) > 0) & _all(alias, ok))}


def group_rules(alias: Column) -> dict[str, Column]:
    return alias_rules(alias, lambda x: _is_path(x) | (x == "/"))


def key_rules(uuid: Column, alias: Column) -> dict[str, Column]:
    return {"a key is a uuid": uuid.rlike(UUID_RULE)} | alias_rules(alias)


def attribute_rules(name: Column, shape: Column) -> dict[str, Column]:
    return {"an attribute has a name": F.coalesce(F.length(name) > 0, F.lit(False))} | space_rules(shape)


def link_rules(of: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """of: a link's member by its name."""
    kind, has = of("class"), lambda x: of(x).isNotNull()
    return {
        "a link's title has no /": F.coalesce(of("title").rlike("^[^/]+$"), F.lit(False)),
        "no such class of links": F.coalesce(kind.isin("H5L_TYPE_HARD", "H5L_TYPE_SOFT", "H5L_TYPE_EXTERNAL", "H5L_TYPE_USER_DEFINED"), F.lit(False)),
        "a hard link has a collection and an id": (kind != "H5L_TYPE_HARD") | (has("id") & F.coalesce(of("collection").isin("groups", "datasets", "datatypes"), F.lit(False))),
        "a soft link has a path": (kind != "H5L_TYPE_SOFT") | F.coalesce(of("h5path").rlike("^(/?[^/]+)+$"), F.lit(False)),
        "an external link has a file and a path": (kind != "H5L_TYPE_EXTERNAL") | (has("file") & has("h5path")),
    }


def filter_rules(f: Column) -> Column:
    """Whether a filter (struct with id, class and options) is well formed."""
    number = F.create_map(*(F.lit(x) for k, v in FILTERS.items() for x in (v[0], k)))
    known = F.try_element_at(number, f["class"])
    ok = F.when(f["class"] == USER_FILTER, f["id"] > 0).when(known.isNull(), False).otherwise(F.coalesce(f["id"] == known, F.lit(True)))
    ok = ok & F.coalesce(f["level"].between(0, 9), F.lit(True))
    ok = ok & ((f["class"] != "H5Z_FILTER_SCALEOFFSET") | F.coalesce(f["scaleType"].isin(SCALES) & (f["scaleOffset"] >= 0), F.lit(False)))
    ok = ok & F.coalesce(f["coding"].isin(CODINGS), F.lit(True)) & F.coalesce((f["bitsPerPixel"] > 0) & (f["pixelsPerBlock"] > 0), F.lit(True))
    return F.coalesce(ok, F.lit(False))


PROPERTIES = (
    "struct<allocTime: string, fillTime: string, layout: struct<class: string, dims: array<bigint>>,"
    " filters: array<struct<id: int, class: string, level: int, scaleType: string, scaleOffset: int, coding: string, bitsPerPixel: int, pixelsPerBlock: int>>>"
)


def property_rules(p: Column) -> dict[str, Column]:
    return {
        "creation properties have a layout": p["layout"].isNotNull() & F.coalesce(p["layout"]["class"].isin(LAYOUTS), F.lit(False)) | p.isNull(),
        "a chunked layout has extents over 0": (p["layout"]["class"] != "H5D_CHUNKED") | F.coalesce(_all(p["layout"]["dims"], lambda d: d > 0) & (F.size(p["layout"]["dims"]) > 0), F.lit(False)),
        "no such allocation time": p["allocTime"].isin(ALLOC),
        "no such fill time": p["fillTime"].isin(FILL),
        "a filter is malformed": _all(p["filters"], filter_rules),
    }


def violations(tables: Tables) -> DataFrame:
    """file_id, place, rule of everything that breaks a rule."""
    found = _rules(tables.files, F.lit("file"), file_rules(F.col("api_version"), F.col("root")))
    found = found.unionByName(_rules(tables.groups, F.concat(F.lit("groups/"), "uuid"), group_rules(F.col("alias"))))
    key = key_rules(F.col("uuid"), F.col("alias"))
    props = F.from_json("creation_properties", PROPERTIES)
    found = found.unionByName(_rules(tables.datasets, F.concat(F.lit("datasets/"), "uuid"), key | space_rules(F.col("shape")) | property_rules(props)))
    found = found.unionByName(_rules(tables.datatypes, F.concat(F.lit("datatypes/"), "uuid"), key))
    found = found.unionByName(_rules(tables.links, F.concat_ws("/", F.lit("groups"), "group_uuid", F.lit("links"), F.col("ordinal").cast("string")), link_rules()))
    a = F.concat_ws("/", "owner_collection", "owner_uuid", F.lit("attributes"), F.col("ordinal").cast("string"))
    found = found.unionByName(_rules(tables.attributes, a, attribute_rules(F.col("name"), F.col("shape"))))
    typed = tables.datasets.select("file_id", F.concat(F.lit("datasets/"), "uuid").alias("place"), "type_json")
    typed = typed.unionByName(tables.datatypes.select("file_id", F.concat(F.lit("datatypes/"), "uuid").alias("place"), "type_json")).unionByName(tables.attributes.select("file_id", a.alias("place"), "type_json"))
    checked = typed.select("type_json").distinct().mapInPandas(_type_problems, "type_json string, problem string").where("problem is not null")
    bad = typed.join(checked, typed.type_json.eqNullSafe(checked.type_json)).select("file_id", "place", F.col("problem").alias("rule"))
    return found.unionByName(bad)


def _shape_or(shape: Column, name: str) -> Column:
    return F.coalesce(shape, F.struct(F.lit(name).alias("class"), F.lit(None).alias("dims"), F.lit(None).alias("maxdims")).cast(SHAPE))


def _checked(d: Column) -> Column:
    """found (place and rule of broken rules, but for types) and typed (place and text of each type) of a parsed document, within its row."""
    found, typed = [_placed(F.lit("file"), file_rules(d["apiVersion"], d["root"]))], []
    for c in ("groups", "datasets", "datatypes"):
        objects = F.map_entries(d[c])
        each = lambda use, objects=objects, c=c: F.flatten(F.transform(objects, lambda e: F.coalesce(use(F.concat(F.lit(f"{c}/"), e["key"]), e["key"], e["value"]), F.array())))
        inner = lambda name, use: lambda place, _, o: F.flatten(F.transform(o[name], lambda x, k: use(F.concat_ws("/", place, F.lit(name), k.cast("string")), x)))
        if c == "groups":
            found.append(each(lambda place, key, o: _placed(place, group_rules(o["alias"]))))
            found.append(each(inner("links", lambda place, x: _placed(place, link_rules(lambda name: x[name])))))
        elif c == "datasets":
            rules = lambda place, key, o: let(F.from_json(o["creationProperties"], PROPERTIES), lambda p: _placed(place, key_rules(key, o["alias"]) | space_rules(_shape_or(o["shape"], "H5S_SCALAR")) | property_rules(p)))
            found.append(each(rules))
        else:
            found.append(each(lambda place, key, o: _placed(place, key_rules(key, o["alias"]))))
        found.append(each(inner("attributes", lambda place, x: _placed(place, attribute_rules(x["name"], _shape_or(x["shape"], "H5S_NULL"))))))
        text = lambda place, x: F.array(F.struct(place.alias("place"), x["type"].alias("type_json")))
        if c != "groups":
            typed.append(each(lambda place, _, o: text(place, o)))
        typed.append(each(inner("attributes", text)))
    joined = lambda lists, kind: F.concat(*(F.coalesce(x, F.array().cast(kind)) for x in lists))
    return F.struct(joined(found, FOUND).alias("found"), joined(typed, "array<struct<place: string, type_json: string>>").alias("typed"))


FOUND = "array<struct<place: string, rule: string>>"


def _placed(place: Column, rules: dict[str, Column]) -> Column:
    return F.transform(_broken(rules), lambda name: F.struct(place.alias("place"), name.alias("rule")))


def validate(texts: DataFrame) -> DataFrame:
    """file_id, valid, violations of each text (file_id, text); a text that is no document is invalid.

    One pass without a shuffle: every rule is checked within the text's row.
    """
    parsed = let(F.from_json("text", DOCUMENT), lambda d: F.when(d["root"].isNotNull(), _checked(d)))
    rows = texts.select("file_id", parsed.alias("d")).select("file_id", "d", F.coalesce("d.typed.type_json", F.array().cast("array<string>")).alias("types"))
    problem = F.arrow_udf(_list_problems, "array<string>")
    rows = rows.withColumn("problems", problem("types"))
    typed = F.zip_with("d.typed", "problems", lambda t, problem: F.struct(t["place"].alias("place"), problem.alias("rule")))
    found = F.sort_array(F.concat("d.found", F.filter(typed, lambda x: x["rule"].isNotNull())))
    none = F.array(F.struct(F.lit("file").alias("place"), F.lit("no document").alias("rule")))
    out = rows.select("file_id", F.coalesce(found, none).alias("violations"))
    return out.select("file_id", (F.size("violations") == 0).alias("valid"), "violations")
