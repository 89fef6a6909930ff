"""Type descriptors: checked, sized, printed in canonical form, and turned into Spark types and back.

A descriptor is a JSON object with a class, or the name of a predefined number type, or a reference
to a named type (``datatypes/<uuid>``). Everything here runs on the driver: descriptors are small.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

from pyspark.sql import types as T

VARIABLE = "H5T_VARIABLE"
UUID = re.compile(r"^[a-f0-9]{8}(-[a-f0-9]{4}){3}-[a-f0-9]{12}$")
_NUMBER = re.compile(r"^H5T_(STD_I|STD_U|IEEE_F)(\d+)(LE|BE)?$")
_INTEGERS = {("I", 8): T.ByteType(), ("I", 16): T.ShortType(), ("I", 32): T.IntegerType(), ("I", 64): T.LongType(), ("U", 8): T.ShortType(), ("U", 16): T.IntegerType(), ("U", 32): T.LongType(), ("U", 64): T.DecimalType(20, 0)}
_FLOATS = {32: T.FloatType(), 64: T.DoubleType()}
REFERENCE = T.StructType([T.StructField("collection", T.StringType()), T.StructField("id", T.StringType())])
REGION = T.StructType([T.StructField("id", T.StringType()), T.StructField("select_type", T.StringType()), T.StructField("selection", T.StringType())])


class UnsupportedType(TypeError):
    """A type that can be described, but not read or written."""


def number(name: str) -> tuple[str, int, str]:
    """(I, U or F; bits; LE or BE) of a predefined number type; a missing order is LE."""
    found = _NUMBER.match(name) if isinstance(name, str) else None
    if not found:
        raise TypeError(f"not a predefined number type: {name!r}")
    return found[1][-1], int(found[2]), found[3] or "LE"


def number_code(name: str) -> str:
    """The array code of a predefined number type, such as >i4 or <f8."""
    letter, bits, order = number(name)
    if bits not in ((32, 64) if letter == "F" else (8, 16, 32, 64)):
        raise TypeError(f"no number type of {bits} bits: {name!r}")
    return ("<" if order == "LE" else ">") + letter.lower() + str(bits // 8)


def parse(item: Any) -> dict:
    """A descriptor as an object; the name of a number type becomes one."""
    if isinstance(item, str) and item[:1] in "{[":
        item = json.loads(item)
    if isinstance(item, str):
        letter, _, _ = number(item)
        return {"class": "H5T_FLOAT" if letter == "F" else "H5T_INTEGER", "base": item}
    if not isinstance(item, dict):
        raise TypeError("a type is an object or a name")
    if "class" not in item:
        raise KeyError("a type needs a class")
    return item


def _need(item: dict, key: str) -> Any:
    if key not in item:
        raise KeyError(f"{item['class']} needs {key}")
    return item[key]


def _fields(item: dict) -> list[dict]:
    fields = _need(item, "fields")
    if not isinstance(fields, list):
        raise TypeError("fields is a list")
    if not fields:
        raise KeyError("a compound needs a field")
    for x in fields:
        if not isinstance(x, dict):
            raise TypeError("a field is an object")
        if "name" not in x or "type" not in x:
            raise KeyError("a field needs a name and a type")
    return fields


def dims_of(item: dict) -> list[int]:
    dims = item.get("dims", [])
    dims = [dims] if isinstance(dims, int) else list(dims)
    if any(not isinstance(d, int) or d < 0 for d in dims):
        raise TypeError("dims are whole numbers")
    return dims


def item_size(item: Any) -> int | str:
    """Bytes of one element, or H5T_VARIABLE."""
    item = parse(item)
    kind = item["class"]
    if kind in ("H5T_INTEGER", "H5T_FLOAT"):
        size: int | str = number(_need(item, "base"))[1] // 8
    elif kind == "H5T_STRING":
        size = _need(item, "length")
    elif kind in ("H5T_VLEN", "H5T_REFERENCE"):
        size = VARIABLE
    elif kind == "H5T_OPAQUE":
        size = int(_need(item, "size"))
    elif kind in ("H5T_ARRAY", "H5T_ENUM"):
        if kind == "H5T_ARRAY":
            _need(item, "dims")
        size = item_size(_need(item, "base"))
    elif kind == "H5T_COMPOUND":
        sizes = [item_size(x["type"]) for x in _fields(item)]
        size = VARIABLE if VARIABLE in sizes else sum(sizes)
    else:
        raise TypeError(f"no such class of types: {kind}")
    return size if size == VARIABLE else size * math.prod(dims_of(item))


def canonical(item: Any) -> Any:
    """The printed form: named types as their reference, sizes and tags left out where they follow from the rest."""
    if isinstance(item, dict) and "uuid" in item:
        return f"datatypes/{item['uuid']}"
    if isinstance(item, str) and item.startswith("datatypes/"):
        return item
    item = parse(item)
    kind = item["class"]
    if kind in ("H5T_INTEGER", "H5T_FLOAT", "H5T_REFERENCE"):
        return {"class": kind, "base": item["base"]}
    if kind == "H5T_OPAQUE":
        return {"class": kind, "size": item["size"]}
    if kind == "H5T_COMPOUND":
        return {"class": kind, "fields": [{"name": x["name"], "type": canonical(x["type"])} for x in _fields(item)]}
    kept = {k: v for k, v in item.items() if k not in ("size", "base_size")}
    if isinstance(kept.get("base"), dict):
        kept["base"] = canonical(kept["base"])
    return kept


def is_boolean(item: dict) -> bool:
    """An 8-bit enumeration of exactly FALSE and TRUE."""
    if item["class"] != "H5T_ENUM":
        return False
    base, members = item.get("base"), members_of(item)
    base = base.get("base") if isinstance(base, dict) else base
    return isinstance(base, str) and base.startswith("H5T_STD_I8") and members == {"FALSE": 0, "TRUE": 1}


def members_of(item: dict) -> dict[str, int]:
    """Names and values of an enumeration, from either way of writing them."""
    members = item.get("members", item.get("mapping"))
    if not members:
        raise KeyError("an enumeration needs members")
    return dict(members) if isinstance(members, dict) else {x["name"]: x["value"] for x in members}


def spark_type(item: Any, named: dict[str, Any] | None = None) -> T.DataType:
    """The Spark type of one element. named: descriptors of named types by uuid."""
    item = parse(resolve(item, named))
    kind = item["class"]
    if kind in ("H5T_INTEGER", "H5T_FLOAT"):
        letter, bits, _ = number(_need(item, "base"))
        found = _FLOATS.get(bits) if letter == "F" else _INTEGERS.get((letter, bits))
        if found is None or (letter == "F") != (kind == "H5T_FLOAT"):
            raise TypeError(f"no Spark type for {item['base']}")
    elif kind == "H5T_STRING":
        _need(item, "length")
        if item["length"] != VARIABLE and item.get("charSet") == "H5T_CSET_UTF8":
            raise UnsupportedType("strings of fixed length are ASCII")
        found = T.StringType()
    elif kind == "H5T_COMPOUND":
        found = T.StructType([T.StructField(x["name"], spark_type(x["type"], named)) for x in _fields(item)])
    elif kind == "H5T_ARRAY":
        found = spark_type(_need(item, "base"), named)
        for _ in _need(item, "dims") if isinstance(item["dims"], list) else [item["dims"]]:
            found = T.ArrayType(found)
        return found
    elif kind == "H5T_VLEN":
        found = T.ArrayType(spark_type(_need(item, "base"), named))
    elif kind == "H5T_ENUM":
        base = spark_type(_need(item, "base"), named)
        members_of(item)
        if not isinstance(base, (T.IntegralType, T.DecimalType)):
            raise TypeError("an enumeration is of integers")
        found = T.BooleanType() if is_boolean(item) else base
    elif kind == "H5T_OPAQUE":
        _need(item, "size")
        found = T.BinaryType()
    elif kind == "H5T_REFERENCE":
        found = {"H5T_STD_REF_OBJ": REFERENCE, "H5T_STD_REF_DSETREG": REGION}.get(_need(item, "base"))
        if found is None:
            raise TypeError(f"no such reference: {item['base']}")
    elif kind == "H5T_BITFIELD":
        raise UnsupportedType("bit fields are described, not read")
    else:
        raise TypeError(f"no such class of types: {kind}")
    for _ in dims_of(item):
        found = T.ArrayType(found)
    return found


def resolve(item: Any, named: dict[str, Any] | None) -> Any:
    """The descriptor that a uuid or a reference to a named type stands for."""
    if isinstance(item, str) and not item.startswith("{"):
        key = item.removeprefix("datatypes/")
        if UUID.match(key):
            if not named or key not in named:
                raise LookupError(f"no named type {key}")
            return resolve(named[key], named)
    return item


def type_item(kind: T.DataType, length: int | None = None) -> dict:
    """The descriptor of a Spark type. length: bytes of a fixed string."""
    order = "LE"
    simple = {T.ByteType: "I8", T.ShortType: "I16", T.IntegerType: "I32", T.LongType: "I64"}
    for cls, code in simple.items():
        if isinstance(kind, cls):
            return {"class": "H5T_INTEGER", "base": f"H5T_STD_{code}{order}"}
    if isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= 20:
        return {"class": "H5T_INTEGER", "base": f"H5T_STD_U64{order}"}
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return {"class": "H5T_FLOAT", "base": f"H5T_IEEE_F{32 if isinstance(kind, T.FloatType) else 64}{order}"}
    if isinstance(kind, T.BooleanType):
        return {"class": "H5T_ENUM", "base": {"class": "H5T_INTEGER", "base": "H5T_STD_I8LE"}, "members": [{"name": "FALSE", "value": 0}, {"name": "TRUE", "value": 1}]}
    if isinstance(kind, T.StringType):
        if length is None:
            return {"class": "H5T_STRING", "charSet": "H5T_CSET_UTF8", "length": VARIABLE, "strPad": "H5T_STR_NULLTERM"}
        return {"class": "H5T_STRING", "charSet": "H5T_CSET_ASCII", "length": length, "strPad": "H5T_STR_NULLPAD"}
    if kind in (REFERENCE, REGION):
        return {"class": "H5T_REFERENCE", "base": "H5T_STD_REF_OBJ" if kind == REFERENCE else "H5T_STD_REF_DSETREG"}
    if isinstance(kind, T.StructType):
        return {"class": "H5T_COMPOUND", "fields": [{"name": x.name, "type": type_item(x.dataType)} for x in kind.fields]}
    if isinstance(kind, T.ArrayType):
        return {"class": "H5T_VLEN", "size": VARIABLE, "base": type_item(kind.elementType)}
    raise TypeError(f"no type for {kind.simpleString()}")
