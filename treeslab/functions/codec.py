"""Values between JSON text, typed columns and raw bytes, as Column expressions.

Records are positional lists in JSON and structs by name in Spark. A text of unknown shape is cut one level at
a time (``array<string>`` keeps nested JSON as text); plain numbers are read in one step.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeslab.functions import types as Y

OPAQUE = "???"


def decode(text: Column, item: Any, rank: int = 0, named: dict[str, Any] | None = None) -> Column:
    """A typed column from JSON text: rank nested lists of elements of the type."""
    item = Y.parse(Y.resolve(item, named))
    dims = Y.dims_of(item) if item["class"] != "H5T_ARRAY" else []
    return _lists(text, rank + len(dims), item, named)


def _lists(text: Column, depth: int, item: dict, named: dict[str, Any] | None) -> Column:
    if depth and item["class"] in ("H5T_INTEGER", "H5T_FLOAT"):
        kind: T.DataType = Y.spark_type({"class": item["class"], "base": item["base"]})
        for _ in range(depth):
            kind = T.ArrayType(kind)
        return F.from_json(text, kind)
    if depth == 0:
        return _element(text, item, named)
    return F.transform(F.from_json(text, "array<string>"), lambda x: _lists(x, depth - 1, item, named))


def _element(text: Column, item: dict, named: dict[str, Any] | None) -> Column:
    kind = item["class"]
    if kind in ("H5T_INTEGER", "H5T_FLOAT"):
        return text.try_cast(Y.spark_type({"class": kind, "base": item["base"]}))
    if kind == "H5T_STRING":
        return text if item["length"] == Y.VARIABLE else F.regexp_replace(text, "\\x00+$", "")
    if kind == "H5T_ENUM":
        return text.try_cast("boolean") if Y.is_boolean(item) else text.try_cast(Y.spark_type(item["base"]))
    if kind == "H5T_COMPOUND":
        parts = F.from_json(text, "array<string>")
        return F.when(text.isNotNull(), F.struct(*(decode(F.get(parts, k), x["type"], 0, named).alias(x["name"]) for k, x in enumerate(item["fields"]))))
    if kind == "H5T_ARRAY":
        return decode(text, item["base"], len(Y.dims_of(item)), named)
    if kind == "H5T_VLEN":
        return decode(text, item["base"], 1, named)
    if kind == "H5T_REFERENCE":
        return reference(text) if item["base"] == "H5T_STD_REF_OBJ" else F.from_json(text, Y.REGION)
    if kind == "H5T_OPAQUE":
        return F.lit(None).cast("binary")
    raise Y.UnsupportedType(kind)


def reference(text: Column) -> Column:
    """struct<collection, id> of "collection/uuid"; null, "" and "null" are the null reference; a malformed one fails."""
    blank = text.isNull() | text.isin("", "null")
    good = text.rlike("^(groups|datasets|datatypes)/[^/]+$")
    made = F.struct(F.substring_index(text, "/", 1).alias("collection"), F.substring_index(text, "/", -1).alias("id"))
    return F.when(blank, F.lit(None)).when(good, made).otherwise(F.raise_error(F.concat(F.lit("malformed reference: "), text)).cast(Y.REFERENCE))


def reference_text(ref: Column) -> Column:
    """"collection/uuid" of a reference; "null" of the null reference."""
    return F.coalesce(F.concat(ref["collection"], F.lit("/"), ref["id"]), F.lit("null"))


def encode(value: Column, item: Any, rank: int = 0, named: dict[str, Any] | None = None) -> Column:
    """JSON text of a typed column."""
    item = Y.parse(Y.resolve(item, named))
    dims = Y.dims_of(item) if item["class"] != "H5T_ARRAY" else []
    return _text_lists(value, rank + len(dims), lambda x: _text(x, item, named))


def _text_lists(value: Column, depth: int, inner: Callable[[Column], Column]) -> Column:
    if depth == 0:
        return inner(value)
    body = F.transform(value, lambda x: _text_lists(x, depth - 1, inner))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), F.array_join(body, ","), F.lit("]")))


def quoted(text: Column) -> Column:
    """A string as JSON."""
    one = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substr(one, F.lit(2), F.length(one) - 2))


def _text(value: Column, item: dict, named: dict[str, Any] | None) -> Column:
    kind = item["class"]
    if kind == "H5T_STRING":
        return quoted(value)
    if kind == "H5T_COMPOUND":
        fields = [encode(value[x["name"]], x["type"], 0, named) for x in item["fields"]]
        return F.concat(F.lit("["), F.concat_ws(",", *fields), F.lit("]"))
    if kind == "H5T_ARRAY":
        return encode(value, item["base"], len(Y.dims_of(item)), named)
    if kind == "H5T_VLEN":
        return encode(value, item["base"], 1, named)
    if kind == "H5T_REFERENCE":
        return quoted(reference_text(value)) if item["base"] == "H5T_STD_REF_OBJ" else F.coalesce(F.to_json(value), F.lit("null"))
    if kind == "H5T_OPAQUE":
        return F.lit(f'"{OPAQUE}"')
    return F.coalesce(value.cast("string"), F.lit("null"))


def by_ordinal(values: Column, names: list[str]) -> Column:
    """A list's entries as a struct with the names in order."""
    return F.struct(*(F.get(values, k).alias(x) for k, x in enumerate(names)))


def utf8(raw: Column) -> Column:
    return F.decode(raw, "UTF-8")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _swapped(digits: Column, size: int) -> Column:
    return let(digits, lambda x: F.concat(*(F.substring(x, 2 * k + 1, 2) for k in range(size - 1, -1, -1))))


def integer_hex(value: Column, base: str) -> Column:
    """Raw bytes of an integer, as hex digits, in the order of its type; two's complement."""
    letter, bits, order = Y.number(base)
    if letter == "F":
        raise TypeError(f"{base} is no integer")
    size = bits // 8
    if (letter, bits) == ("U", 64):
        value = F.when(value >= F.lit(Decimal(2**63)), value - F.lit(Decimal(2**64))).otherwise(value)
    digits = F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * size))
    return digits if order == "BE" else _swapped(digits, size)


def hex_integer(digits: Column, base: str) -> Column:
    """The integer of raw bytes given as hex digits."""
    letter, bits, order = Y.number(base)
    size = bits // 8
    digits = digits if order == "BE" else _swapped(digits, size)
    whole = F.conv(digits, 16, 10).cast("decimal(20,0)")
    signed = let(whole, lambda x: F.when(x >= F.lit(Decimal(2 ** (bits - 1))), x - F.lit(Decimal(2**bits))).otherwise(x)) if letter == "I" else whole
    return signed.cast(Y.spark_type(base))


def string_hex(value: Column, length: int) -> Column:
    """Raw bytes of a fixed string, as hex digits: cut to its length, or padded with NULs."""
    return F.rpad(F.substring(F.hex(F.encode(value, "UTF-8")), 1, 2 * length), 2 * length, "0")


def hex_string(digits: Column) -> Column:
    """The string of raw bytes without its NUL padding."""
    return F.regexp_replace(F.decode(F.unhex(digits), "UTF-8"), "\\x00+$", "")


def _fixed(item: Any) -> dict:
    item = Y.parse(item)
    if Y.item_size(item) == Y.VARIABLE:
        raise Y.UnsupportedType("types of variable size have no raw form")
    return item


def value_hex(value: Column, item: Any) -> Column:
    """Raw bytes of a value of any type of fixed size, as hex digits: numbers, strings, enumerations, opaque bytes, arrays, records and records in them."""
    item = _fixed(item)
    kind = item["class"]
    if kind == "H5T_STRING":
        return string_hex(value, item["length"])
    if kind == "H5T_INTEGER":
        return integer_hex(value, item["base"])
    if kind == "H5T_FLOAT":
        return float_hex(value, item["base"])
    if kind == "H5T_ENUM":
        return value_hex(value.cast("int") if Y.is_boolean(item) else value, item["base"])
    if kind == "H5T_OPAQUE":
        return F.rpad(F.substring(F.hex(value), 1, 2 * item["size"]), 2 * item["size"], "0")
    if kind == "H5T_ARRAY":
        dims = Y.dims_of(item)
        for _ in dims[1:]:
            value = F.flatten(value)
        pieces = F.array_join(F.transform(value, lambda x: value_hex(x, item["base"])), "")
        return F.when(F.size(value) == math.prod(dims), pieces).otherwise(F.raise_error(F.lit(f"an array of {dims} has {math.prod(dims)} elements")).cast("string"))
    if kind == "H5T_COMPOUND":
        return record_hex([(value[x["name"]], x["type"]) for x in item["fields"]])
    raise Y.UnsupportedType(kind)


def record_hex(fields: list[tuple[Column, Any]]) -> Column:
    """Raw bytes of a record, fields in order, as hex digits."""
    return F.concat(*(value_hex(value, item) for value, item in fields))


def hex_value(digits: Column, item: Any) -> Column:
    """The value of raw bytes given as hex digits; what value_hex made. Strings lose their padding."""
    item = _fixed(item)
    kind = item["class"]
    if kind == "H5T_STRING":
        return hex_string(digits)
    if kind == "H5T_INTEGER":
        return hex_integer(digits, item["base"])
    if kind == "H5T_FLOAT":
        return hex_float(digits, item["base"])
    if kind == "H5T_ENUM":
        number = hex_value(digits, item["base"])
        return number != 0 if Y.is_boolean(item) else number
    if kind == "H5T_OPAQUE":
        return F.unhex(digits)
    if kind == "H5T_ARRAY":
        dims, size = Y.dims_of(item), 2 * Y.item_size(item["base"])
        out = F.transform(F.sequence(F.lit(0), F.lit(math.prod(dims) - 1)), lambda k: hex_value(F.substring(digits, k * size + 1, F.lit(size)), item["base"]))
        for d in dims[:0:-1]:
            out = F.transform(F.sequence(F.lit(1), F.size(out), F.lit(d)), lambda k, out=out, d=d: F.slice(out, k, F.lit(d)))
        return out
    if kind == "H5T_COMPOUND":
        parts, at = [], 1
        for x in item["fields"]:
            size = 2 * Y.item_size(x["type"])
            parts.append(hex_value(F.substring(digits, at, size), x["type"]).alias(x["name"]))
            at += size
        return F.struct(*parts)
    raise Y.UnsupportedType(kind)


def read_raw(raw: Column, item: Any, count: int) -> Column:
    """The values of count elements' raw bytes, as a list."""
    return F.transform(split_records(raw, item, count), lambda x: hex_value(x, item))


def split_records(raw: Column, item: Any, count: int) -> Column:
    """count elements' hex digits of raw bytes; the length has to fit."""
    size = Y.item_size(item)
    if size == Y.VARIABLE:
        raise Y.UnsupportedType("types of variable size have no raw form")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.hex(F.substring(raw, (k * size + 1).cast("int"), F.lit(size))))
    return F.when(F.octet_length(raw) == count * size, pieces).otherwise(F.raise_error(F.lit(f"{count} elements take {count * size} bytes")).cast("array<string>"))


#: Bits of the exponent and of the fraction. (Fixed values of the standard.)
_FLOAT_BITS = {32: (8, 23), 64: (11, 52)}


def float_hex(value: Column, base: str) -> Column:
    """Raw bytes of a float, as hex digits, by exact arithmetic on its exponent and fraction."""
    letter, bits, order = Y.number(base)
    if letter != "F":
        raise TypeError(f"{base} is no float")
    exponent_bits, fraction_bits = _FLOAT_BITS[bits]
    bias = 2 ** (exponent_bits - 1) - 1
    two = lambda n: F.pow(F.lit(2.0), n)
    lift = bias - 1 + fraction_bits  # a number below the normal ones counts 2 ** -lift
    top = (2**exponent_bits - 1) << fraction_bits

    def of(value: Column) -> Column:
        negative = value.cast("string").startswith("-")
        pattern = let(F.abs(value), lambda size: let(F.floor(F.log2(size)).cast("int"), lambda guess: let(F.when(two(guess) > size, guess - 1).when(two(guess + 1) <= size, guess + 1).otherwise(guess), lambda power: bits_of(size, power))))
        return let(pattern, lambda x: F.right(F.lpad(F.hex(F.when(negative, x.bitwiseOR(F.lit(-(1 << 63) if bits == 64 else 1 << 31))).otherwise(x)), 16, "0"), F.lit(bits // 4)))

    def bits_of(size: Column, power: Column) -> Column:
        low = (size * F.lit(2.0 ** (lift // 2)) * F.lit(2.0 ** (lift - lift // 2))).cast("long")
        normal = F.shiftleft((power + bias).cast("long"), fraction_bits) + ((size / two(power) - 1) * F.lit(2.0**fraction_bits)).cast("long")
        return F.when(F.isnan(size), F.lit(top + (1 << (fraction_bits - 1)))).when(size == F.lit(float("inf")), F.lit(top)).when(size < 2.0 ** (1 - bias), low).otherwise(normal)

    digits = let(value.cast("float").cast("double") if bits == 32 else value.cast("double"), of)
    return digits if order == "BE" else _swapped(digits, bits // 8)


def hex_float(digits: Column, base: str) -> Column:
    """The float of raw bytes given as hex digits."""
    letter, bits, order = Y.number(base)
    if letter != "F":
        raise TypeError(f"{base} is no float")
    exponent_bits, fraction_bits = _FLOAT_BITS[bits]
    bias = 2 ** (exponent_bits - 1) - 1

    def of(digits: Column) -> Column:
        first = F.conv(F.substring(digits, 1, 4), 16, 10).cast("long")
        pattern = F.conv(F.concat(F.lpad(F.hex(first.bitwiseAND(F.lit(0x7FFF))), 4, "0"), F.substr(digits, F.lit(5))), 16, 10).cast("long")
        size = let(pattern, lambda x: size_of(F.shiftright(x, fraction_bits), x.bitwiseAND(F.lit((1 << fraction_bits) - 1)).cast("double")))
        return let(size, lambda x: F.when(digits.isNotNull(), F.when(first >= 0x8000, -x).otherwise(x)))

    def size_of(exponent: Column, fraction: Column) -> Column:
        small = fraction * F.lit(2.0 ** (1 - bias - fraction_bits)) if bits == 32 else fraction * F.lit(2.0**-537) * F.lit(2.0**-537)
        normal = (F.lit(1.0) + fraction / F.lit(2.0**fraction_bits)) * F.pow(F.lit(2.0), (exponent - bias).cast("double"))
        return F.when(exponent == 0, small).when(exponent < 2**exponent_bits - 1, normal).otherwise(F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))

    out = let(digits if order == "BE" else _swapped(digits, bits // 8), of)
    return out.cast("float") if bits == 32 else out
