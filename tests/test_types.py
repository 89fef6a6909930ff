import pytest
from pyspark.sql import types as T

from treeslab.functions import spaces
from treeslab.functions import types as Y

TEXT = {"class": "H5T_STRING", "charSet": "H5T_CSET_ASCII", "length": Y.VARIABLE, "strPad": "H5T_STR_NULLTERM"}
SIX = {"class": "H5T_STRING", "charSet": "H5T_CSET_ASCII", "length": 6, "strPad": "H5T_STR_NULLPAD"}
COLOURS = {"class": "H5T_ENUM", "base": {"class": "H5T_INTEGER", "base": "H5T_STD_I16BE"}, "members": [{"name": "RED", "value": 0}, {"name": "BLUE", "value": 2}]}
FLAG = {"class": "H5T_ENUM", "base": {"class": "H5T_INTEGER", "base": "H5T_STD_I8LE"}, "members": [{"name": "FALSE", "value": 0}, {"name": "TRUE", "value": 1}]}


@pytest.mark.parametrize(
    ("item", "size", "kind"),
    [
        ("H5T_STD_I8LE", 1, "tinyint"),
        ("H5T_STD_U8BE", 1, "smallint"),
        ("H5T_STD_U32LE", 4, "bigint"),
        ("H5T_STD_U64BE", 8, "decimal(20,0)"),
        ("H5T_IEEE_F32BE", 4, "float"),
        ("H5T_IEEE_F64LE", 8, "double"),
        (TEXT, Y.VARIABLE, "string"),
        (SIX, 6, "string"),
        (COLOURS, 2, "smallint"),
        (FLAG, 1, "boolean"),
        ({"class": "H5T_ARRAY", "base": "H5T_STD_I32LE", "dims": [2, 2]}, 16, "array<array<int>>"),
        ({"class": "H5T_VLEN", "base": "H5T_STD_I64LE"}, Y.VARIABLE, "array<bigint>"),
        ({"class": "H5T_OPAQUE", "size": 200, "tag": ""}, 200, "binary"),
        ({"class": "H5T_REFERENCE", "base": "H5T_STD_REF_OBJ"}, Y.VARIABLE, "struct<collection:string,id:string>"),
        ({"class": "H5T_COMPOUND", "fields": [{"name": "a", "type": "H5T_STD_I32LE"}, {"name": "b", "type": SIX}]}, 10, "struct<a:int,b:string>"),
        ({"class": "H5T_COMPOUND", "fields": [{"name": "a", "type": TEXT}, {"name": "b", "type": "H5T_STD_I32LE"}]}, Y.VARIABLE, "struct<a:string,b:int>"),
    ],
)
def test_size_and_spark_type(item, size, kind):
    assert Y.item_size(item) == size
    assert Y.spark_type(item).simpleString() == kind


@pytest.mark.parametrize("item", ["H5T_STD_X8LE", 7, {"class": "H5T_NONE"}, {"class": "H5T_COMPOUND", "fields": {}}, {"class": "H5T_FLOAT", "base": "H5T_IEEE_F16LE"}])
def test_bad_types(item):
    with pytest.raises(TypeError):
        Y.spark_type(item)


@pytest.mark.parametrize("item", [{}, {"class": "H5T_COMPOUND", "fields": []}, {"class": "H5T_INTEGER"}, {"class": "H5T_STRING"}, {"class": "H5T_ENUM", "base": "H5T_STD_I8LE", "members": []}])
def test_missing_parts(item):
    with pytest.raises(KeyError):
        Y.spark_type(item)


def test_unsupported():
    with pytest.raises(Y.UnsupportedType):
        Y.spark_type({"class": "H5T_BITFIELD", "base": "H5T_STD_B8LE"})
    with pytest.raises(Y.UnsupportedType):
        Y.spark_type({"class": "H5T_STRING", "charSet": "H5T_CSET_UTF8", "length": 4, "strPad": "H5T_STR_NULLPAD"})


def test_round_trip():
    kind = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.ArrayType(T.DoubleType())), T.StructField("d", T.BooleanType())])
    assert Y.spark_type(Y.type_item(kind)) == kind


def test_canonical():
    uuid = "0" * 8 + "-0000" * 3 + "-" + "0" * 12
    assert Y.canonical({"class": "H5T_INTEGER", "base": "H5T_STD_I8LE", "size": 1, "uuid": uuid}) == f"datatypes/{uuid}"
    assert Y.canonical({"class": "H5T_OPAQUE", "size": 3, "tag": ""}) == {"class": "H5T_OPAQUE", "size": 3}
    array = {"class": "H5T_ARRAY", "base_size": 4, "dims": [3], "base": {"class": "H5T_INTEGER", "base": "H5T_STD_I32LE", "size": 4}}
    assert Y.canonical(array) == {"class": "H5T_ARRAY", "dims": [3], "base": {"class": "H5T_INTEGER", "base": "H5T_STD_I32LE"}}
    assert Y.resolve(uuid, {uuid: "H5T_STD_I8LE"}) == "H5T_STD_I8LE"
    with pytest.raises(LookupError):
        Y.resolve(uuid, {})


def test_codes():
    assert [Y.number_code(x) for x in ("H5T_STD_I16BE", "H5T_STD_U8LE", "H5T_IEEE_F64LE", "H5T_STD_I32")] == [">i2", "<u1", "<f8", "<i4"]
    with pytest.raises(TypeError):
        Y.number_code("H5T_STD_I12LE")


def test_spaces():
    assert spaces.space(None) == {"class": "H5S_NULL"}
    assert spaces.space([]) == {"class": "H5S_SCALAR"}
    assert spaces.space([10, 10], [10, None]) == {"class": "H5S_SIMPLE", "dims": [10, 10], "maxdims": [10, "H5S_UNLIMITED"]}
    assert spaces.space(5, [5]) == {"class": "H5S_SIMPLE", "dims": [5]}
    assert spaces.elements(spaces.space([3, 0])) == 0 and spaces.elements(spaces.space([])) == 1 and spaces.elements(spaces.space(None)) == 0
    with pytest.raises(ValueError):
        spaces.space([4], [3])
