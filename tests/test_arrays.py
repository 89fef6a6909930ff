import itertools

import pytest
from pyspark.sql import functions as F

from treeslab.functions import codec
from treeslab.functions import types as Y
from treeslab.operators import select as S


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(i, j, i * j) for i in range(10) for j in range(10)], "i0 long, i1 long, value int")


def got(rows):
    return sorted(map(tuple, rows.collect()))


def test_hyperslab_in_both_forms(spark, grid):
    nested = spark.createDataFrame([([[i * j for j in range(10)] for i in range(10)],)], "v array<array<int>>")
    for text in (["2:8:3", "1:10:4"], [None, "0:1"], ["9:10", None], ["3:3", None], [4, 5]):
        slabs = S.slabs(text, [10, 10])
        want = sorted((i, j, i * j) for i in range(*slabs[0]) for j in range(*slabs[1]))
        assert got(S.hyperslab(grid, slabs)) == want
        part = nested.select(S.cut(F.col("v"), slabs).alias("v")).first().v
        assert part == [[i * j for j in range(*slabs[1])] for i in range(*slabs[0])]
        assert S.shape_of(slabs) == [len(range(*s)) for s in slabs]


@pytest.mark.parametrize("bad", [["0:11", None], [-1, None], ["5:2", None], [None], ["0:5:0", None]])
def test_bad_slabs(bad):
    with pytest.raises((ValueError, TypeError)):
        if bad == ["0:5:0", None]:
            S.slab((0, 5, 0), 10)
        S.slabs(bad, [10, 10])


def test_points(spark, grid):
    points = spark.createDataFrame([(0, 3, 3), (1, 0, 9), (2, 3, 3)], "pos int, i0 long, i1 long")
    assert [r.value for r in S.points(grid, points, ["i0", "i1"], [10, 10]).collect()] == [9, 0, 9]
    with pytest.raises(Exception, match="out of bounds"):
        S.points(grid, points, ["i0", "i1"], [3, 3]).collect()


def test_regions(grid):
    blocks = [[[0, 0], [2, 3]], [[1, 2], [4, 4]]]
    want = sorted((i, j, i * j) for i, j in itertools.product(range(10), range(10)) if (i < 2 and j < 3) or (1 <= i < 4 and 2 <= j < 4))
    assert got(S.region(grid, S.HYPERSLABS, blocks, ["i0", "i1"])) == want
    assert S.region(grid, S.NONE, [], ["i0", "i1"]).count() == 0 and S.region(grid, S.ALL, [], ["i0", "i1"]).count() == 100
    assert got(S.region(grid, S.POINTS, [[1, 1], [2, 2], [1, 1]], ["i0", "i1"])) == [(1, 1, 1), (2, 2, 4)]
    assert S.inclusive_blocks([[[0, 0], [1, 2]]]) == [[[0, 0], [2, 3]]]
    for bad in ([[[0, 0], [0, 3]]], [[[-1, 0], [2, 3]]], [[[0], [2]]]):
        with pytest.raises(ValueError):
            S.region(grid, S.HYPERSLABS, bad, ["i0", "i1"])
    with pytest.raises(ValueError):
        S.region(grid, "H5S_SEL_ODD", [], ["i0", "i1"])


def test_writes(spark, grid):
    slabs = S.slabs(["0:10:5", "0:4:3"], [10, 10])
    new = spark.createDataFrame(S.from_block([[100, 101], [102, None]], slabs), "i0 long, i1 long, value int")
    after = {(r.i0, r.i1): r.value for r in S.write_slab(grid, new, ["i0", "i1"]).collect()}
    assert len(after) == 100 and (after[0, 0], after[0, 3], after[5, 0], after[5, 3], after[5, 4]) == (100, 101, 102, None, 20)
    with pytest.raises(ValueError):
        S.from_block([[1, 2]], slabs)
    points = spark.createDataFrame([(0, 1, 1, 7), (1, 1, 1, 8), (2, 2, 2, 9)], "pos int, i0 long, i1 long, value int")
    after = {(r.i0, r.i1): r.value for r in S.write_points(grid, points, ["i0", "i1"]).collect()}
    assert (after[1, 1], after[2, 2], after[3, 3]) == (8, 9, 9)


def test_resize_and_fill(spark, grid):
    grown = S.resize(grid, [10, 10], [10, 12], [10, None], -7)
    cells = {(r.i0, r.i1): r.value for r in grown.collect()}
    assert len(cells) == 120 and cells[3, 11] == -7 and cells[3, 3] == 9
    for new in ([9, 10], [11, 10], [10]):
        with pytest.raises(ValueError):
            S.resize(grid, [10, 10], new, [10, None], 0)
    assert S.filled(grid.where("value > 50"), [10, 10], 0).where("value = 0").count() == 100 - grid.where("value > 50").count()


def test_long_and_nested_again(spark):
    rows = spark.createDataFrame([("a", [[1, 2], [3]]), ("b", [[4]])], "k string, v array<array<int>>")
    long = S.to_long(rows, "v", 2)
    assert got(long) == [("a", 0, 0, 1), ("a", 0, 1, 2), ("a", 1, 0, 3), ("b", 0, 0, 4)]
    assert got(S.to_nested(long, 2, ["k"])) == [("a", [[1, 2], [3]]), ("b", [[4]])]


TEXT = {"class": "H5T_STRING", "length": Y.VARIABLE}
RECORD = {"class": "H5T_COMPOUND", "fields": [{"name": "date", "type": "H5T_STD_I64LE"}, {"name": "time", "type": {"class": "H5T_STRING", "length": 6}}, {"name": "deep", "type": {"class": "H5T_COMPOUND", "fields": [{"name": "x", "type": {"class": "H5T_VLEN", "base": "H5T_IEEE_F64LE"}}]}}]}


@pytest.mark.parametrize(
    ("item", "rank", "text", "value"),
    [
        ("H5T_STD_I32BE", 0, "7", 7),
        ("H5T_STD_I32BE", 2, "[[1,2],[3,4]]", [[1, 2], [3, 4]]),
        ("H5T_STD_U64LE", 0, "18446744073709551615", 18446744073709551615),
        (TEXT, 1, '["a \\"b\\"","","é"]', ['a "b"', "", "é"]),
        (RECORD, 1, '[[24,"13:53",[[1.5,2.0]]],[25,"9",[[]]]]', [(24, "13:53", ([1.5, 2.0],)), (25, "9", ([],))]),
        ({"class": "H5T_ARRAY", "base": TEXT, "dims": [2]}, 1, '[["a","b"],["c","d"]]', [["a", "b"], ["c", "d"]]),
        ({"class": "H5T_REFERENCE", "base": "H5T_STD_REF_OBJ"}, 1, '["groups/x","null"]', [("groups", "x"), None]),
    ],
)
def test_codec(spark, item, rank, text, value):
    row = spark.createDataFrame([(text,)], "t string").select(codec.decode(F.col("t"), item, rank).alias("v"))
    back = row.select("v", codec.encode(F.col("v"), item, rank).alias("t")).first()
    plain = lambda x: tuple(map(plain, x)) if isinstance(x, tuple) else [plain(y) for y in x] if isinstance(x, list) else int(x) if hasattr(x, "as_tuple") else x
    assert plain(back.v) == plain(value)
    assert back.t == text


def test_malformed_reference(spark):
    with pytest.raises(Exception, match="malformed"):
        spark.createDataFrame([("nowhere",)], "t string").select(codec.reference(F.col("t"))).collect()


@pytest.mark.parametrize("base", ["H5T_STD_I8LE", "H5T_STD_I16BE", "H5T_STD_I32LE", "H5T_STD_I64BE", "H5T_STD_U16LE", "H5T_STD_U64LE", "H5T_IEEE_F64BE", "H5T_IEEE_F32LE"])
def test_raw_bytes(spark, base):
    import numpy as np

    letter, bits, _ = Y.number(base)
    values = [0, 1, 100] if letter == "U" else [0, 1, -1, -100, 99]
    kind = "double" if letter == "F" else "decimal(20,0)" if bits == 64 else "long"
    rows = spark.createDataFrame([(v,) for v in values], "v long").select(F.col("v").cast(kind).alias("v"))
    raw = codec.float_hex(F.col("v"), base) if letter == "F" else codec.integer_hex(F.col("v"), base)
    out = rows.select("v", raw.alias("raw")).collect()
    assert [r.raw for r in out] == [np.array([v]).astype(Y.number_code(base)).tobytes().hex().upper() for v in values]
    if letter != "F":
        back = rows.select(codec.hex_integer(codec.integer_hex(F.col("v"), base), base).alias("b")).collect()
        assert [int(r.b) for r in back] == values


def test_raw_records(spark):
    rows = spark.createDataFrame([("sweet", 5)], "s string, n int")
    item = {"class": "H5T_STRING", "length": 7}
    out = rows.select(codec.string_hex(F.col("s"), 7).alias("raw"), codec.hex_string(codec.string_hex(F.col("s"), 7)).alias("s"), codec.record_hex([(F.col("s"), item), (F.col("n"), "H5T_STD_I16BE")]).alias("r")).first()
    assert bytes.fromhex(out.raw) == b"sweet\0\0" and out.s == "sweet" and bytes.fromhex(out.r) == b"sweet\0\0\0\5"
    parts = spark.createDataFrame([(bytearray(b"\1\0\2\0"),)], "b binary")
    assert parts.select(codec.split_records(F.col("b"), "H5T_STD_I16LE", 2).alias("x")).first().x == ["0100", "0200"]
    with pytest.raises(Exception, match="bytes"):
        parts.select(codec.split_records(F.col("b"), "H5T_STD_I16LE", 3)).collect()
    with pytest.raises(Y.UnsupportedType):
        codec.split_records(F.col("b"), TEXT, 1)
