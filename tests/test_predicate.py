import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeslab.plans import predicate as P
from treeslab.plans.rows import block_rows, row_query

ROWS = [(0, 21, "E 7", 71.5), (1, 22, "W 5", 61.0), (2, 23, "W 5", 62.0), (3, 24, "S 7", 80.25), (4, 25, "N", 10.0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "i long, date int, wind string, temp_1 double")


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("date == 23", [2]),
        ("date = 23", [2]),
        ("wind == b'W 5'", [1, 2]),
        ('wind == "W 5"', [1, 2]),
        ("temp_1 > 61", [0, 2, 3]),
        ("61 < temp_1", [0, 2, 3]),
        ("temp_1 > 6.1e1", [0, 2, 3]),
        ("(date >=22) & (date <= 24)", [1, 2, 3]),
        ("(wind == b'E 7') | (wind == b'S 7')", [0, 3]),
        ("(date > 21) & ~(wind == 'W 5')", [3, 4]),
        ("date > 21 and not wind == 'W 5' or date == 21", [0, 3, 4]),
        ("22 <= date < 24", [1, 2]),
        ("date & 1 == 1", [0, 2, 4]),
        ("date + 2 * 3 == 31", [4]),
        ("-date < -24", [4]),
        ("2 ** 3 ** 1 + date == 30", [1]),
        ("date << 1 == 46", [2]),
        ("(date == 21) ^ (wind == 'E 7')", []),
    ],
)
def test_compiles(rows, text, found):
    assert [r.i for r in row_query(rows, "i", text).collect()] == found


@pytest.mark.parametrize(
    "text",
    ["foobar", "wind = b'abc", "(wind = b'N') & (date = 32", "foobar > 42", "import subprocess; subprocess.call(['ls', '/'])", "1 == 1", "", "date", "date ==", "date == 1)", "(date == 1", "date == 1 2", "date == $", "wind == 'a'b'"],
)
def test_refused(text):
    with pytest.raises(P.InvalidQuery):
        P.compile_query(text, ["date", "wind", "temp_1"])


def test_refused_field_name():
    with pytest.raises(P.InvalidQuery):
        P.parse("date == 1", ["import", "date"])


def test_range_step_limit(rows):
    at = lambda **k: [r.i for r in row_query(rows, "i", "date > 0", **k).collect()]
    assert at(start=1, stop=4) == [1, 2, 3]
    assert at(stop=99) == [0, 1, 2, 3, 4]
    assert at(step=2) == [0, 2, 4] and at(start=1, step=3) == [1, 4]
    assert at(limit=2) == [0, 1] and at(limit=0) == [0, 1, 2, 3, 4]
    assert row_query(rows, "i", "date > 0", shape={"class": "H5S_NULL"}) is None
    with pytest.raises(ValueError):
        row_query(rows, "i", "date > 0", shape={"class": "H5S_SIMPLE", "dims": [2, 2]})
    with pytest.raises(ValueError):
        row_query(rows, "i", "date > 0", step=0)


def test_blocks():
    assert block_rows() == 256_000 and block_rows(100_000) == 200_000 and block_rows(300_000) == 256_000


def test_pushed_to_the_scan(spark, tmp_path, rows):
    rows.write.parquet(str(tmp_path / "t"))
    found = row_query(spark.read.parquet(str(tmp_path / "t")), "i", "date == 23", {"date": "date"}, start=1, stop=4).select("i", "date")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(date,23)" in plan and "GreaterThanOrEqual(i,1)" in plan and "wind" not in plan.split("ReadSchema")[1]


@settings(max_examples=40, deadline=None)
@given(st.recursive(st.sampled_from(["a == 1", "b > 2", "a != b", "a + b < 7"]), lambda x: st.tuples(x, st.sampled_from(["&", "|"]), x).map(lambda t: f"({t[0]}) {t[1]} ({t[2]})"), max_leaves=6))
def test_same_as_python(text):
    tree = P.parse(text, ["a", "b"])

    def run(t, v):
        if t[0] == "field":
            return v[t[1]]
        if t[0] == "number":
            return t[1]
        if t[0] == "compare":
            ops = {"==": int.__eq__, "!=": int.__ne__, "<": int.__lt__, ">": int.__gt__}
            return ops[t[2]](run(t[1], v), run(t[3], v))
        return {"&": lambda x, y: x & y, "|": lambda x, y: x | y, "+": lambda x, y: x + y}[t[1]](run(t[2], v), run(t[3], v))

    for a in range(4):
        for b in range(5):
            assert run(tree, {"a": a, "b": b}) == eval(text, {}, {"a": a, "b": b})
