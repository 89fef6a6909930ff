"""Texts are validated within their rows, by the same rules as tables."""

import json

from pyspark.sql import functions as F

from treeslab.operators import validate as V
from treeslab.sources import documents as D

HEAD = '{"root":"r","apiVersion":"1.1.1",'
TEXTS = [
    HEAD + '"groups":{"r":{"alias":[],"links":[null,{"title":"a/b"},{"title":"x","class":"H5L_TYPE_SOFT"}],"attributes":[null,{"name":"","type":"datatypes/x"}]}}}',
    HEAD + '"groups":{"r":null},"datasets":{"a":{"alias":["x"],"type":"{bad","shape":{"class":"H5S_SCALAR","dims":[1]},"creationProperties":{"layout":{"class":"H5D_CHUNKED","dims":[0]},"filters":[{"id":0}]}}}}',
    HEAD + '"datasets":{"a":{"attributes":[{"name":"n","type":{"class":"H5T_TIME"},"shape":{"class":"H5S_SIMPLE","dims":[1],"maxdims":[0]}}]},"b":null}}',
    HEAD + '"datatypes":{"a":{"type":{"class":"H5T_TIME"},"attributes":[{"name":"n"}]}}}',
    HEAD + '"groups":{}}',
    '{"root":"r","apiVersion":"9"}',
]


def rows(spark, texts):
    return spark.createDataFrame([(f"{k}", t) for k, t in enumerate(texts)], "file_id string, text string")


def test_same_as_tables(spark):
    texts = rows(spark, TEXTS)
    got = {r.file_id: [tuple(x) for x in r.violations] for r in V.validate(texts).collect()}
    want = {k: [] for k in got}
    for r in V.violations(D.from_texts(texts)).collect():
        want[r.file_id].append((r.place, r.rule))
    assert got == {k: sorted(x) for k, x in want.items()}
    assert [len(got[k]) > 0 for k in "012345"] == [True, True, True, True, False, True]


def test_no_document(spark):
    for r in V.validate(rows(spark, [None, "", "{}", '{"root":"r"', "[]"])).collect():
        assert (r.valid, [tuple(x) for x in r.violations]) == (False, [("file", "no document")])


def test_one_pass(spark):
    """Neither a shuffle nor files on the way: the work grows with the texts alone."""
    found = V.validate(rows(spark, [json.dumps({"root": "r"})]).where(F.length("text") > 0))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "kept-" not in plan
