"""Documents in lines: whole documents of any size, none of whose rows grows with them."""

import json

import pytest
from pyspark.sql import functions as F

from treeslab import queries as Q
from treeslab.sources import documents as D
from treeslab.sources import writer as W

KIND, SPACE = '{"class":"H5T_INTEGER","base":"H5T_STD_I8LE"}', {"class": "H5S_SIMPLE", "dims": [2]}
NOTES = [{"name": n, "type": json.loads(KIND), "shape": {"class": "H5S_SCALAR"}, "value": v} for n, v in (("z", 1), ('a "b"', 2))]
DOCUMENT = {
    "apiVersion": "1.1.1", "root": "r", "id": "i", "created": "then",
    "groups": {
        "r": {"alias": ["/"], "attributes": NOTES, "links": [{"title": f"t{9 - k}", "class": "H5L_TYPE_HARD", "collection": "datasets", "id": f"d{k}"} for k in range(3)] + [{"title": "s", "class": "H5L_TYPE_SOFT", "h5path": "/t1"}]},
        "loose": {},
    },
    "datasets": {f"d{k}": {"type": json.loads(KIND), "shape": SPACE, "value": [k, 7], "attributes": NOTES[k % 2 :]} for k in range(3)},
    "datatypes": {"k": {"type": json.loads(KIND), "attributes": NOTES[:1]}},
}


@pytest.fixture(scope="module")
def whole(spark):
    return D.from_texts(spark.createDataFrame([("one", json.dumps(DOCUMENT)), ("two", '{"apiVersion":"1.1.1","root":"q","groups":{"q":{}}}')], "file_id string, text string"))


def merged(lines):
    """A document's lines as one, read by nothing but a JSON parser."""
    out, entries = {}, []
    for line in map(json.loads, lines):
        place = line.pop("place", None)
        for collection in ("groups", "datasets", "datatypes"):
            for uuid, o in line.pop(collection, {}).items():
                at = out.setdefault(collection, {}).setdefault(uuid, {})
                if place is None:
                    at.update(o)
                else:
                    entries += [(place, at, name, x) for name, found in o.items() for x in found]
        out.update(line)
    for _, at, name, x in sorted(entries, key=lambda e: e[0]):
        at.setdefault(name, []).append(x)
    return out


@pytest.mark.parametrize("header", ["all", "no-values", "bare"])
@pytest.mark.parametrize("linked_only", [True, False])
def test_lines_are_the_document(whole, header, linked_only):
    texts = {r.file_id: json.loads(r.text) for r in W.dump(whole, header, linked_only).collect()}
    lines = W.dump_lines(whole, header, linked_only).collect()
    assert {f: merged(r.text for r in lines if r.file_id == f) for f in texts} == texts


@pytest.mark.parametrize("once", [True, False])
def test_lines_are_read_again(whole, once):
    back = D.from_lines(W.dump_lines(whole, linked_only=False).orderBy(F.rand(3)), once)
    for name in D.SCHEMAS:
        got, want = (getattr(t, name) for t in (back, whole))
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), name


@pytest.mark.parametrize("text", ["no line", '{"apiVersion":"1.1.1"}', '{"groups":{"r":{}', "", None])
def test_a_broken_line_fails(spark, text):
    rows = spark.createDataFrame([("f", '{"root":"r"}'), ("f", text)], "file_id string, text string")
    with pytest.raises(Exception, match="no line of a document: f"):
        D.from_lines(rows).groups.collect()


@pytest.mark.parametrize("name", ["document_contents", "document_round_trip", "links_round_trip"])
def test_no_row_holds_the_document(spark, sf_dir, monkeypatch, name):
    longest = []

    def read(rows, *more, **named):
        longest.append(rows.agg(F.max(F.length("text"))).first()[0])
        return D.Tables(**{x: spark.createDataFrame([], s) for x, s in D.SCHEMAS.items()})

    for f in ("from_texts", "from_lines"):
        monkeypatch.setattr(Q.D, f, read, raising=False)
    Q.QUERIES[name](spark, sf_dir)
    assert longest and longest[0] < 1000
