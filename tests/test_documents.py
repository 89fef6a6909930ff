import json

import pytest
from pyspark.sql import functions as F

from treeslab import cli
from treeslab.operators import graph as G
from treeslab.operators import meta as M
from treeslab.operators import validate as V
from treeslab.sources import documents as D
from treeslab.sources import writer as W
from treeslab.sources.datasource import DocumentSource
from treeslab.streaming.documents import ingest

ID = {x: f"{k:08x}-0000-0000-0000-000000000000" for k, x in enumerate(["root", "g1", "g2", "cube", "names", "loose", "kind", "scale"], 1)}
INT = {"class": "H5T_INTEGER", "base": "H5T_STD_I32BE"}
TEXT = {"class": "H5T_STRING", "charSet": "H5T_CSET_ASCII", "length": "H5T_VARIABLE", "strPad": "H5T_STR_NULLTERM"}


def hard(title, collection, name):
    return {"class": "H5L_TYPE_HARD", "title": title, "collection": collection, "id": ID[name]}


def document():
    return {
        "apiVersion": "1.1.1",
        "root": ID["root"],
        "groups": {
            ID["root"]: {"alias": ["/"], "links": [hard("g1", "groups", "g1"), hard("g2", "groups", "g2"), hard("kind", "datatypes", "kind")], "attributes": [{"name": "title", "type": TEXT, "shape": {"class": "H5S_SCALAR"}, "value": 'say "hi"'}]},
            ID["g1"]: {"links": [hard("cube", "datasets", "cube"), {"class": "H5L_TYPE_SOFT", "title": "near", "h5path": "cube"}, {"class": "H5L_TYPE_SOFT", "title": "gone", "h5path": "/nothing"}, hard("up", "groups", "root")]},
            ID["g2"]: {"links": [hard("names", "datasets", "names"), hard("again", "datasets", "cube"), {"class": "H5L_TYPE_EXTERNAL", "title": "far", "file": "x.json", "h5path": "/a"}, {"class": "H5L_TYPE_USER_DEFINED", "title": "own"}]},
        },
        "datasets": {
            ID["cube"]: {"type": INT, "shape": {"class": "H5S_SIMPLE", "dims": [2, 3], "maxdims": [2, "H5S_UNLIMITED"]}, "value": [[0, 1, 2], [3, 4, 5]], "creationProperties": {"layout": {"class": "H5D_CHUNKED", "dims": [1, 3]}, "filters": [{"class": "H5Z_FILTER_DEFLATE", "id": 1, "level": 6}]}},
            ID["names"]: {"type": f"datatypes/{ID['kind']}", "shape": {"class": "H5S_SIMPLE", "dims": [2]}, "value": ["a", "b"], "attributes": [{"name": "unit", "type": INT, "shape": {"class": "H5S_SIMPLE", "dims": [2]}, "value": [1, 2]}, {"name": "none", "type": INT, "shape": {"class": "H5S_NULL"}}]},
            ID["loose"]: {"type": INT, "shape": {"class": "H5S_SCALAR"}, "value": 5},
            ID["scale"]: {"type": INT, "shape": {"class": "H5S_SIMPLE", "dims": [0]}, "value": []},
        },
        "datatypes": {ID["kind"]: {"type": TEXT}},
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    (path / "one.json").write_text(json.dumps(document()))
    (path / "two.json").write_text(json.dumps({"apiVersion": "1.0.0", "root": ID["root"], "groups": {ID["root"]: {}}}))
    return path


@pytest.fixture(scope="module")
def both(spark, folder):
    return D.read(spark, str(folder / "*.json"))


@pytest.fixture(scope="module")
def one(both):
    return both.only("one")


def test_counts(both):
    n = {(r.file_id, r.collection): r.n for r in G.counts(both).collect()}
    assert n == {("one", "groups"): 3, ("one", "datasets"): 4, ("one", "datatypes"): 1, ("two", "groups"): 1}


def test_missing_and_bad(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError):
        D.read(spark, str(tmp_path / "nothing.json")).files.collect()
    (tmp_path / "bad.json").write_text("no document")
    assert D.read(spark, str(tmp_path)).files.count() == 0
    with pytest.raises(Exception, match="no document"):
        D.read(spark, str(tmp_path), strict=True).files.collect()


def test_round_trip(spark, both, one):
    texts = {r.file_id: json.loads(r.text) for r in W.dump(both, linked_only=False).collect()}
    want = document()
    assert texts["one"] == want
    assert texts["two"]["groups"] == {ID["root"]: {}} and "datasets" not in texts["two"]
    linked = json.loads(W.dump(one).first().text)
    assert set(linked["datasets"]) == {ID["cube"], ID["names"]}
    bare = json.loads(W.dump(one, "bare").first().text)
    assert "value" not in bare["datasets"][ID["cube"]] and "value" not in bare["groups"][ID["root"]]["attributes"][0]
    some = json.loads(W.dump(one, "no-values").first().text)
    assert "value" not in some["datasets"][ID["cube"]] and some["groups"][ID["root"]]["attributes"][0]["value"] == 'say "hi"'


def test_paths(one):
    assert G.resolve(one, "/") == ("one", "groups", ID["root"])
    assert G.resolve(one, "/g1/cube")[2] == ID["cube"] and G.resolve(one, "/g1/near")[2] == ID["cube"]
    assert G.resolve(one, "/g1/up/g2/names")[2] == ID["names"]
    assert G.resolve(one, "/g1/gone") is None and G.resolve(one, "/g2/far") is None and G.resolve(one, "/x") is None
    with pytest.raises(PermissionError):
        G.resolve(one, "/__db__/x")
    assert {r.path for r in G.reachable(one).collect()} == {"/", "/g1", "/g2", "/kind", "/g1/cube", "/g2/names"}
    every = G.walk(G.hard_edges(one), G._roots(one), 3, revisit=True)
    assert {r.path for r in every.collect()} == {"/", "/g1", "/g2", "/kind", "/g1/cube", "/g2/names", "/g2/again"}


def test_links(one):
    assert {r.uuid for r in G.anonymous(one).collect()} == {ID["loose"], ID["scale"]}
    n = {r.uuid: r.n for r in G.link_counts(one).collect()}
    assert n[ID["cube"]] == 3 and n[ID["names"]] == 1 and n[ID["root"]] == 1
    assert [r.title for r in G.link_page(one, ID["g2"], "again", 2).collect()] == ["far", "names"]
    items = {r.title: r for r in G.link_page(one, ID["g2"]).collect()}
    assert items["again"].href == f"datasets/{ID['cube']}" and items["far"].file == "x.json" and items["own"].h5path is None
    assert [r.uuid for r in G.collection_page(one, "datasets").collect()] == [ID["cube"], ID["names"]]
    assert [r.uuid for r in G.collection_page(one, "datasets", limit=3).collect()] == [ID["cube"], ID["names"], ID["loose"]]
    assert G.is_hard_linked(one, ID["cube"]) and not G.is_hard_linked(one, ID["loose"])
    assert G.collection_of(one, ID["kind"]) == "datatypes" and G.collection_of(one, "x") is None
    items = {r.uuid: r for r in G.group_items(one).collect()}
    assert items[ID["g2"]].link_count == 4 and items[ID["root"]].attribute_count == 1
    types = {r.uuid: r for r in G.dataset_types(one).collect()}
    assert json.loads(types[ID["names"]].type_json) == TEXT and types[ID["names"]].type_ref == f"datatypes/{ID['kind']}" and types[ID["cube"]].type_ref is None


def test_many_links_by_pages(spark):
    t = D.empty(spark, ID["root"])
    links = spark.range(100).select(F.lit("new").alias("file_id"), F.lit(ID["root"]).alias("group_uuid"), F.col("id").cast("int").alias("ordinal"), F.format_string("g%04d", "id").alias("title"), F.lit(G.HARD).alias("class"), F.lit("groups").alias("collection"), F.col("id").cast("string").alias("id"), *(F.lit(None).cast("string").alias(x) for x in ("h5path", "file", "target")))
    t = t.with_(links=links)
    marker, seen, pages = None, [], 0
    while got := [r.title for r in G.link_page(t, ID["root"], marker, 13).collect()]:
        seen += got
        marker, pages = got[-1], pages + 1
    assert seen == [f"g{k:04d}" for k in range(100)] and pages == 8


def test_changes(spark, one):
    t = G.create_group(one, "one", "new")
    assert "new" in {r.uuid for r in G.anonymous(t).collect()}
    t = G.link_object(t, "one", ID["root"], "new", "fresh")
    assert G.resolve(t, "/fresh")[2] == "new"
    t = G.link_object(t, "one", ID["root"], ID["g1"], "fresh")
    assert G.resolve(t, "/fresh")[2] == ID["g1"]
    t = G.soft_link(t, "one", ID["root"], "/g2/names", "alias")
    assert G.resolve(t, "/alias")[2] == ID["names"]
    t = G.external_link(t, "one", ID["root"], "f", "/x", "out")
    assert t.links.where("title = 'out'").first().file == "f"
    t = G.unlink(t, "one", ID["g2"], "names")
    assert ID["names"] in {r.uuid for r in G.anonymous(t).collect()}
    with pytest.raises(PermissionError):
        G.unlink(t, "one", ID["g2"], "own")
    with pytest.raises(PermissionError):
        G.unlink(t, "one", ID["root"], "__db__")
    with pytest.raises(LookupError):
        G.unlink(t, "one", ID["g2"], "names")
    with pytest.raises(LookupError):
        G.link_object(t, "one", ID["root"], "nothing", "x")
    with pytest.raises(PermissionError):
        G.delete_object(t, "one", "groups", ID["root"], 5)
    t = G.delete_object(t, "one", "datasets", ID["cube"], 5)
    assert G.resolve(t, "/g1/cube") is None and t.links.where(F.col("id") == ID["cube"]).count() == 0
    ids = spark.createDataFrame([(ID["cube"],), (ID["names"],), ("x",)], "uuid string")
    assert {r.uuid: r.state for r in G.presence(ids, t.objects(), t.times).collect()} == {ID["cube"]: "deleted", ID["names"]: "present", "x": "unknown"}
    assert len({r.uuid for r in W.purge(t).groups.collect()}) == 3


def test_attributes(one):
    assert [r.name for r in M.attribute_page(one, ID["names"]).collect()] == ["none", "unit"]
    assert [r.name for r in M.attribute_page(one, ID["names"], "none", 1).collect()] == ["unit"]
    row = M.typed(M.attribute(one, ID["names"], "unit"), INT, 1).first()
    assert row.value == [1, 2] and M.attribute(one, ID["names"], "none").first().value_json is None
    t = M.set_attribute(one, "one", "datasets", ID["cube"], "size", INT, (), 4, now=9)
    t = M.set_attribute(t, "one", "datasets", ID["cube"], "size", INT, [2], [4, 5], now=10)
    assert M.typed(M.attribute(t, ID["cube"], "size"), INT, 1).first().value == [4, 5]
    assert t.times.first().mtime == 10
    t = M.set_string_attribute(t, "one", "datasets", ID["cube"], "label", "water", 4)
    assert M.attribute(t, ID["cube"], "label").first().value_json == "wat"
    t = M.delete_attribute(t, "one", ID["cube"], "size", 11)
    assert M.attribute(t, ID["cube"], "size").isEmpty() and t.times.where("obj_type = 'attribute'").first().mtime == 11
    with pytest.raises(LookupError):
        M.delete_attribute(t, "one", ID["cube"], "size", 12)
    with pytest.raises(ValueError):
        M.set_attribute(t, "one", "datasets", ID["cube"], "", INT, (), 4)


def test_creation_properties(one):
    row = M.creation_properties(one.datasets).where(F.col("uuid") == ID["cube"]).first()
    assert (row.layout, row.chunk, row.filters[0]["class"], row.filters[0].level) == ("H5D_CHUNKED", [1, 3], "H5Z_FILTER_DEFLATE", 6)
    assert M.filter_options(4, [4, 32]) == {"id": 4, "class": "H5Z_FILTER_SZIP", "bitsPerPixel": 4, "coding": "H5_SZIP_NN_OPTION_MASK"}
    assert M.filter_options(999, [1]) == {"id": 999, "class": "H5Z_FILTER_USER", "parameters": [1]}
    t = M.set_creation_properties(one, "one", ID["names"], {"layout": {"class": "H5D_COMPACT"}})
    t = M.set_creation_properties(t, "one", ID["names"], {"layout": {"class": "H5D_CHUNKED"}})
    assert M.creation_properties(t.datasets).where(F.col("uuid") == ID["names"]).first().layout == "H5D_COMPACT"
    t = M.create_dataset(one, "one", "d", INT, [4], [None], {"fillValue": 0})
    row = t.datasets.where("uuid = 'd'").first()
    assert json.loads(row.creation_properties) == {"fillValue": 0, "layout": {"class": "H5D_CHUNKED", "dims": [4]}} and row.shape.maxdims == ["H5S_UNLIMITED"]
    with pytest.raises(ValueError):
        M.create_dataset(one, "one", "d", INT, [4], None, {"layout": {"class": "H5D_CHUNKED", "dims": [1, 1]}})


def test_times(spark, one):
    t = M.touch(one, "one", ID["root"], ctime=1, mtime=2)
    t = M.touch(t, "one", ID["g1"], ctime=5)
    t = M.touch(t, "one", ID["g2"], "link", "names", mtime=7)
    keys = spark.createDataFrame([("one", ID["g1"], "object", None), ("one", ID["g2"], "link", "names"), ("one", ID["cube"], "object", None)], "file_id string, uuid string, obj_type string, name string")
    got = {r.uuid: (r.created, r.modified) for r in M.resolved_times(keys, t.times, t.files).collect()}
    assert got == {ID["g1"]: (5, 5), ID["g2"]: (1, 7), ID["cube"]: (1, 2)}
    assert {r.uuid: r.created for r in M.resolved_times(keys, t.times).collect()}[ID["cube"]] is None
    with pytest.raises(ValueError):
        M.time_key("x", "link")


def test_acls(spark, one):
    t = M.set_acl(one, "one", ID["cube"], 123, read=1)
    t = M.set_acl(t, "one", ID["cube"], 123, update=1)
    assert M.acl_of(t, ID["cube"], 123) == {"userid": 123, "create": 0, "read": 1, "update": 1, "delete": 0, "readACL": 0, "updateACL": 0}
    assert M.acl_count(t, ID["cube"]) == 1 and M.acl_of(t, ID["cube"], 1) is None
    t = M.set_acl(t, "one", ID["root"], 0, read=1)
    t = M.set_acl(t, "one", ID["root"], 7, delete=1)
    asked = spark.createDataFrame([("one", ID["cube"], 123), ("one", ID["cube"], 7), ("one", ID["cube"], 9), ("two", ID["cube"], 1)], "file_id string, obj_uuid string, userid int")
    roots = one.files.select("file_id", "root")
    got = {(r.file_id, r.userid): (r.matched, r.read, r.delete) for r in M.resolved_acls(asked, t.acls, roots).collect()}
    assert got == {("one", 123): (123, 1, 0), ("one", 7): (7, 0, 1), ("one", 9): (0, 1, 0), ("two", 1): (0, 1, 1)}
    assert M.default_acl()["updateACL"] == 1


def test_dereference(spark, one):
    from treeslab.functions import codec

    rows = spark.createDataFrame([("one", f"groups/{ID['g1']}"), ("one", "null"), ("one", "groups/x")], "file_id string, t string")
    got = {r.t: r.found for r in G.dereference(rows.select("*", codec.reference(F.col("t")).alias("r")), F.col("r"), one).collect()}
    assert got == {f"groups/{ID['g1']}": True, "null": None, "groups/x": False}


def test_valid(spark, both, folder):
    assert V.violations(both).collect() == []
    assert {r.file_id: r.valid for r in V.validate(D.texts(spark, str(folder / "*.json"))).collect()} == {"one": True, "two": True}


def change(**what):
    doc = document()
    for path, value in what.items():
        at = doc
        *parts, last = path.split("__")
        key = lambda at, x: int(x) if isinstance(at, list) else x if x in at else ID.get(x, x)
        for p in parts:
            at = at[key(at, p)]
        if value is KeyError:
            del at[key(at, last)]
        else:
            at[key(at, last)] = value
    return doc


BROKEN = [
    change(apiVersion="2.0"),
    change(root=KeyError),
    change(datasets__bad={"type": INT, "shape": {"class": "H5S_SCALAR"}}),
    change(datasets__cube__shape={"class": "H5S_SIMPLE"}),
    change(datasets__cube__shape={"class": "H5S_SIMPLE", "dims": [-1]}),
    change(datasets__cube__shape={"class": "H5S_SIMPLE", "dims": [1], "maxdims": [0]}),
    change(datasets__cube__shape={"class": "H5S_ODD"}),
    change(datasets__cube__type={"class": "H5T_INTEGER", "base": "H5T_STD_I7LE"}),
    change(datasets__cube__type={"class": "H5T_COMPOUND", "fields": []}),
    change(datasets__cube__type="datatypes/x"),
    change(datasets__cube__creationProperties={}),
    change(datasets__cube__creationProperties={"layout": {"class": "H5D_CHUNKED", "dims": [0]}}),
    change(datasets__cube__creationProperties={"layout": {"class": "H5D_COMPACT"}, "filters": [{"class": "H5Z_FILTER_DEFLATE", "id": 2}]}),
    change(datasets__cube__creationProperties={"layout": {"class": "H5D_COMPACT"}, "filters": [{"class": "H5Z_FILTER_DEFLATE", "level": 10}]}),
    change(datasets__cube__creationProperties={"layout": {"class": "H5D_COMPACT"}, "fillTime": "never"}),
    change(datasets__names__alias=["names"]),
    change(groups__g1__alias=[]),
    change(groups__g1__links__0__title="a/b"),
    change(groups__g1__links__0__id=KeyError),
    change(groups__g1__links__1__h5path=KeyError),
    change(groups__g2__links__2__file=KeyError),
    change(groups__g2__links__3__class="H5L_TYPE_NONE"),
    change(groups__root__attributes__0__name=""),
    change(groups__root__attributes__0__type={"class": "H5T_STRING", "length": 0, "strPad": "H5T_STR_NULLPAD"}),
]


def test_invalid(spark):
    texts = spark.createDataFrame([(f"{k:02d}", json.dumps(doc)) for k, doc in enumerate(BROKEN)], "file_id string, text string")
    rows = V.validate(texts).orderBy("file_id").collect()
    assert len(rows) == len(BROKEN)
    assert [(r.valid, len(r.violations)) for r in rows] == [(False, 1)] * len(BROKEN)


def test_save_and_load(spark, both, tmp_path):
    D.save(both, str(tmp_path / "t"))
    again = D.load(spark, str(tmp_path / "t"))
    assert sorted(W.dump(again).collect()) == sorted(W.dump(both).collect())
    W.write(both, str(tmp_path / "json"))
    assert (tmp_path / "json" / "file_id=one").is_dir()


def test_data_source(spark, folder):
    spark.dataSource.register(DocumentSource)
    rows = spark.read.format("treeslab").option("path", str(folder)).load()
    assert rows.count() == 9
    assert [r.uuid for r in rows.where("collection = 'datatypes'").collect()] == [ID["kind"]]


def test_stream(spark, folder, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.json").write_text((folder / "one.json").read_text())
    (source / "bad.json").write_text(json.dumps(change(apiVersion="0")))
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "datasets")).count() == 4
    assert [r.file_id for r in spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()] == ["bad"]


def test_command_line(spark, folder, tmp_path, capsys):
    assert cli.main(["load", str(folder / "one.json"), str(tmp_path / "t")], spark) == 0
    assert cli.main(["dump", "-d", str(tmp_path / "t")], spark) == 0
    printed = json.loads(capsys.readouterr().out)
    assert printed["root"] == ID["root"] and set(printed["datasets"]) == {ID["cube"], ID["names"]}
    (tmp_path / "bad.json").write_text("{}")
    assert cli.main(["validate", str(folder)], spark) == 0
    assert cli.main(["validate", "-s", str(tmp_path / "bad.json"), str(folder)], spark) == 1
    assert "FAIL" in capsys.readouterr().out


def test_types_of_bits():
    layout = {"size": 4, "precision": 17, "bitOffset": 3, "byteOrder": "H5T_ORDER_BE"}
    good = [
        {"class": "H5T_INTEGER", **layout, "signType": "H5T_SGN_2"},
        {"class": "H5T_FLOAT", **layout, "expBits": 8, "mantNorm": "H5T_NORM_IMPLIED"},
        {"class": "H5T_BITFIELD", **layout, "lsbPad": "H5T_PAD_ONE"},
        {"class": "H5T_BITFIELD", "base": "H5T_STD_U16LE"},
    ]
    assert [V.type_problem(x) for x in good] == [None] * len(good)
    without = lambda x, name: {k: v for k, v in x.items() if k != name}
    bad = [
        without(good[0], "precision"), good[0] | {"byteOrder": "H5T_ORDER_VAX"}, good[0] | {"bitOffset": -1}, good[0] | {"signType": "odd"}, {"class": "H5T_INTEGER"},
        good[1] | {"expBits": 0}, good[1] | {"mantNorm": ""}, good[1] | {"other": 1}, without(good[2], "byteOrder"), good[2] | {"size": True}, good[3] | {"base": "H5T_IEEE_F32LE"}, {"class": "H5T_BITFIELD"},
    ]
    assert all(V.type_problem(x) for x in bad), [V.type_problem(x) for x in bad]


def test_soft_links_in_circles(spark):
    t = D.empty(spark, "root", "f")
    t = G.soft_link(G.soft_link(t, "f", "root", "/b", "a"), "f", "root", "a", "b")
    with pytest.raises(Exception, match="soft links"):
        G.resolve(t, "/a")
