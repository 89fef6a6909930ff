"""Attributes, creation properties, times and access rules."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeslab.functions import codec, spaces
from treeslab.functions import types as Y
from treeslab.operators.graph import page
from treeslab.sources.documents import ACL, SCHEMAS, Tables

# Filters by number: class, short name and options. (Fixed values.)
FILTERS = {
    1: ("H5Z_FILTER_DEFLATE", "gzip", ["level"]),
    2: ("H5Z_FILTER_SHUFFLE", "shuffle", []),
    3: ("H5Z_FILTER_FLETCHER32", "fletcher32", []),
    4: ("H5Z_FILTER_SZIP", "szip", ["bitsPerPixel", "coding", "pixelsPerBlock", "pixelsPerScanLine"]),
    5: ("H5Z_FILTER_NBIT", None, []),
    6: ("H5Z_FILTER_SCALEOFFSET", "scaleoffset", ["scaleType", "scaleOffset"]),
    32000: ("H5Z_FILTER_LZF", "lzf", []),
}
OPTION_NAMES = {
    "coding": {4: "H5_SZIP_EC_OPTION_MASK", 32: "H5_SZIP_NN_OPTION_MASK"},
    "scaleType": {0: "H5Z_SO_FLOAT_DSCALE", 1: "H5Z_SO_FLOAT_ESCALE", 2: "H5Z_SO_INT"},
}
USER_FILTER = "H5Z_FILTER_USER"
FLAGS = ["create", "read", "update", "delete", "readACL", "updateACL"]


def attribute(tables: Tables, owner: str, name: str) -> DataFrame:
    """An attribute's row. Opaque ones and those without elements carry no value."""
    a = tables.attributes.where((F.col("owner_uuid") == owner) & (F.col("name") == name))
    blank = (F.get_json_object("type_json", "$.class") == "H5T_OPAQUE") | (F.col("shape.class") == "H5S_NULL")
    return a.withColumn("value_json", F.when(~F.coalesce(blank, F.lit(False)), F.col("value_json")))


def attribute_page(tables: Tables, owner: str, marker: str | None = None, limit: int = 0) -> DataFrame:
    """Attributes of an object by name, without values."""
    return page(tables.attributes.where(F.col("owner_uuid") == owner).select("file_id", "name", "type_json", "shape"), "name", marker, limit)


def typed(rows: DataFrame, type_json: str | dict, rank: int, value: str = "value_json", named: dict[str, Any] | None = None) -> DataFrame:
    """rows whose values all have this type, with a typed column ``value``."""
    return rows.withColumn("value", codec.decode(F.col(value), Y.parse(type_json), rank, named))


def set_attribute(tables: Tables, file_id: str, collection: str, owner: str, name: str, type_item: Any, dims: Sequence[int] | None, value: Any, now: int | None = None) -> Tables:
    """Make or replace an attribute: dims None has no elements, () is a scalar. With a time, the owner's time of change is set."""
    if not name:
        raise ValueError("an attribute has a name")
    Y.spark_type(type_item, None) if not isinstance(type_item, str) or not type_item.startswith("datatypes/") else None
    shape = spaces.space(list(dims) if dims is not None else None)
    mine = (F.col("file_id") == file_id) & (F.col("owner_uuid") == owner)
    last = tables.attributes.where(mine).agg(F.max("ordinal")).first()[0]
    text = value if isinstance(value, str) and shape["class"] == "H5S_SCALAR" else json.dumps(value)
    row = {
        "file_id": file_id,
        "owner_collection": collection,
        "owner_uuid": owner,
        "ordinal": 0 if last is None else last + 1,
        "name": name,
        "type_json": type_item if isinstance(type_item, str) else json.dumps(Y.canonical(type_item)),
        "shape": {"class": shape["class"], "dims": shape.get("dims"), "maxdims": None},
        "value_json": None if dims is None else text,
    }
    kept = tables.attributes.where(~(mine & (F.col("name") == name)))
    out = tables.with_(attributes=kept.unionByName(kept.sparkSession.createDataFrame([row], SCHEMAS["attributes"])))
    return touch(out, file_id, owner, "object", None, mtime=now) if now is not None else out


def set_string_attribute(tables: Tables, file_id: str, collection: str, owner: str, name: str, text: str, length: int | None = None) -> Tables:
    """A scalar string of fixed length, closed by a NUL; longer text is cut."""
    size = len(text.encode()) + 1 if length is None else length
    kept = text.encode()[: max(0, size - 1)].decode(errors="ignore")
    kind = {"class": "H5T_STRING", "charSet": "H5T_CSET_ASCII", "length": size, "strPad": "H5T_STR_NULLTERM"}
    return set_attribute(tables, file_id, collection, owner, name, kind, (), kept)


def delete_attribute(tables: Tables, file_id: str, owner: str, name: str, now: int) -> Tables:
    """Take an attribute away; its time of deletion stays."""
    mine = (F.col("file_id") == file_id) & (F.col("owner_uuid") == owner) & (F.col("name") == name)
    if tables.attributes.where(mine).isEmpty():
        raise LookupError(f"no attribute {name}")
    return touch(tables.with_(attributes=tables.attributes.where(~mine)), file_id, owner, "attribute", name, mtime=now)


def dimension_scales(tables: Tables) -> DataFrame:
    """file_id, dataset, axis, scale: the scale datasets attached to each axis by DIMENSION_LIST attributes.

    A scale is a dataset whose CLASS is DIMENSION_SCALE; the reverse lists follow from this table and aren't stored.
    """
    lists = tables.attributes.where((F.col("name") == "DIMENSION_LIST") & (F.col("owner_collection") == "datasets"))
    axes = lists.select("file_id", F.col("owner_uuid").alias("dataset"), F.posexplode(F.from_json("value_json", "array<array<string>>")).alias("axis", "refs"))
    refs = axes.select("file_id", "dataset", "axis", F.explode("refs").alias("ref")).select("file_id", "dataset", "axis", F.substring_index("ref", "/", -1).alias("scale"))
    scales = tables.attributes.where((F.col("name") == "CLASS") & F.col("value_json").rlike("^\"?DIMENSION_SCALE")).select("file_id", F.col("owner_uuid").alias("scale"))
    return refs.join(scales.distinct(), ["file_id", "scale"], "left_semi").select("file_id", "dataset", "axis", "scale")


def reference_lists(tables: Tables) -> DataFrame:
    """file_id, scale, dataset, dimension: where each scale is used."""
    return dimension_scales(tables).select("file_id", "scale", "dataset", F.col("axis").alias("dimension"))


def filter_class(number: Column) -> Column:
    """The class of a filter by its number; a filter of the user's if it is unknown."""
    known = F.create_map(*(F.lit(x) for k, v in FILTERS.items() for x in (k, v[0])))
    return F.coalesce(F.try_element_at(known, number), F.lit(USER_FILTER))


def filter_options(number: int, values: Sequence[int]) -> dict[str, Any]:
    """A filter with its options by name, as far as values go; a filter of the user's keeps them as parameters."""
    if number not in FILTERS:
        return {"id": number, "class": USER_FILTER} | ({"parameters": list(values)} if values else {})
    name, _, options = FILTERS[number]
    return {"id": number, "class": name} | {o: OPTION_NAMES.get(o, {}).get(v, v) for o, v in zip(options, values)}


def supported_filters() -> dict[str, int]:
    return {alias: number for number, (_, alias, _) in FILTERS.items() if alias}


def creation_properties(datasets: DataFrame) -> DataFrame:
    """file_id, uuid, alloc_time, fill_time, fill_value, layout, chunk, filters (class filled in by number) of datasets."""
    props = F.from_json("creation_properties", "struct<allocTime: string, fillTime: string, fillValue: string, layout: struct<class: string, dims: array<bigint>>, filters: array<struct<id: int, class: string, name: string, level: int>>>")
    named = lambda f: F.struct(f["id"].alias("id"), F.coalesce(f["class"], filter_class(f["id"])).alias("class"), f["name"].alias("name"), f["level"].alias("level"))
    kind = F.get_json_object("type_json", "$.class")
    fill = F.when(~F.coalesce(kind.isin("H5T_VLEN", "H5T_OPAQUE"), F.lit(False)), F.col("p.fillValue"))
    return datasets.withColumn("p", props).select("file_id", "uuid", F.col("p.allocTime").alias("alloc_time"), F.col("p.fillTime").alias("fill_time"), fill.alias("fill_value"), F.col("p.layout.class").alias("layout"), F.col("p.layout.dims").alias("chunk"), F.transform("p.filters", named).alias("filters"))


def set_creation_properties(tables: Tables, file_id: str, uuid: str, properties: dict) -> Tables:
    """Written once: properties that are there stay."""
    mine = (F.col("file_id") == file_id) & (F.col("uuid") == uuid)
    text = F.when(mine, F.coalesce("creation_properties", F.lit(json.dumps(properties)))).otherwise(F.col("creation_properties"))
    return tables.with_(datasets=tables.datasets.withColumn("creation_properties", text))


def create_dataset(tables: Tables, file_id: str, uuid: str, type_item: Any, dims: Sequence[int] | None, maxdims: Sequence[int | None] | None = None, properties: dict | None = None, value: Any = None) -> Tables:
    """A dataset, anonymous until it is linked. Chunks have the array's rank and filters need chunks; fill values of zero count."""
    shape = spaces.space(list(dims) if dims is not None else None, maxdims)
    properties = dict(properties or {})
    layout = properties.get("layout", {"class": "H5D_CONTIGUOUS"})
    if layout.get("class") == "H5D_CHUNKED" and len(layout.get("dims", [])) != len(shape.get("dims", [])):
        raise ValueError("a chunk has the rank of its array")
    if (properties.get("filters") or "maxdims" in shape) and layout.get("class") != "H5D_CHUNKED":
        properties["layout"] = {"class": "H5D_CHUNKED", "dims": [max(1, d) for d in shape.get("dims", [1])]}
    named = isinstance(type_item, str) and type_item.startswith("datatypes/")
    if not named:
        Y.spark_type(type_item)
    row = {
        "file_id": file_id,
        "uuid": uuid,
        "alias": [],
        "type_json": type_item if named else json.dumps(Y.canonical(type_item)),
        "shape": {"class": shape["class"], "dims": shape.get("dims"), "maxdims": [str(x) for x in shape["maxdims"]] if "maxdims" in shape else None},
        "creation_properties": json.dumps(properties) if properties else None,
        "value_json": value if value is None or (isinstance(value, str) and shape["class"] == "H5S_SCALAR") else json.dumps(value),
    }
    return tables.with_(datasets=tables.datasets.unionByName(tables.datasets.sparkSession.createDataFrame([row], SCHEMAS["datasets"])))


def time_key(uuid: str, obj_type: str = "object", name: str | None = None) -> tuple[str, str, str | None]:
    """The key of a time: an object, or an attribute or link of one by name."""
    if obj_type not in ("object", "attribute", "link"):
        raise ValueError(f"no such kind of time: {obj_type}")
    if (obj_type == "object") == bool(name):
        raise ValueError("attributes and links have a name, objects none")
    return uuid, obj_type, name


def touch(tables: Tables, file_id: str, uuid: str, obj_type: str = "object", name: str | None = None, ctime: int | None = None, mtime: int | None = None) -> Tables:
    """Set times, the later call winning for what it sets."""
    uuid, obj_type, name = time_key(uuid, obj_type, name)
    mine = (F.col("file_id") == file_id) & (F.col("uuid") == uuid) & (F.col("obj_type") == obj_type) & F.col("name").eqNullSafe(F.lit(name).cast("string"))
    old = tables.times.where(mine).agg(F.max("ctime").alias("c"), F.max("mtime").alias("m")).first()
    row = (file_id, uuid, obj_type, name, old.c if ctime is None else ctime, old.m if mtime is None else mtime)
    return tables.with_(times=tables.times.where(~mine).unionByName(tables.times.sparkSession.createDataFrame([row], SCHEMAS["times"])))


def resolved_times(keys: DataFrame, times: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """keys (file_id, uuid, obj_type, name) with created and modified: its own; modified falls back on created; then the root's."""
    same = ["file_id", "uuid", "obj_type"]
    own = keys.alias("k").join(times.alias("t"), [*(F.col(f"k.{x}") == F.col(f"t.{x}") for x in same), F.col("k.name").eqNullSafe(F.col("t.name"))], "left").select("k.*", "t.ctime", "t.mtime")
    if roots is None:
        return own.select(*keys.columns, F.col("ctime").alias("created"), F.coalesce("mtime", "ctime").alias("modified"))
    top = roots.select("file_id", F.col("root").alias("uuid")).join(times.where(F.col("obj_type") == "object"), ["file_id", "uuid"]).select("file_id", F.col("ctime").alias("rc"), F.coalesce("mtime", "ctime").alias("rm"))
    return own.join(top, "file_id", "left").select(*keys.columns, F.coalesce("ctime", "rc").alias("created"), F.coalesce("mtime", "ctime", "rm").alias("modified"))


def default_acl() -> dict[str, int]:
    return {"userid": 0} | {x: 1 for x in FLAGS}


def acls(tables: Tables, uuid: str) -> DataFrame:
    return tables.acls.where(F.col("obj_uuid") == uuid)


def acl_count(tables: Tables, uuid: str) -> int:
    return acls(tables, uuid).count()


def acl_of(tables: Tables, uuid: str, userid: int) -> dict[str, int] | None:
    """The rule for exactly this object and user."""
    row = acls(tables, uuid).where(F.col("userid") == userid).first()
    return None if row is None else {x: int(row[x]) for x in ("userid", *FLAGS)}


def set_acl(tables: Tables, file_id: str, uuid: str, userid: int, **flags: int) -> Tables:
    """Make or change a rule; flags that aren't given stay (0 in a new one)."""
    if set(flags) - set(FLAGS):
        raise ValueError(f"no such flags: {sorted(set(flags) - set(FLAGS))}")
    values = {x: 0 for x in FLAGS} | (acl_of(tables.only(file_id), uuid, userid) or {}) | {k: int(v) for k, v in flags.items()}
    mine = (F.col("file_id") == file_id) & (F.col("obj_uuid") == uuid) & (F.col("userid") == userid)
    row = (file_id, uuid, userid, *(values[x] for x in FLAGS))
    return tables.with_(acls=tables.acls.where(~mine).unionByName(tables.acls.sparkSession.createDataFrame([row], ACL)))


def resolved_acls(requests: DataFrame, rules: DataFrame, roots: DataFrame) -> DataFrame:
    """requests (file_id, obj_uuid, userid) with the rule that holds: of the object for the user, of the root for the user,
    of the object for everyone (user 0), of the root for everyone, or the default. matched is the rule's user.

    One join on the candidates of each request, four rows at most, and a top-1 by priority.
    """
    asked = requests.distinct().join(roots.select("file_id", "root"), "file_id", "left")
    spots = F.array(*(F.struct(F.lit(k).alias("rank"), place.alias("at"), user.alias("who")) for k, (place, user) in enumerate([(F.col("obj_uuid"), F.col("userid")), (F.col("root"), F.col("userid")), (F.col("obj_uuid"), F.lit(0)), (F.col("root"), F.lit(0))])))
    wide = asked.select("file_id", "obj_uuid", "userid", F.explode(spots).alias("s"))
    r = rules.select(F.col("file_id").alias("f"), F.col("obj_uuid").alias("at"), F.col("userid").alias("who"), F.struct(F.col("userid").alias("matched"), *FLAGS).alias("rule"))
    met = wide.join(r, (F.col("file_id") == F.col("f")) & (F.col("s.at") == F.col("at")) & (F.col("s.who") == F.col("who")), "left")
    best = met.groupBy("file_id", "obj_uuid", "userid").agg(F.min_by("rule", F.when(F.col("rule").isNotNull(), F.col("s.rank"))).alias("rule"))
    flag = lambda x: F.coalesce(F.col(f"rule.{x}"), F.lit(1)).cast("int").alias(x)
    return best.select("file_id", "obj_uuid", "userid", F.coalesce("rule.matched", F.lit(0)).alias("matched"), *map(flag, FLAGS))


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")
