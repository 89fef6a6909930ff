"""Tables back to JSON documents, put together by Spark: one text a document."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeslab.functions.codec import quoted
from treeslab.operators.graph import reachable
from treeslab.sources.documents import Tables


def json_object(**members: Column) -> Column:
    """A JSON object of members that are JSON texts; null members are left out; names in order."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(json.dumps(k) + ":"), members[k]) for k in sorted(members))), F.lit("}"))


def json_list(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))


def _string(text: Column) -> Column:
    return F.when(text.isNotNull(), quoted(text))


def _type(text: Column) -> Column:
    """A type's text: an object as it is, a reference quoted."""
    return F.when(text.startswith("{"), text).otherwise(quoted(text))


def _shape(shape: Column) -> Column:
    limits = F.transform(shape["maxdims"], lambda x: F.when(x == "H5S_UNLIMITED", quoted(x)).otherwise(x))
    return json_object(**{"class": quoted(shape["class"]), "dims": F.to_json(shape["dims"]), "maxdims": F.concat(F.lit("["), F.array_join(limits, ","), F.lit("]"))})


def _value(value: Column, kind: Column, shape: Column, base: Column | None = None) -> Column:
    """A stored value's JSON: a scalar string was unquoted by reading; a space with a zero extent holds nothing."""
    empty = F.exists(F.coalesce(shape["dims"], F.array().cast("array<bigint>")), lambda d: d == 0)
    text = (shape["class"] == "H5S_SCALAR") & (F.get_json_object(kind, "$.class").isin("H5T_STRING", "H5T_REFERENCE", "H5T_OPAQUE") | kind.startswith("datatypes/")) & ~value.rlike(r"^\s*[\[{]")
    text = text | ((F.get_json_object(kind, "$.class") == "H5T_OPAQUE") & ~value.startswith("["))
    return F.when(empty, F.lit("[]")).when(value.isNull(), F.lit("null")).when(text, quoted(value)).otherwise(value)


def _attribute(data: bool) -> Column:
    """An attribute's JSON."""
    members = {"name": quoted(F.col("name")), "type": _type(F.col("type_json")), "shape": _shape(F.col("shape"))}
    if data:
        members["value"] = F.when(F.col("value_json").isNotNull(), _value(F.col("value_json"), F.col("type_json"), F.col("shape")))
    return json_object(**members)


def _link() -> Column:
    """A link's JSON."""
    return json_object(**{x: _string(F.col(x)) for x in ("title", "class", "collection", "id", "h5path", "file")} | {"target": F.col("target")})


def _own(collection: str, header: str) -> dict[str, Column]:
    """An object's members, but for its attributes and links."""
    alias = {"alias": json_list(F.transform("alias", quoted))}
    if collection == "groups":
        return alias | {"creationProperties": F.col("creation_properties"), "created": _string(F.col("created")), "lastModified": _string(F.col("last_modified"))}
    kind = alias | {"type": _type(F.col("type_json"))}
    if collection == "datatypes":
        return kind
    value = {"value": _value(F.col("value_json"), F.col("type_json"), F.col("shape"))} if header == "all" else {}
    return kind | {"shape": _shape(F.col("shape")), "creationProperties": F.col("creation_properties")} | value


def _head() -> dict[str, Column]:
    """A document's members, but for its objects."""
    return {
        "apiVersion": quoted(F.coalesce("api_version", F.lit("1.1.1"))),
        "root": quoted(F.col("root")),
        "id": _string(F.col("id")),
        "created": _string(F.col("created")),
        "lastModified": _string(F.col("last_modified")),
        "creationProperties": F.col("creation_properties"),
    }


def _attributes(tables: Tables, data: bool) -> DataFrame:
    """file_id, collection, uuid, attributes (JSON)."""
    made = tables.attributes.select("file_id", F.col("owner_collection").alias("collection"), F.col("owner_uuid").alias("uuid"), F.struct("ordinal", _attribute(data).alias("j")).alias("x"))
    grouped = made.groupBy("file_id", "collection", "uuid").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return grouped.select("file_id", "collection", "uuid", json_list(F.transform("xs", lambda x: x["j"])).alias("attributes"))


def _links(tables: Tables) -> DataFrame:
    made = tables.links.select("file_id", F.col("group_uuid").alias("uuid"), F.struct("ordinal", _link().alias("j")).alias("x"))
    return made.groupBy("file_id", "uuid").agg(F.sort_array(F.collect_list("x")).alias("xs")).select("file_id", "uuid", json_list(F.transform("xs", lambda x: x["j"])).alias("links"))


def dump_objects(tables: Tables, header: str = "all", linked_only: bool = True) -> DataFrame:
    """file_id, collection, uuid, body (JSON) of each object.

    header: all; no-values (datasets without values); bare (attributes without values too).
    """
    t = purge(tables) if linked_only else tables
    a = _attributes(t, header != "bare")

    def bodies(collection: str) -> DataFrame:
        rows, more = getattr(t, collection).join(a.where(F.col("collection") == collection).drop("collection"), ["file_id", "uuid"], "left"), {"attributes": F.col("attributes")}
        if collection == "groups":
            rows, more = rows.join(_links(t), ["file_id", "uuid"], "left"), more | {"links": F.col("links")}
        return rows.select("file_id", F.lit(collection).alias("collection"), "uuid", json_object(**_own(collection, header), **more).alias("body"))

    return bodies("groups").unionByName(bodies("datasets")).unionByName(bodies("datatypes"))


def dump_lines(tables: Tables, header: str = "all", linked_only: bool = True) -> DataFrame:
    """file_id and text of each document's lines, in any order: a document of any size, none of whose rows grows with it.

    A line is JSON: the document's head, an object in its place, or a link or an attribute in its object, with its place among them. Merged, a document's
    lines are what dump gives as one text; documents.from_lines reads them.
    """
    t = purge(tables) if linked_only else tables

    def line(rows: DataFrame, collection: Column, uuid: str, body: Column, place: Column | None = None) -> DataFrame:
        end = F.lit("}}") if place is None else F.concat(F.lit('},"place":'), F.coalesce(place, F.lit(0)), F.lit("}"))
        return rows.select("file_id", F.concat(F.lit("{"), quoted(collection), F.lit(":{"), quoted(F.col(uuid)), F.lit(":"), body, end).alias("text"))

    lines = t.files.select("file_id", json_object(**_head()).alias("text"))
    for c in ("groups", "datasets", "datatypes"):
        lines = lines.unionByName(line(getattr(t, c), F.lit(c), "uuid", json_object(**_own(c, header))))
    entry = lambda name, j: F.concat(F.lit('{"%s":[' % name), j, F.lit("]}"))
    lines = lines.unionByName(line(t.attributes, F.col("owner_collection"), "owner_uuid", entry("attributes", _attribute(header != "bare")), F.col("ordinal")))
    return lines.unionByName(line(t.links, F.lit("groups"), "group_uuid", entry("links", _link()), F.col("ordinal")))


def dump(tables: Tables, header: str = "all", linked_only: bool = True) -> DataFrame:
    """file_id and text of each document; objects in the order of their uuid, a collection without objects left out.

    A document is one row here, so it has to fit into a task's memory; dump_lines has no such bound.
    """
    bodies = dump_objects(tables, header, linked_only)
    members = bodies.select("file_id", "collection", F.struct("uuid", F.concat(quoted(F.col("uuid")), F.lit(":"), F.col("body")).alias("m")).alias("x"))
    collections = members.groupBy("file_id").pivot("collection", ["groups", "datasets", "datatypes"]).agg(F.sort_array(F.collect_list("x")))
    whole = tables.files.join(collections, "file_id", "left")
    inside = lambda c: F.when(F.size(c) > 0, F.concat(F.lit("{"), F.array_join(F.transform(c, lambda x: x["m"]), ","), F.lit("}")))
    text = json_object(**_head(), **{c: inside(F.col(c)) for c in ("groups", "datasets", "datatypes")})
    return whole.select("file_id", text.alias("text"))


def purge(tables: Tables) -> Tables:
    """Only what can be reached from the roots by hard links: unlinked objects vanish with their attributes and links."""
    live = reachable(tables).select("file_id", "uuid")
    keep = lambda frame, column: frame.join(live.withColumnRenamed("uuid", column), ["file_id", column], "left_semi")
    return tables.with_(groups=keep(tables.groups, "uuid"), datasets=keep(tables.datasets, "uuid"), datatypes=keep(tables.datatypes, "uuid"), attributes=keep(tables.attributes, "owner_uuid"), links=keep(tables.links, "group_uuid"))


def write(tables: Tables, path: str, header: str = "all", linked_only: bool = True) -> None:
    """The documents as text files under path, one line a document, in folders by file_id."""
    dump(tables, header, linked_only).select("file_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("file_id").text(path)


def pretty(text: str) -> str:
    """A document with sorted keys and an indent of four."""
    return json.dumps(json.loads(text), sort_keys=True, indent=4)
