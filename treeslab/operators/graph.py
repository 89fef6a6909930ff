"""The object graph: paths, links, counts, listings and changes.

Links are an edge table. Walks go level by level from the roots, as joins of the frontier with the
edges; an object that was reached before isn't walked again, so cycles end and nothing is limited by depth unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeslab.sources.documents import SCHEMAS, Tables, checkpoint_dir

HARD, SOFT, EXTERNAL, USER = "H5L_TYPE_HARD", "H5L_TYPE_SOFT", "H5L_TYPE_EXTERNAL", "H5L_TYPE_USER_DEFINED"


class NotPermitted(PermissionError):
    """A change that isn't allowed."""


def walk(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, revisit: bool = False) -> DataFrame:
    """file_id, uuid, path, depth of what edges (file_id, parent, title, child) reach from roots (file_id, uuid).

    Each object comes with its first path (least depth, then path order). revisit: all paths up to max_depth,
    except those that come back to an object on them.
    """
    checkpoint_dir(edges.sparkSession)
    level = roots.select("file_id", "uuid", F.lit("/").alias("path"), F.lit(0).alias("depth"), F.array("uuid").alias("trail")).checkpoint()
    seen, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        path = F.concat(F.when(F.col("path") == "/", "").otherwise(F.col("path")), F.lit("/"), F.col("title"))
        step = level.withColumnRenamed("uuid", "parent").join(edges, ["file_id", "parent"])
        step = step.where(~F.array_contains("trail", F.col("child"))) if revisit else step
        trail = F.array_append("trail", F.col("child")) if revisit else F.array("child")
        level = step.select("file_id", F.col("child").alias("uuid"), path.alias("path"), F.lit(depth).alias("depth"), trail.alias("trail"))
        if not revisit:
            level = level.groupBy("file_id", "uuid").agg(F.min("path").alias("path"), F.first("depth").alias("depth"), F.first("trail").alias("trail"))
            level = level.join(seen.select("file_id", "uuid"), ["file_id", "uuid"], "left_anti")
        level = level.checkpoint()
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.drop("trail")


def hard_edges(tables: Tables) -> DataFrame:
    return tables.links.where(F.col("class") == HARD).select("file_id", F.col("group_uuid").alias("parent"), "title", F.col("id").alias("child"))


def _roots(tables: Tables) -> DataFrame:
    return tables.files.select("file_id", F.col("root").alias("uuid"))


def reachable(tables: Tables) -> DataFrame:
    """file_id, uuid, path, depth of all objects that hard links reach."""
    return walk(hard_edges(tables), _roots(tables))


def anonymous(tables: Tables) -> DataFrame:
    """file_id, uuid, collection of objects that no hard link names, but for the roots."""
    named = hard_edges(tables).select("file_id", F.col("child").alias("uuid")).unionByName(_roots(tables))
    return tables.objects().join(named.distinct(), ["file_id", "uuid"], "left_anti")


#: Soft links that a path may lead through.
MAX_HOPS = 16


def _names(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _followed(tables: Tables, starts: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Where the rows of starts (key, file_id, uuid, parts) lead: key, collection, uuid; rows that lead nowhere have gone.

    Each round takes one name of every path, by one join with the links on (group, title); a soft link puts its own names in front. A path
    through more than max_hops soft links fails: it may go round in a circle.
    """
    checkpoint_dir(starts.sparkSession)
    links = tables.links.where(F.col("class").isin(HARD, SOFT)).select("file_id", F.col("group_uuid").alias("uuid"), F.col("title").alias("name"), "class", "id", F.col("collection").alias("to"), "h5path")
    roots = tables.files.select("file_id", "root")
    level = starts.join(roots, "file_id").select("key", "file_id", "root", "uuid", "parts", F.lit("groups").alias("collection"), F.lit(0).alias("hops")).checkpoint()
    done = None
    while True:
        there = level.where(F.size("parts") == 0).select("key", "collection", "uuid")
        done = there if done is None else done.unionByName(there)
        going = level.where((F.size("parts") > 0) & (F.col("collection") == "groups")).withColumn("name", F.get("parts", F.lit(0)))
        if going.isEmpty():
            return done
        step = going.join(links, ["file_id", "uuid", "name"])
        rest, hard = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), F.col("class") == HARD
        hops = F.col("hops") + F.when(hard, 0).otherwise(1)
        level = step.select(
            "key",
            "file_id",
            "root",
            F.when(hard, F.col("id")).when(F.col("h5path").startswith("/"), F.col("root")).otherwise(F.col("uuid")).alias("uuid"),
            F.when(hard, rest).otherwise(F.concat(_names(F.col("h5path")), rest)).alias("parts"),
            F.when(hard, F.col("to")).otherwise(F.lit("groups")).alias("collection"),
            F.when(hops > max_hops, F.raise_error(F.concat(F.lit("over "), F.lit(max_hops), F.lit(" soft links in a path of "), F.col("file_id"))).cast("int")).otherwise(hops).alias("hops"),
        ).checkpoint()


def lookup_paths(tables: Tables, paths: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """paths (file_id, path, and others) with the collection and uuid they lead to, along hard and soft links; nulls where they lead nowhere.

    All paths go together: one join for each name of the longest.
    """
    if paths.select(F.max(F.get(_names(F.col("path")), F.lit(0)) == "__db__")).first()[0]:
        raise NotPermitted("paths of the index are not to be read")
    asked = paths.select("file_id", "path").distinct()
    roots = tables.files.select("file_id", "root")
    starts = asked.join(roots, "file_id").select(F.struct("file_id", "path").alias("key"), "file_id", F.col("root").alias("uuid"), _names(F.col("path")).alias("parts"))
    found = _followed(tables, starts, max_hops).select("key.file_id", "key.path", "collection", "uuid")
    return paths.join(found, ["file_id", "path"], "left")


def resolve(tables: Tables, path: str, file_id: str | None = None, max_hops: int = MAX_HOPS) -> tuple[str, str, str] | None:
    """(file_id, collection, uuid) at a path of one document, following hard and soft links; None if it leads nowhere."""
    t = tables.only(file_id) if file_id else tables
    root = t.files.select("file_id").first()
    if root is None:
        return None
    asked = t.files.limit(1).select("file_id", F.lit(path).alias("path"))
    found = lookup_paths(t.only(root.file_id), asked, max_hops).first()
    return (found.file_id, found.collection, found.uuid) if found.uuid is not None else None


def object_row(tables: Tables, collection: str, uuid: str) -> DataFrame:
    """The row of an object; collection is groups, datasets or datatypes."""
    if collection not in ("groups", "datasets", "datatypes"):
        raise ValueError(f"no such collection: {collection}")
    return getattr(tables, collection).where(F.col("uuid") == uuid)


def collection_of(tables: Tables, uuid: str) -> str | None:
    found = tables.objects().where(F.col("uuid") == uuid).select("collection").first()
    return found.collection if found else None


def page(rows: DataFrame, by: str, marker: str | None = None, limit: int = 0) -> DataFrame:
    """Rows in the order of a name, those after the marker, so many of them; 0: all. A top-k, not a full sort, with a limit."""
    kept = (rows.where(F.col(by) > marker) if marker is not None else rows).orderBy(by)
    return kept.limit(limit) if limit else kept


def collection_page(tables: Tables, collection: str, marker: str | None = None, limit: int | None = None) -> DataFrame:
    """file_id, uuid of a collection but for the roots: linked objects; with a limit (0: none) the anonymous after them.

    A page goes on after the marker's own place: linked objects before anonymous ones, each in the order of their uuids.
    """
    roots = _roots(tables)
    every = getattr(tables, collection).select("file_id", "uuid").join(roots, ["file_id", "uuid"], "left_anti")
    loose = anonymous(tables).where(F.col("collection") == collection).select("file_id", "uuid", F.lit(1).alias("loose"))
    rows = every.join(loose, ["file_id", "uuid"], "left").fillna(0, ["loose"])
    if limit is None:
        rows = rows.where("loose = 0")
    if marker is not None:
        at = rows.where(F.col("uuid") == marker).agg(F.max("loose")).first()[0] or 0
        rows = rows.where((F.col("loose") > at) | (F.col("loose") == at) & (F.col("uuid") > marker))
    rows = rows.orderBy("loose", "uuid")
    return (rows.limit(limit) if limit else rows).select("file_id", "uuid")


def group_items(tables: Tables) -> DataFrame:
    """Groups with the numbers of their attributes and links."""
    links = tables.links.groupBy("file_id", F.col("group_uuid").alias("uuid")).agg(F.count(F.lit(1)).alias("link_count"))
    return _counted(tables, tables.groups, "groups").join(links, ["file_id", "uuid"], "left").fillna(0, ["link_count"])


def dataset_items(tables: Tables) -> DataFrame:
    """Datasets without values: their types (named ones looked up), shapes and numbers of attributes."""
    named = tables.datatypes.select("file_id", F.concat(F.lit("datatypes/"), "uuid").alias("type_json"), F.col("type_json").alias("named_type"))
    items = _counted(tables, tables.datasets.drop("value_json"), "datasets").join(named, ["file_id", "type_json"], "left")
    return items.withColumn("type_ref", F.when(F.col("named_type").isNotNull(), F.col("type_json"))).withColumn("type_json", F.coalesce("named_type", "type_json")).drop("named_type")


def dataset_types(tables: Tables) -> DataFrame:
    return dataset_items(tables).select("file_id", "uuid", "type_json", "type_ref")


def datatype_items(tables: Tables) -> DataFrame:
    return _counted(tables, tables.datatypes, "datatypes")


def _counted(tables: Tables, rows: DataFrame, collection: str) -> DataFrame:
    n = tables.attributes.where(F.col("owner_collection") == collection).groupBy("file_id", F.col("owner_uuid").alias("uuid")).agg(F.count(F.lit(1)).alias("attribute_count"))
    return rows.join(n, ["file_id", "uuid"], "left").fillna(0, ["attribute_count"])


def counts(tables: Tables) -> DataFrame:
    """file_id, collection, n; anonymous objects included."""
    return tables.objects().groupBy("file_id", "collection").agg(F.count(F.lit(1)).alias("n"))


def link_items(links: DataFrame) -> DataFrame:
    """Links with what their class tells, and the address of a hard link's target."""
    kind = F.col("class")
    return links.select(
        "file_id",
        "group_uuid",
        "title",
        "class",
        F.when(kind == HARD, F.col("id")).alias("id"),
        F.when(kind == HARD, F.col("collection")).alias("collection"),
        F.when(kind == HARD, F.concat_ws("/", "collection", "id")).alias("href"),
        F.when(kind.isin(SOFT, EXTERNAL), F.col("h5path")).alias("h5path"),
        F.when(kind == EXTERNAL, F.col("file")).alias("file"),
    )


def link_page(tables: Tables, group: str, marker: str | None = None, limit: int = 0) -> DataFrame:
    return page(link_items(tables.links.where(F.col("group_uuid") == group)), "title", marker, limit)


def link_counts(tables: Tables, max_hops: int = MAX_HOPS) -> DataFrame:
    """file_id, uuid, n: links that lead to each object. Hard links name it; a soft link counts with the object that its path leads to from
    its own group, whatever hard and soft links are on the way. A soft link whose path leads nowhere counts with none."""
    hard = hard_edges(tables).select("file_id", F.col("child").alias("uuid"))
    soft = tables.links.where(F.col("class") == SOFT).join(_roots(tables).withColumnRenamed("uuid", "root"), "file_id")
    begin = F.when(F.col("h5path").startswith("/"), F.col("root")).otherwise(F.col("group_uuid"))
    starts = soft.select(F.struct("file_id", "group_uuid", "title").alias("key"), "file_id", begin.alias("uuid"), _names(F.col("h5path")).alias("parts"))
    aimed = _followed(tables, starts, max_hops).select("key.file_id", "uuid")
    return hard.unionByName(aimed).groupBy("file_id", "uuid").agg(F.count(F.lit(1)).alias("n"))


def is_hard_linked(tables: Tables, uuid: str) -> bool:
    return not hard_edges(tables).where(F.col("child") == uuid).isEmpty()


def dereference(rows: DataFrame, ref: Column, tables: Tables) -> DataFrame:
    """rows with the object that a reference (struct<collection, id>) names: found tells whether it exists; null stays null."""
    objects = tables.objects().select("file_id", F.struct("collection", F.col("uuid").alias("id")).alias("target_ref"), F.lit(True).alias("found"))
    return rows.withColumn("target_ref", ref).join(objects, ["file_id", "target_ref"], "left").withColumn("found", F.when(F.col("target_ref").isNotNull(), F.coalesce("found", F.lit(False)))).drop("target_ref")


def _one(tables: Tables, name: str, /, **values: object) -> DataFrame:
    frame = getattr(tables, name)
    return frame.sparkSession.createDataFrame([values], SCHEMAS[name])


def _link(tables: Tables, file_id: str, group: str, title: str, /, **values: object) -> Tables:
    if not title or "/" in title:
        raise ValueError("a link's title has no /")
    mine = (F.col("file_id") == file_id) & (F.col("group_uuid") == group)
    last = tables.links.where(mine).agg(F.max("ordinal")).first()[0]
    row = {x.split(" ")[0]: None for x in SCHEMAS["links"].split(", ")} | {"file_id": file_id, "group_uuid": group, "title": title, "ordinal": -1 if last is None else last} | values
    row["ordinal"] += 1
    kept = tables.links.where(~(mine & (F.col("title") == title)))
    return tables.with_(links=kept.unionByName(_one(tables, "links", **row)))


def link_object(tables: Tables, file_id: str, group: str, child: str, title: str) -> Tables:
    """A hard link; it replaces one of the same title."""
    where = collection_of(tables.only(file_id), child)
    if where is None:
        raise LookupError(f"no object {child}")
    return _link(tables, file_id, group, title, **{"class": HARD, "collection": where, "id": child})


def soft_link(tables: Tables, file_id: str, group: str, path: str, title: str) -> Tables:
    return _link(tables, file_id, group, title, **{"class": SOFT, "h5path": path})


def external_link(tables: Tables, file_id: str, group: str, file: str, path: str, title: str) -> Tables:
    return _link(tables, file_id, group, title, **{"class": EXTERNAL, "file": file, "h5path": path})


def unlink(tables: Tables, file_id: str, group: str, title: str) -> Tables:
    """Take a link away. Its object stays, anonymous if it was the last hard link."""
    if title == "__db__":
        raise NotPermitted("the index cannot be unlinked")
    mine = (F.col("file_id") == file_id) & (F.col("group_uuid") == group) & (F.col("title") == title)
    found = tables.links.where(mine).first()
    if found is None:
        raise LookupError(f"no link {title}")
    if found["class"] == USER:
        raise NotPermitted("user-defined links cannot be unlinked")
    return tables.with_(links=tables.links.where(~mine))


def delete_object(tables: Tables, file_id: str, collection: str, uuid: str, now: int) -> Tables:
    """Take an object away with all links to it, its own links and attributes; its time of deletion stays."""
    if not tables.files.where((F.col("file_id") == file_id) & (F.col("root") == uuid)).isEmpty():
        raise NotPermitted("the root group cannot be deleted")
    if object_row(tables.only(file_id), collection, uuid).isEmpty():
        raise LookupError(f"no object {uuid}")
    other = lambda column: (F.col("file_id") != file_id) | F.col(column).isNull() | (F.col(column) != uuid)
    return tables.with_(
        **{collection: getattr(tables, collection).where(other("uuid"))},
        links=tables.links.where(other("id") & other("group_uuid")),
        attributes=tables.attributes.where(other("owner_uuid")),
        times=tables.times.unionByName(_one(tables, "times", file_id=file_id, uuid=uuid, obj_type="object", name=None, ctime=None, mtime=now)),
    )


def create_group(tables: Tables, file_id: str, uuid: str) -> Tables:
    """A group, anonymous until it is linked."""
    return tables.with_(groups=tables.groups.unionByName(_one(tables, "groups", file_id=file_id, uuid=uuid, alias=[], created=None, last_modified=None, creation_properties=None)))


def create_datatype(tables: Tables, file_id: str, uuid: str, type_json: str) -> Tables:
    return tables.with_(datatypes=tables.datatypes.unionByName(_one(tables, "datatypes", file_id=file_id, uuid=uuid, alias=[], type_json=type_json)))


def presence(ids: DataFrame, objects: DataFrame, times: DataFrame) -> DataFrame:
    """ids (uuid) with state: present; deleted (a time is left); unknown."""
    here = objects.select("uuid", F.lit(1).alias("here")).distinct()
    timed = times.where("mtime is not null").select("uuid", F.lit(1).alias("timed")).distinct()
    state = F.when(F.col("here").isNotNull(), "present").when(F.col("timed").isNotNull(), "deleted").otherwise("unknown")
    return ids.join(here, "uuid", "left").join(timed, "uuid", "left").select(*ids.columns, state.alias("state"))
