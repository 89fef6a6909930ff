"""Documents as tables: one JSON text a document, its objects, links and attributes as rows.

Types, values and creation properties stay JSON text until someone asks for them, so reading a catalogue
never parses the arrays, and columns that aren't used are pruned.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeslab.functions.codec import let
from treeslab.functions.spaces import SHAPE

ATTRIBUTE = f"struct<name: string, type: string, shape: {SHAPE}, value: string>"
LINK = "struct<title: string, class: string, collection: string, id: string, h5path: string, file: string, target: string>"
DOCUMENT = (
    "struct<apiVersion: string, root: string, id: string, created: string, lastModified: string, creationProperties: string,"
    f" groups: map<string, struct<alias: array<string>, created: string, lastModified: string, creationProperties: string, attributes: array<{ATTRIBUTE}>, links: array<{LINK}>>>,"
    f" datasets: map<string, struct<alias: array<string>, type: string, shape: {SHAPE}, creationProperties: string, value: string, attributes: array<{ATTRIBUTE}>>>,"
    f" datatypes: map<string, struct<alias: array<string>, type: string, attributes: array<{ATTRIBUTE}>>>>"
)
#: A line of a document: its head, objects, or links and attributes of an object, the first of which stands at place.
LINE = f"{DOCUMENT[:-1]}, place: int>"
VERSIONS = ("1.0.0", "1.1.0", "1.1.1")
CURRENT = "1.1.1"
TIME = "file_id string, uuid string, obj_type string, name string, ctime bigint, mtime bigint"
ACL = "file_id string, obj_uuid string, userid int, `create` tinyint, `read` tinyint, `update` tinyint, `delete` tinyint, readACL tinyint, updateACL tinyint"
SCHEMAS = {
    "files": "file_id string, api_version string, root string, id string, created string, last_modified string, creation_properties string",
    "groups": "file_id string, uuid string, alias array<string>, created string, last_modified string, creation_properties string",
    "links": "file_id string, group_uuid string, ordinal int, title string, class string, collection string, id string, h5path string, file string, target string",
    "datasets": f"file_id string, uuid string, alias array<string>, type_json string, shape {SHAPE}, creation_properties string, value_json string",
    "datatypes": "file_id string, uuid string, alias array<string>, type_json string",
    "attributes": f"file_id string, owner_collection string, owner_uuid string, ordinal int, name string, type_json string, shape {SHAPE}, value_json string",
    "times": TIME,
    "acls": ACL,
}


@dataclass(frozen=True)
class Tables:
    """All objects of some documents. A change gives new Tables; nothing is changed in place."""

    files: DataFrame
    groups: DataFrame
    links: DataFrame
    datasets: DataFrame
    datatypes: DataFrame
    attributes: DataFrame
    times: DataFrame
    acls: DataFrame

    def with_(self, **frames: DataFrame) -> Tables:
        return replace(self, **frames)

    def merged(self, other: Tables) -> Tables:
        return Tables(**{x.name: getattr(self, x.name).unionByName(getattr(other, x.name)) for x in fields(self)})

    def objects(self) -> DataFrame:
        """file_id, uuid, collection of every object."""
        frames = [getattr(self, c).select("file_id", "uuid", F.lit(c).alias("collection")) for c in ("groups", "datasets", "datatypes")]
        return frames[0].unionByName(frames[1]).unionByName(frames[2])

    def only(self, file_id: str) -> Tables:
        return Tables(**{x.name: getattr(self, x.name).where(F.col("file_id") == file_id) for x in fields(self)})


def empty(spark: SparkSession, root: str, file_id: str = "new") -> Tables:
    """A new document with a root group and nothing else."""
    frames = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    frames["files"] = spark.createDataFrame([(file_id, CURRENT, root, None, None, None, None)], SCHEMAS["files"])
    frames["groups"] = spark.createDataFrame([(file_id, root, ["/"], None, None, None)], SCHEMAS["groups"])
    return Tables(**frames)


def texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file_id and text of each file of a path; missing paths fail as FileNotFoundError."""
    try:
        return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("file_id"), F.col("value").alias("text"))
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(str(path)) from error
        raise


def from_texts(rows: DataFrame, strict: bool = False, once: bool = False) -> Tables:
    """Tables of JSON texts (file_id, text). A text that is no document gives no rows; strict: it fails.

    Each table parses the texts when it is read, only as far as it needs. once: for a caller that reads all tables, the texts are parsed
    into Parquet in the checkpoint folder first.
    """
    doc = F.from_json("text", DOCUMENT)
    parsed = rows.select("file_id", doc.alias("d"))
    good = F.col("d.root").isNotNull()
    if strict:
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no document: "), F.col("file_id"))).cast("boolean"))
    return _tables(kept(parsed.where(good)) if once else parsed.where(good))


def from_lines(rows: DataFrame, once: bool = False) -> Tables:
    """Tables of documents in lines (file_id, text), as writer.dump_lines makes them, in any order. A line that is no part of a document fails.

    once: as in from_texts.
    """
    wrong = F.raise_error(F.concat(F.lit("no line of a document: "), F.col("file_id")))
    part = let(F.from_json("text", LINE), lambda d: F.when(F.coalesce(*(F.when(d[x].isNotNull(), True) for x in ("root", "groups", "datasets", "datatypes")), F.lit(False)), d).otherwise(wrong))
    parsed = rows.select("file_id", part.alias("d"))
    return _tables(kept(parsed) if once else parsed, F.col("d.place"))


def _tables(parsed: DataFrame, place: Column | None = None) -> Tables:
    """Tables of parsed documents (file_id, d). place: where the links and attributes of a line begin; null in lines that tell objects."""
    place = F.lit(None).cast("int") if place is None else place

    def each(collection: str) -> DataFrame:
        return parsed.select("file_id", place.alias("place"), F.explode(f"d.{collection}").alias("uuid", "o"))

    def entries(objects: DataFrame, name: str, *more: Column) -> DataFrame:
        """The links or attributes of objects, with their ordinals."""
        found = objects.select("file_id", "uuid", "place", *more, F.posexplode(f"o.{name}").alias("at", "x"))
        return found.withColumn("ordinal", F.coalesce("place", F.lit(0)) + F.col("at"))

    parts = [each(x) for x in ("groups", "datasets", "datatypes")]
    groups, datasets, datatypes = (x.where("place is null") for x in parts)
    attributes = None
    for name, frame in zip(("groups", "datasets", "datatypes"), parts):
        part = entries(frame, "attributes", F.lit(name).alias("owner_collection")).withColumnRenamed("uuid", "owner_uuid")
        part = part.select("file_id", "owner_collection", "owner_uuid", "ordinal", "x.name", F.col("x.type").alias("type_json"), _space(F.col("x.shape")).alias("shape"), F.col("x.value").alias("value_json"))
        attributes = part if attributes is None else attributes.unionByName(part)
    spark = parsed.sparkSession
    return Tables(
        files=parsed.where("d.root is not null").select("file_id", F.col("d.apiVersion").alias("api_version"), "d.root", "d.id", "d.created", F.col("d.lastModified").alias("last_modified"), F.col("d.creationProperties").alias("creation_properties")),
        groups=groups.select("file_id", "uuid", "o.alias", "o.created", F.col("o.lastModified").alias("last_modified"), F.col("o.creationProperties").alias("creation_properties")),
        links=entries(parts[0], "links").withColumnRenamed("uuid", "group_uuid").select("file_id", "group_uuid", "ordinal", "x.*"),
        datasets=datasets.select("file_id", "uuid", "o.alias", F.col("o.type").alias("type_json"), F.coalesce("o.shape", F.struct(F.lit("H5S_SCALAR").alias("class"), F.lit(None).alias("dims"), F.lit(None).alias("maxdims")).cast(SHAPE)).alias("shape"), F.col("o.creationProperties").alias("creation_properties"), F.col("o.value").alias("value_json")),
        datatypes=datatypes.select("file_id", "uuid", "o.alias", F.col("o.type").alias("type_json")),
        attributes=attributes,
        times=spark.createDataFrame([], TIME),
        acls=spark.createDataFrame([], ACL),
    )


def _space(shape: Column) -> Column:
    """An attribute without a shape has no elements."""
    return F.coalesce(shape, F.struct(F.lit("H5S_NULL").alias("class"), F.lit(None).alias("dims"), F.lit(None).alias("maxdims")).cast(SHAPE))


def read(spark: SparkSession, path: str | list[str], strict: bool = False) -> Tables:
    """Tables of the JSON documents in a path."""
    return from_texts(texts(spark, path), strict)


def readable(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file_id and whether the file holds a document."""
    return texts(spark, path).select("file_id", F.col("text").isNotNull() & F.from_json("text", "struct<root: string>")["root"].isNotNull())


def save(tables: Tables, path: str) -> None:
    """All tables as Parquet, replacing what is there."""
    for x in fields(tables):
        getattr(tables, x.name).write.mode("overwrite").parquet(f"{path}/{x.name}")


def load(spark: SparkSession, path: str) -> Tables:
    return Tables(**{x.name: spark.read.parquet(f"{path}/{x.name}") for x in fields(Tables)})


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; where it is unset, one of our own if all runs on this machine, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="treeslab-checkpoints-"))


def kept(frame: DataFrame) -> DataFrame:
    """A frame written to the checkpoint folder and read again; the files go when the driver's interpreter ends."""
    spark = frame.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    atexit.register(_removed, spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def version_info(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(CURRENT, spark.version)], "api_version string, engine_version string")
