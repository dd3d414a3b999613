"""Union schemas of many Parquet files without opening every footer again.

``mergeSchema`` opens the footers of all files on every read. A registry keeps, per file, its length, its modification
time and its columns, as a Parquet table; a read opens the footers of new and changed files only. Files that
are seen for the first time together share one schema, which counts while any of them is listed unchanged.
"""

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = "file string, length bigint, modified bigint"


def listing(spark: SparkSession, paths) -> list[tuple]:
    """(file, length, modified in ms) of the Parquet files at the paths, which may be folders, sorted by file."""
    conf, out = spark._jsc.hadoopConfiguration(), []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = place.getFileSystem(conf).listFiles(place, True)
        while found.hasNext():
            status = found.next()
            if not status.getPath().getName().startswith(("_", ".")):
                out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(out)


def merged(schemas) -> T.StructType:
    """All columns in order of first appearance; a column of two types is an error."""
    def add(one, other):
        types = {f.name: f for f in one}
        for f in other:
            if f.name in types and types[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} is {types[f.name].dataType.simpleString()} and {f.dataType.simpleString()}")
            types.setdefault(f.name, f)
        return T.StructType(list(types.values()))

    return reduce(add, schemas, T.StructType())


class SchemaRegistry:
    """Stored columns of the files of one period, in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def stored(self) -> DataFrame:
        """file, length, modified, schema (JSON) of the files seen so far; of a file seen twice both rows."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], FILES + ", schema string")
        return self.spark.read.schema(FILES + ", schema string").parquet(self.path)

    def schema(self, paths) -> tuple[T.StructType, int]:
        """(union schema of the files at the paths, footers opened for it).

        New files are opened one batch for all: their union is stored with each of them, so a registry holds as many
        different schemas as batches brought new columns.
        """
        files = listing(self.spark, paths)
        now = self.spark.createDataFrame(files, FILES)
        names = ["file", "length", "modified"]
        new = [r.file for r in now.join(self.stored(), names, "left_anti").orderBy("file").collect()]
        if new:
            found = self.spark.read.option("mergeSchema", "true").parquet(*new).schema
            rows = now.join(self.spark.createDataFrame([(f,) for f in new], "file string"), "file", "left_semi")
            rows.select(*names, F.lit(found.json()).alias("schema")).coalesce(1).write.mode("append").parquet(self.path)
        known = self.stored().join(now, names, "left_semi").groupBy("schema").agg(F.min("file").alias("first")).orderBy("first")
        return merged(T.StructType.fromJson(json.loads(r.schema)) for r in known.collect()), len(new)

    def read(self, paths) -> DataFrame:
        """The files at the paths; columns a file lacks are null there."""
        schema, _ = self.schema(paths)
        return self.spark.read.schema(schema).parquet(*paths)
