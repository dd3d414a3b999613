"""Line dedup over levelled sorted runs.

Documents are taken in batches of ascending doc_id. The line keys known so far are kept as runs:
bucketed tables sorted by key, no key in two runs. A batch merge-anti-joins its keys with every run
and writes the keys that are left, with their smallest doc_id, as a new run of level 0. When a level
has ``fanout`` runs they are merged into one run of the next level, so a batch meets at most
``fanout`` runs per level and a key is rewritten once per level. At the end the runs hold each key's
owner, and lines whose key another, smaller doc_id owns are dropped.
"""

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import ensure_checkpoint_dir, materialise
from .common import ascii_lower, query, table

BLANKS = " \t\n\x0b\x0c\r"
LINES_PER_BATCH = 50_000_000    # a batch's keys are grouped and joined at once
LEAST_BATCHES = 4
FANOUT = 2
KEY = ["k1", "k2"]


class Runs:
    """The levelled runs of one call: tables of k1, k2, owner, bucketed and sorted by the key."""

    def __init__(self, spark, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.names = spark, fanout, [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid4().hex}"
        (keys.repartition(self.buckets, *KEY).write.format("parquet")
         .option("path", f"{ensure_checkpoint_dir(self.spark)}/{name}")
         .bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name))
        self.names.append(name)
        return name

    def all(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def add(self, keys: DataFrame) -> None:
        """Anti-join ``keys`` (one row each) with the runs, add the rest, compact full levels."""
        for run in self.all():
            keys = keys.join(run.hint("merge").select(*KEY), KEY, "left_anti")
        new, level = self._write(keys), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            new = self._write(reduce(DataFrame.unionByName, map(self.spark.table, self.levels[level])))
            self.levels[level] = []
            level += 1

    def forget(self) -> None:
        """Take the runs out of the catalog; their files stay until the checkpoint folder goes."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """d, h (the text's hash), pos, k1, k2 of every line whose key has ``least`` code points or more.

    Only the 128 bits of a key's hash are kept.
    """
    key = F.trim(ascii_lower(F.col("line")), F.lit(BLANKS))
    lines = docs.select("d", "h", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("d", "h", "pos", key.alias("key"))
    return lines.where(F.length("key") >= least).select(
        "d", "h", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"))


def repeated_lines(lines: DataFrame, batches: int | None, fanout: int) -> DataFrame:
    """Rows of ``lines`` (stored) whose key a smaller d also has."""
    spark = lines.sparkSession
    total = lines.count()
    batches = batches or max(LEAST_BATCHES, -(-total // LINES_PER_BATCH))
    borders = lines.approxQuantile("d", [i / batches for i in range(1, batches)], 0.01) if total else []
    borders = sorted({int(b) for b in borders})
    runs = Runs(spark, fanout)
    try:
        for low, high in zip([None, *borders], [*borders, None]):
            batch = lines
            if low is not None:
                batch = batch.where(F.col("d") > low)
            if high is not None:
                batch = batch.where(F.col("d") <= high)
            runs.add(batch.groupBy(*KEY).agg(F.min("d").alias("owner")))
        owners = reduce(DataFrame.unionByName, runs.all())
        # a key with many lines is spread over tasks; there are at most total / share of them
        share = max(1_000, total // 2_000)
        hot = F.broadcast(materialise(lines.groupBy(*KEY).count().where(F.col("count") > share).select(
            *KEY, F.ceil(F.col("count") / share).cast("int").alias("parts"))))
        parts = F.coalesce("parts", F.lit(1))
        left = lines.join(hot, KEY, "left").withColumn("salt", F.pmod(F.xxhash64("d", "h"), parts).cast("int"))
        right = owners.join(hot, KEY, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        found = left.join(right.select(*KEY, "salt", "owner"), [*KEY, "salt"]).where("owner < d")
        return materialise(found.select("d", "h", "pos"))
    finally:
        runs.forget()


def drop_repeated_lines(docs: DataFrame, carry=(), least: int = 10, batches: int | None = None,
                        fanout: int = FANOUT) -> DataFrame:
    """doc_id, the ``carry`` columns, text without repeated lines, n_lines, n_dropped; one row per row.

    Lines end at newlines; a key is the line without blanks at its ends, A-Z lower-cased. A key of
    ``least`` code points or more loses its lines in all documents but that of the smallest doc_id,
    which keeps all of its own. A null or empty text is one empty line. Rows of the same doc_id are one
    document when keys are counted; a null doc_id is below all others. Columns not carried are left out,
    so their names may clash with these.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carry)
    d = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    rows = docs.withColumn("_d", d).withColumn("_h", F.xxhash64("text"))
    lines = materialise(line_keys(rows.select(F.col("_d").alias("d"), F.col("_h").alias("h"), "text"), least))
    gone = repeated_lines(lines, batches, fanout).groupBy("d", "h").agg(
        F.sort_array(F.collect_set("pos")).alias("_gone")).select(F.col("d").alias("_d"), F.col("h").alias("_h"), "_gone")
    n = F.size("_gone")

    def stretches(s):
        """The stretches of lines between the dropped ones, joined; each line is copied once."""
        cut = s["gone"]
        start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1) + 1)
        end = lambda i: F.when(i == F.size(cut), F.size(s["lines"])).otherwise(F.get(cut, i))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), lambda i: F.slice(
            s["lines"], start(i) + 1, end(i) - start(i)))), "\n")

    # the array of one struct binds the split lines once for all stretches
    bound = F.array(F.struct(F.split("text", "\n").alias("lines"), F.col("_gone").alias("gone")))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.get(F.transform(bound, stretches), F.lit(0)))
    n_lines = (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("bigint")
    return rows.join(gone, ["_d", "_h"], "left").select(
        "doc_id", *carry, text.alias("text"), n_lines.alias("n_lines"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n_dropped"))


SQL = r"""
WITH l AS (
  SELECT doc_id, line, pos, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
o AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE owner < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE owner IS NULL OR owner >= doc_id), ''))
         AS kept_sha256
FROM l LEFT JOIN o USING (key) GROUP BY doc_id
"""


@query("op9_line_dedup", SQL)
def op9(spark, base):
    kept = drop_repeated_lines(table(spark, base, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
