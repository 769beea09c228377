"""What several operators share: the shared scratch folder, size-checked broadcasts, word hashes, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but these characters (SQL and Java pattern).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a broadcast side may have; beyond it a shuffle join does the same work.
BROADCAST_ROWS = 200_000


#: The folder of a local application that names none.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _local.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="spark-shared-")
        _local[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    _made.append(out)
    return out


#: What ``materialise`` wrote in this process and nobody has deleted, the oldest first.
_made: list[DataFrame] = []


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` written under ``name``; what was written for it on the way is deleted."""
    before = len(_made)
    out = materialise(make(), name)
    discard(*_made[before:-1])
    return out


def discard(*written: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once everything that reads it is written itself."""
    for df in written:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)
        _made[:] = [x for x in _made if x is not df]


def narrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts are wide: send at most so many rows to Python at once. A larger session setting is lowered and stays so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` (written, cheap to count) has at most ``rows`` rows; else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name = f"_{name}"
    return name


def lower_ascii(text):
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words_of(text):
    """Words of a text as an array; null gives an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value, body):
    """``body(x)`` with ``x`` bound to ``value`` once; a plain column would be evaluated again at each use."""
    return F.transform(F.array(value), body)[0]


def word_shingles(words, k: int):
    """64-bit hashes of the windows of ``k`` words, in order; a shorter non-empty sequence is one shingle."""

    def grams(w):
        at = F.sequence(F.lit(0), F.size(w) - k)
        each = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        whole = F.array(F.xxhash64(F.concat_ws(" ", w), F.size(w)))
        return F.when(F.size(w) >= k, each).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(words, grams)


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3 ... in the order, which should tell all rows apart.

    Rows are dealt to ranges of the order and written; only rows of one range are ordered together, and what comes
    before a range (a row per range) is added.
    """
    dealt = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranked")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    start = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order)
    numbered = dealt.withColumn(name, F.row_number().over(inside).cast("long")).join(F.broadcast(start), "_range")
    return numbered.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a, b bigint): rows (node, root), root the smallest node.

    Alternating large-star and small-star steps, each a grouping and a join; the edges are written after every round.
    Nodes without an edge to another node don't occur. Repeated edges, both directions and loops are allowed.
    """

    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return pairs.join(least, "u")

    def total(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    was = total(e)
    while was[0]:
        both = e.selectExpr("a AS u", "b AS v").unionAll(e.selectExpr("b AS u", "a AS v"))
        large = star(both).where("v > u").selectExpr("v AS a", "m AS b").distinct()
        down = large.selectExpr("a AS u", "b AS v")
        s = star(down)
        step = s.selectExpr("v AS a", "m AS b").unionAll(s.selectExpr("u AS a", "m AS b")).where("a <> b").distinct()
        last, e = e, materialise(step, name)
        discard(last)
        now = total(e)
        if now == was:
            break
        was = now
    out = materialise(e.selectExpr("a AS node", "b AS root").unionAll(e.selectExpr("b AS node", "b AS root")).distinct(), name)
    discard(e)
    return out
