"""Shared pieces: the folder that all executors see, cut lineage, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only on a local master where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronoframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: While this is set, Spark removes the shuffle files of a job when the job has ended, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def during(spark: SparkSession, conf: dict[str, str]):
    """Settings of the session for as long as the block runs."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes the rows as Parquet to the shared folder and reads them back: lost executors lose nothing of it.

    The shuffle files behind the rows go with the end of the job; a plan that is run again makes them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with during(spark, {CLEANUP: "true"}):
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `stored`, once all that is read from them later has itself been stored."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def col(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of the table has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes of rows up to this number are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 24 << 20
_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def bounded(df: DataFrame) -> DataFrame:
    """The rows with a hint to broadcast them where they have few bytes; rows and their bytes are counted first."""
    fixed, size = 16, F.lit(0).cast("bigint")
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(col(field.name)), F.lit(0)) + 16
        elif kind in ("array<int>", "array<bigint>", "array<double>"):
            size = size + F.greatest(F.coalesce(F.size(col(field.name)), F.lit(0)), F.lit(0)) * 8 + 24
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(col(field.name)))), F.lit(0)) + 32
        else:
            fixed += max(8, _WIDTHS.get(kind, 8))
    total = df.agg(F.coalesce(F.sum(size + fixed), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= MOST_BROADCAST else df


def by_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[Column, Column]:
    """What tells rows apart: the id, and a hash of the text.  Rows equal in both are given equal results."""
    return col(id_column), F.xxhash64(F.coalesce(col(text_column), F.lit("")))


def match_rows(docs: DataFrame, found: DataFrame, how: str, id_column: str = "doc_id", text_column: str = "text", hint: bool = True) -> DataFrame:
    """The documents joined with rows (doc_id, key, ...) that `by_text` names; null ids match null ids.

    The columns of `found` beyond these two must not clash; those of the documents may have any name.
    """
    names = fresh(docs, "_id", "_key")
    found = found.withColumnsRenamed({"doc_id": names[0], "key": names[1]})
    doc_id, key = by_text(docs, id_column, text_column)
    return docs.join(bounded(found) if hint else found, doc_id.eqNullSafe(F.col(names[0])) & (key == F.col(names[1])), how).drop(*names)


def partition_prefix(df: DataFrame, part: str, value: str, name: str) -> DataFrame:
    """For each value of `part` the sum of `value` over the smaller ones; the table has a row for each task that wrote."""
    sums = df.groupBy(part).agg(F.sum(value).alias("_s"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(part, F.coalesce(F.sum("_s").over(before), F.lit(0)).cast("bigint").alias(name))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); the component is its smallest node.

    Alternating large-star and small-star steps: each needs only minima by node, which are combined
    before the shuffle, so a node with very many edges costs no task more than others.  The edges
    are written to the shared folder after each round.  No edges give no rows.
    """

    def large_star(e: DataFrame) -> DataFrame:
        """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        """Every smaller neighbour of u, and u, are linked to the smallest of them."""
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    now = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    state = None
    while True:
        now = stored(small_star(large_star(now)), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
