"""What the corpus operators share: reading, cutting lineage, grouping, components.

Row rules that hold for every operator unless its docstring says otherwise:

* a null text counts as the empty text;
* a row with a null ``doc_id`` has no place in the order of documents and is left out;
* of several rows with one ``doc_id`` the one with the greatest text stands for the document;
* only the named columns are read, so extra columns, whatever their names, change nothing.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a local one for a local
    session, and an error on a cluster, whose machines do not see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found[7:], True)
    return found


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/palimpsest/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: By path of a stashed table, a weak reference to what all plans that read it share.
_stashed: dict[str, object] = {}


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files stay for as long as any DataFrame reads them, and until a ``release`` after that (of
    the last plans, Spark lets go within a second)."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    # The driver keeps the text of the last thousand plans, and makes it anew at each adaptive step.
    with settings_of(spark, {"spark.sql.maxPlanStringLength": "4096"}):
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    with contextlib.suppress(Py4JError):  # another reader of Parquet than Spark's first: the files stay
        index = out._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
        _stashed[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(index)
    return out


@contextlib.contextmanager
def settings_of(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for the actions inside."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrow_rows(spark: SparkSession, n: int):
    """Rows in an Arrow batch of the actions inside, at most; texts of some kB make large batches."""
    return settings_of(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(n)})


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Remove the files of a stashed table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def _trim(spark: SparkSession) -> None:
    """Return freed native memory of the driver's JVM to the system, where it can.

    Compilers of plans and generated code leave it in pools of the C library, one for each thread,
    which keep it.  The command is that of ``jcmd``; py4j reaches it only by the public interface."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    name_of = jvm.java.lang.Class.forName
    types = array(jvm.java.lang.Class, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[i] = name_of(name)
    args = array(jvm.java.lang.Object, 4)  # the last two, parameters and their types, stay null
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with contextlib.suppress(Py4JError):  # another JVM or C library
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        name_of("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, args)


def release(spark: SparkSession) -> None:
    """Let the shuffle files and stashed tables of queries that nothing refers to any more be removed:
    Spark does so with shuffle files when the driver's collector finds them, which may be long after
    they were read.  The driver's free memory goes back to the system."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim(spark)
    for path, index in list(_stashed.items()):
        try:
            held = index.get() is not None
        except Py4JError:  # of a session that has ended, whose files went with it
            del _stashed[path]
            continue
        if not held:
            _delete(spark, path)
            del _stashed[path]


def give_back() -> None:
    """Return freed memory of a Python worker to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, text string)``, one row per document (see the module's rules)."""
    out = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    twice = out.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return out
    once = out.join(twice, "doc_id", "left_anti")
    again = out.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    return once.unionByName(again)


#: Bits of a filter for each id, bits of one of its blocks (those of ``bitmap_construct_agg``), and
#: the most blocks: beyond them (16 MB) a filter lets more rows through, and no fewer.
_ID_BITS, _BLOCK_BITS, _MOST_BLOCKS = 16, 1 << 15, 1 << 12
_PLACE, _BLOCK, _MAP = "__filter_place", "__filter_block", "__filter_map"


def split(docs: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` (a long) is surely none of ``ids`` (one column of longs), and the rest.

    No row is moved: a bit for each hash of an id is broadcast.  What is joined with ids then
    is the rest only, so that texts are shuffled by how many ids there are, not by all rows.
    """
    (name,) = ids.columns
    blocks = min(max(1, ids.count() * _ID_BITS // _BLOCK_BITS), _MOST_BLOCKS)

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("long")), F.lit(blocks * _BLOCK_BITS))

    block = F.floor(F.col(_PLACE) / _BLOCK_BITS)
    maps = ids.select(place(F.col(name)).alias(_PLACE)).select(block.alias(_BLOCK), (F.col(_PLACE) % _BLOCK_BITS).alias(_PLACE))
    maps = maps.repartition(_BLOCK).groupBy(_BLOCK).agg(F.bitmap_construct_agg(_PLACE).alias(_MAP))
    marked = docs.withColumn(_PLACE, place(key)).join(F.broadcast(maps), block == F.col(_BLOCK), "left")
    byte = f"conv(hex(substring({_MAP}, int({_PLACE} % {_BLOCK_BITS} div 8) + 1, 1)), 16, 10)"
    bit = F.expr(f"coalesce(shiftright(int({byte}), int({_PLACE} % 8)) & 1, 0)")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(bit == 0).select(columns), marked.where(bit == 1).select(columns)


def within(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``key`` is one of ``ids``, which are read several times."""
    (name,) = ids.columns
    ids = ids.withColumnRenamed(name, _PLACE)
    return split(docs, F.col(key), ids)[1].join(ids, F.col(key).cast("long") == F.col(_PLACE), "left_semi")


def without(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``key`` is none of ``ids``, which are read several times, or null."""
    (name,) = ids.columns
    ids = ids.withColumnRenamed(name, _PLACE)
    out, rest = split(docs, F.col(key), ids)
    return out.union(rest.join(ids, F.col(key).cast("long") == F.col(_PLACE), "left_anti"))


#: Tasks over which the links of one node are dealt.
HUB_SALTS = 8


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``, root the least node.

    Alternates large-star and small-star steps until nothing changes.  The minimum of a node is
    partially aggregated, and links meet it dealt over ``HUB_SALTS`` tasks, so a node with very
    many links is not gathered in one.  Nodes without a link to another node are not returned.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(HUB_SALTS - 1))).alias("salt")

    def meet(links: DataFrame, least: DataFrame) -> DataFrame:
        dealt = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(HUB_SALTS)).cast("int"))
        return dealt.join(least.select("u", "m", salts), ["u", "salt"]).select("u", "v", "m")

    e = stash(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    mark = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = meet(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = meet(large, least)
        e = stash(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            "links",
        )
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
