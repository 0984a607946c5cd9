"""What the operators share: tables in the shared folder and connected components."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a Python worker holds at once while a table is stored.
BATCH_ROWS = 1000

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or on a single machine the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return at if "://" in at or at.startswith("file:") else f"file://{at}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; removed when the driver ends."""
    if not _made:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/versewright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def discard(path: str) -> None:
    """Remove what was written at a path of new_path()."""
    spark = _made.pop(path, None)
    if spark is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have gone; what is left is in a folder of its own
        pass


def _clean() -> None:
    for path in list(_made):
        discard(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again.

    This cuts the lineage: what an executor held can be lost without work being done again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))  # whole texts: fewer of them at once
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def drop_stored(*tables: DataFrame) -> None:
    """Remove tables of stored() that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_stored_at", None):
            discard(path)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges(a long, b long): (id, root), root the smallest id.

    Star contraction: every round hangs each node's larger neighbours on its smallest one, then each
    node's smaller neighbours on their smallest. Only minima are gathered, never neighbour lists, so a
    hub with any number of links costs one partial aggregate; the joins that carry the minima back read
    stored tables, so that adaptive execution can split a hub's rows over tasks. Null ends and loops are
    left out; an edge table without rows gives no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = stored(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = now.select("a", "b").unionAll(now.select(b.alias("a"), a.alias("b")))
        low = stored(both.groupBy("a").agg(F.least(a, F.min("b")).alias("m")), "low")
        large = stored(now.select(b.alias("u"), a.alias("v")).join(low.select(a.alias("u"), "m"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                       .unionAll(now.select(b.alias("u")).distinct().join(low.select(a.alias("u"), "m"), "u").where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop_stored(now, low, large, least)
        now = after
    else:
        raise RuntimeError("components: no fixed point")
    return now.select(a.alias("id"), b.alias("root")).unionAll(now.select(b.alias("id"), b.alias("root"))).distinct()


#: Ids of so many rows (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

#: Rounds in which the members of a bucket are held against one of them, before all that is left is.
LEADERS = 3

#: Members of a bucket that one task holds against as many others.
BLOCK = 1000


def small(ids: DataFrame) -> DataFrame:
    """A stored table, marked for a broadcast if it has no more than BROADCAST_IDS rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def linked(buckets: DataFrame, nodes: DataFrame, holds, apart, marks: DataFrame | None = None, far=None) -> DataFrame:
    """Classes of what verified pairs link: (id, root) for each id that has a link, root the smallest id.

    buckets(bucket long, id long, size int, bits long): who met whom, distinct. nodes(id, x): what holds(x, y), a
    boolean UDF, compares. apart(size, bits, size, bits) is a column that is true where two ids surely don't hold;
    it only saves work, and so does far(mark, size, mark, size), over marks(id, mark), which may be larger: only members
    of buckets with two classes or more get theirs.

    First come rounds of leaders: every member of a bucket is held against the bucket's leader, the member with the
    most company (the sum of its buckets' sizes, then the smallest id): the original among its copies, as a rule.
    Members that don't hold go on to the next leader. Such a round has no more pairs than members, whatever the size of
    a bucket, and LEADERS rounds bring most copies into classes. Then every pair of a bucket that isn't of one class yet
    and wasn't held is, so that no pair that met and holds is left out: the classes are those of all pairs that met. Only
    pairs between classes that are neither apart nor far are made, each once, in the first bucket that both are in; a
    bucket is dealt out in blocks of BLOCK members against BLOCK. No member is dropped, no bucket capped.
    """
    per = stored(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    met = stored(buckets.join(per, "bucket"), "met")
    weight = stored(met.groupBy("id").agg(F.sum("n").alias("weight")), "weights")
    some = stored(nodes.join(small(weight.select("id")), "id", "left_semi").dropDuplicates(["id"]), "nodes")
    open_ = stored(met.drop("n").join(weight, "id"), "open")
    drop_stored(per, weight)

    def verified(pairs: DataFrame) -> DataFrame:
        two = pairs.join(some.select(F.col("id").alias("b"), F.col("x").alias("y")), "b").join(some.select(F.col("id").alias("a"), "x"), "a")
        return stored(two.where(holds("x", "y")).select("a", "b"), "links")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    none = buckets.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    links = held = None
    for _ in range(LEADERS):
        lead = open_.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("neg"), "size", "bits")).alias("l"), F.count("*").alias("n")).where("n > 1")
        lead = stored(lead.select("bucket", (-F.col("l.neg")).alias("lead"), F.col("l.size").alias("lead_size"), F.col("l.bits").alias("lead_bits")), "leads")
        rest = stored(open_.join(lead, "bucket").where("id <> lead"), "rest")
        drop_stored(open_, lead)
        if rest.isEmpty():
            break
        pairs = rest.where(~apart(F.col("size"), F.col("bits"), F.col("lead_size"), F.col("lead_bits"))).select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
        pairs = stored(pairs, "pairs")
        new = verified(pairs)
        links, held = (new, pairs) if links is None else (links.unionByName(new), held.unionByName(pairs))
        left = rest.join(new.select(F.col("a").alias("id"), F.col("b").alias("lead")), ["id", "lead"], "left_anti")
        open_ = stored(left.select("bucket", "id", "size", "bits", "weight"), "open")
        drop_stored(rest)
    if links is None:
        return stored(components(none), "classes")
    root = stored(components(links), "classes")
    across = _across(met, root, apart, marks, far)
    more = verified(stored(across.join(ordered(held), ["a", "b"], "left_anti"), "pairs"))
    if more.isEmpty():
        return root
    # the classes that the new links join; roots are members, so links between roots are enough
    of = lambda c: root.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    joins = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    joined = stored(components(joins).withColumnRenamed("root", "low"), "joined").select(F.col("id").alias("root"), "low")
    known = root.join(joined, "root", "left").select("id", F.coalesce("low", "root").alias("root"))
    single = joined.join(root.select(F.col("id").alias("root")), "root", "left_anti").select(F.col("root").alias("id"), F.col("low").alias("root"))
    return stored(known.unionByName(single), "classes")


def _across(met: DataFrame, root: DataFrame, apart, marks: DataFrame | None = None, far=None) -> DataFrame:
    """(a, b), a < b, each once: the pairs of a bucket whose members are of two classes and not surely apart or far.

    The members outside a bucket's largest class are held against each other and against that class, whose own members
    never meet: copies by the thousand cost as many pairs as there are members that aren't copies.
    """
    of = stored(met.join(root, "id", "left").withColumn("root", F.coalesce("root", "id")), "members")
    top = of.groupBy("bucket", "root").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("l"), F.count("*").alias("classes")).where("classes > 1")
    of = stored(of.join(stored(top.select("bucket", F.col("l.root").alias("top"), F.col("l.k").alias("most")), "tops"), "bucket"), "mixed")
    whose = stored(of.groupBy("id").agg(F.collect_list("bucket").alias("all")), "whose")
    if marks is not None:
        whose = stored(whose.join(marks.join(small(whose.select("id")), "id", "left_semi").dropDuplicates(["id"]), "id"), "whose")
    of = of.join(whose, "id").withColumn("rest", F.col("root") != F.col("top"))
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    of = of.withColumn("tops", parts(F.col("most"))).withColumn("rests", parts(F.col("n") - F.col("most")))
    of = stored(of.withColumn("part", F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("tops"))).cast("int")), "mixed-members")
    rest, first = of.where("rest"), of.where("not rest")

    def dealt(side: DataFrame, name: str, i: Column, j: Column) -> DataFrame:
        one = lambda c, as_: F.explode(c).alias(as_) if c is not part else c.alias(as_)
        return side.select("bucket", one(i, "i"), one(j, "j"), *[F.col(c).alias(f"{name}_{c}") for c in ("id", "root", "size", "bits", "all", *(("mark",) if marks is not None else ()))])

    def held(two: DataFrame) -> DataFrame:
        two = two.where(~apart(F.col("x_size"), F.col("x_bits"), F.col("y_size"), F.col("y_bits")))
        if marks is not None:
            two = two.where(~far(F.col("x_mark"), F.col("x_size"), F.col("y_mark"), F.col("y_size")))
        two = two.where(F.array_min(F.array_intersect("x_all", "y_all")) == F.col("bucket"))
        return two.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))

    part, upto = F.col("part"), lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    among = dealt(rest, "x", part, F.sequence(part, F.col("rests") - 1)).join(dealt(rest, "y", F.sequence(F.lit(0), part), part), ["bucket", "i", "j"])
    among = among.where((F.col("x_root") != F.col("y_root")) & ((F.col("i") < F.col("j")) | (F.col("x_id") < F.col("y_id"))))
    against = dealt(rest, "x", part, upto("tops")).join(dealt(first, "y", upto("rests"), part), ["bucket", "i", "j"])
    return held(among).unionByName(held(against))
