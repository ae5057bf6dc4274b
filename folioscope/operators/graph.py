"""Connected components of link tables, and the folder in which lineage is cut."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def kept(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back, for tables that are used more than once."""
    # a finished job's shuffle files go at once; what later jobs need is written
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _by_scope(df: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """All rows of a scope in one partition, so that what is told within scopes needs no other shuffle."""
    return df.repartition(*scope) if scope else df


def _with_least(df: DataFrame, scope: tuple[str, ...], key: str, value: str) -> DataFrame:
    """m: the least value of the row's key. Within scopes it is told where the rows lie; without, keys may be hubs, whose rows a join splits."""
    if scope:
        return df.withColumn("m", F.min(value).over(Window.partitionBy(*scope, key)))
    return df.hint("merge").join(df.groupBy(key).agg(F.min(value).alias("m")), key)


def components(links: DataFrame, *scope: str) -> DataFrame:
    """(scope, id, component): every id of the links (scope, a, b) with the smallest id reachable; ids without links are left out.

    scope: columns within whose values ids are told apart; links never leave them. Ids that are numbers are counted by hash, structs would be sorted.
    Alternating large-star and small-star contraction: every round points each node at the least node in its neighbourhood. Minima are
    aggregated before the shuffle, and a hub is split by Spark's skewed joins.
    """
    both_ways = lambda x, y: F.explode(F.array(F.struct(F.col(x[0]).alias("a"), F.col(x[1]).alias("b")), F.struct(F.col(y[0]).alias("a"), F.col(y[1]).alias("b")))).alias("l")
    link = _by_scope(links.select(*scope, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"), scope).distinct()
    shared_dir(links.sparkSession)
    before = None
    while True:
        both = _by_scope(link, scope).select(*scope, both_ways("ab", "ba")).select(*scope, "l.*")
        large = _with_least(both, scope, "a", "b").filter("b > a").select(*scope, F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct()
        link = _with_least(large, scope, "a", "b").select(*scope, both_ways("bm", "am")).select(*scope, "l.*").filter("a <> b").distinct().checkpoint()
        now = link.agg(F.count("*"), F.sum(F.xxhash64(*scope, "a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return link.select(*scope, F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        link.select(*scope, F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def components_of(members: DataFrame, keys: DataFrame, *scope: str) -> DataFrame:
    """(scope, id, component) of all members (scope, id), linked where they share a key (scope, id, key).

    A key links its members to its least one, so a key of n members makes n - 1 links, never pairs.
    """
    links = _with_least(_by_scope(keys, scope), scope, "key", "id").filter("id <> m").select(*scope, F.col("id").alias("a"), F.col("m").alias("b"))
    found = components(links, *scope)
    return members.select(*scope, "id").join(found.hint("merge"), [*scope, "id"], "left").select(*scope, "id", F.coalesce("component", "id").alias("component"))


def first_independent(edges: DataFrame) -> DataFrame:
    """(id, first): whether an id is in the first independent set of the distinct edges (a, b), a < b: one that no smaller id of the set is linked to.

    In each round the ids all of whose smaller neighbours are decided become members, and their greater neighbours don't. An id with one
    undecided smaller neighbour is what that one is not, so such chains are shortened by doubling: a chain of n ids takes log2(n) steps, not n
    rounds. Rounds go on until nothing is undecided; what is decided is written once per round.
    """
    every = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    decided, left = every.withColumn("first", F.lit(True)).limit(0), edges.select("a", "b")
    while True:
        left = kept(left)
        if left.isEmpty():  # who is left without links and was not taken is a member
            return every.join(decided.hint("merge"), "id", "left").select("id", F.coalesce("first", F.lit(True)).alias("first"))
        ids = left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id"))).distinct()
        below = left.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n"), F.min("a").alias("to"))
        known = kept(ids.join(below.hint("merge"), "id", "left").na.fill(0, ["n"]))
        # odd: whether an id is the opposite of what it points to
        chain = known.filter("n = 1").select("id", "to", F.lit(True).alias("odd"))
        while True:
            chain = kept(chain)
            ahead = chain.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("odd").alias("odd_beyond"))
            if chain.hint("merge").join(ahead, "to", "left_semi").isEmpty():
                break
            step = chain.hint("merge").join(ahead, "to", "left")
            chain = step.select("id", F.coalesce("beyond", "to").alias("to"), (F.col("odd") != F.coalesce("odd_beyond", F.lit(False))).alias("odd"))
        roots = known.filter("n = 0").select("id")
        settled = chain.hint("merge").join(roots.withColumnRenamed("id", "to"), "to").select("id", (~F.col("odd")).alias("first"))
        members = roots.unionByName(settled.filter("first").select("id"))
        met = left.hint("merge").join(members.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"))
        now = kept(members.withColumn("first", F.lit(True)).unionByName(met.distinct().withColumn("first", F.lit(False))).unionByName(settled.filter("not first")).groupBy("id").agg(F.max("first").alias("first")))
        decided = decided.unionByName(now)
        gone = now.select("id")
        left = left.hint("merge").join(gone.withColumnRenamed("id", "a"), "a", "left_anti").hint("merge").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
