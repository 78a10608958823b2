"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

#: A run of anything but ASCII white space, as Java's and DuckDB's regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting by which a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and lost executors lose none of it. What was shuffled for it goes from the disks at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a written() table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def settled(name: str):
    """Decorates a function that returns a DataFrame: the result is written(), and the tables that were written on the way to it are deleted."""

    def decorate(make):
        @wraps(make)
        def run(*args, **options):
            outer, made = _made.get(), []
            token = _made.set(made)
            try:
                df = make(*args, **options)
                inner = list(made)
                result = written(df, name)
            finally:
                _made.reset(token)
            if outer is not None:
                outer += [p for p in made if p not in inner]
            for path in inner:
                _delete(df.sparkSession, path)
            return result

        return run

    return decorate


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    name = f"__{name}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def block_pairs(rows: DataFrame, size: int, *columns: str) -> DataFrame:
    """Each two rows of rows (key and columns; n, how many share the key, is counted unless it is there) that share a key meet in one row of this: the key and a pair of blocks, about size rows of the key each, as lists (a block with itself too).

    The lists of the one block have a before their columns' names, those of the other b; arrays are strung together. So pairs can be checked many at a time, in tasks of their own, and only those that pass need become rows.
    """
    number = F.pmod(F.xxhash64(*columns[:2]), F.ceil(F.col("n") / size))
    sized = rows if "n" in rows.columns else rows.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key")
    # By key and block, so that the blocks of one key are gathered in many tasks.
    dealt = sized.select("key", "n", number.alias("block"), *columns).repartition("key", "block")
    kinds = dict(rows.dtypes)
    lists = [F.flatten(F.collect_list(c)) if kinds[c].startswith("array") else F.collect_list(c) for c in columns]
    blocks = written(dealt.groupBy("key", "block").agg(F.first("n").alias("n"), *[x.alias(c) for x, c in zip(lists, columns, strict=True)]), "blocks")
    one = blocks.select("key", F.explode(F.sequence("block", F.ceil(F.col("n") / size) - 1)).alias("block"), *[F.col(c).alias(f"a{c}") for c in columns])
    return one.join(blocks.select("key", "block", *[F.col(c).alias(f"b{c}") for c in columns]), ["key", "block"]).drop("block")


def words_of(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Recent(dict):
    """Values of make by key, computed once while a key stays in use: full, it becomes the older of two generations, from which keys come back when asked for.

    Keys of over 64 characters are not kept. map(recent.__getitem__, keys) runs without Python code for keys that are there.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self.put(key, found)
        return found

    def put(self, key, found) -> None:
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found


#: A node is a hub if it has over LEAST_HUB edges, fewer than one task minds, and over one part in MOST_HUBS of all: so hubs are at most twice that number.
LEAST_HUB = 1_000_000
MOST_HUBS = 10_000


def _with_least(edges: DataFrame, least: DataFrame, most: int | None) -> DataFrame:
    """edges (u, v) with m, the least of u: rows of least (u, m, n) of over most edges are few and broadcast. None: there is no such row."""
    if most is None:
        return edges.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", F.col("m").alias("hub")))
    told = edges.join(hubs, "u", "left")
    calm = told.where("hub is null").select("u", "v").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return told.where("hub is not null").select("u", "v", F.col("hub").alias("m")).union(calm)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is its smallest reachable node.

    Alternating large-star and small-star steps: each joins a node to the least node it knows of, so the
    edge count never grows, and the number of rounds is logarithmic in the longest chain. Every step is an
    aggregation of minima (combined before the shuffle) and a join with them; each round is written to the
    shared folder. The minima of hubs (see MOST_HUBS) are broadcast, so a hub's edges stay where they are. Nulls and self-loops contribute nothing but their node.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null").distinct()
    e = written(e, "cc")
    count = e.count()
    last, most = None, max(LEAST_HUB, count // MOST_HUBS) if count > LEAST_HUB else None
    for _ in range(max_rounds):
        # Large star: every neighbour larger than u moves to the least neighbour of u.
        both = e.where("u != v").select("u", "v").union(e.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.where("v > u"), low, most).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours move to the least of them.
        large = large.union(e.where("u = v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, most).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = written(small.distinct(), "cc")
        sums = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_scratch(e)
        e = new
        if sums == last:
            break
        last = sums
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
