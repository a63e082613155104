"""Traversal of the table and column lineage graph.

One distributed join per hop serves every root. Each hop is written to the shared
folder before the next one starts, so plans stay short and a lost executor costs one
hop. A hop's rows are counted while it is written, which ends the loop; its bytes are
known to Catalyst, which picks the join. No hop reads all earlier ones (see ``Walk``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from driftlens.session import scratch_dir

DIRECTIONS = ("UPSTREAM", "DOWNSTREAM")


def _ends(direction: str) -> tuple[str, str]:
    """(column to expand from, column to reach) for a direction."""
    direction = direction.upper()
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    return ("target", "source") if direction == "UPSTREAM" else ("source", "target")


def _store(df: DataFrame, path: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """Write one hop and return it with the metrics observed on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()]).write.mode(
        "overwrite"
    ).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def roots_of(spark: SparkSession, edges: DataFrame, *urns) -> DataFrame:
    """Start nodes typed like the graph's own ids."""
    kind = edges.schema["source"].dataType
    return spark.range(1).select(F.explode(F.array(*[F.lit(u).cast(kind) for u in urns])).alias("urn"))


def _neighbours(edges: DataFrame, frontier: DataFrame, direction: str) -> DataFrame:
    near, far = _ends(direction)
    pairs = edges.select(F.col(near).alias("urn"), F.col(far).alias("_far"))
    return pairs.join(frontier.select("root", "urn"), "urn").select("root", F.col("_far").alias("urn"))


def one_hop(edges: DataFrame, frontier: DataFrame, direction: str) -> DataFrame:
    """Distinct direct neighbours (root, urn) of a frontier (root, urn)."""
    return _neighbours(edges, frontier, direction).distinct()


class Walk:
    """Breadth-first layers (root, urn, hop) from ``roots``, one stored job per hop.

    A layer holds whatever the hop before leads to, and is dealt by hash buckets of (root,
    urn) and sorted by them. What earlier hops had reached is dropped when the layer is
    expanded: of the earlier ones, row groups without a bucket of the layer are skipped.
    Layers are plain folders of as many files as their size asks for, so a small hop is a
    task and a file, and none is listed by a job. They are merged in levels of FAN_IN, so
    hop ``k`` opens its layer and O(log k) runs of files.
    """

    FAN_IN = 8

    def __init__(self, edges: DataFrame, roots: DataFrame, direction: str, label: str = "reach"):
        self.edges, self.direction, self.spark = edges, direction, edges.sparkSession
        self.width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.base = scratch_dir(self.spark, label)
        self.hop, self.layers, self.runs, self.held = 0, [], [], {}
        start = roots.select(F.col("urn").alias("root"), "urn").distinct().withColumn("hop", F.lit(0))
        self.schema = StructType([*start.schema.fields, StructField("bucket", IntegerType())])
        self.rows = self._store(start, "hop-0")

    def _store(self, layer: DataFrame, name: str) -> int:
        dealt = layer.withColumn("bucket", F.pmod(F.xxhash64("root", "urn"), F.lit(self.width)).cast("int"))
        dealt = dealt.repartition("bucket").dropDuplicates(["bucket", "root", "urn"]).sortWithinPartitions("bucket")
        path, seen = f"{self.base}/{name}", Observation()
        metrics = F.count(F.lit(1)).alias("rows"), F.collect_set("bucket").alias("buckets")  # at most ``width`` numbers
        dealt.observe(seen, *metrics).write.parquet(path)
        self.layers.append(path)
        self.held[path] = set(seen.get["buckets"])
        return seen.get["rows"]

    def _read(self, paths: list[str], buckets: set[int] | None = None) -> DataFrame:
        out = self.spark.read.schema(self.schema).parquet(*paths)
        if buckets is not None and len(buckets) < self.width:
            out = out.filter(F.col("bucket").isin(sorted(buckets)))
        return out

    def layer(self, hop: int) -> DataFrame:
        """What hop ``hop`` led to; some of it may have been reached before."""
        return self._read([self.layers[hop]]).drop("bucket")

    def _buckets(self, path: str) -> set[int]:
        return self.held[path]

    def frontier(self) -> DataFrame:
        """The last layer without what earlier hops had reached."""
        last = self.layers[-1]
        fresh = self._read([last]).select("root", "urn", "hop")
        if self.runs:
            seen = self._read([path for _, path in self.runs], self._buckets(last)).select("root", "urn")
            fresh = fresh.join(seen, ["root", "urn"], "left_anti")
        return fresh

    def step(self) -> int:
        """Takes the next hop; the rows that it led to."""
        frontier = self.frontier()
        self.hop += 1
        reached = _neighbours(self.edges, frontier, self.direction).withColumn("hop", F.lit(self.hop))
        done = self.layers[-1]
        self.rows = self._store(reached, f"hop-{self.hop}")
        self._merge(done)
        return self.rows

    def _merge(self, path: str) -> None:
        self.runs.append((0, path))
        while len(self.runs) >= self.FAN_IN and len({level for level, _ in self.runs[-self.FAN_IN :]}) == 1:
            level, paths = self.runs[-1][0] + 1, [p for _, p in self.runs[-self.FAN_IN :]]
            self.runs[-self.FAN_IN :] = [(level, f"{self.base}/run-{self.hop}-{level}")]
            self._read(paths).repartition("bucket").sortWithinPartitions("bucket").write.parquet(self.runs[-1][1])

    def reached(self) -> DataFrame:
        """(root, urn, hop) of everything that a hop led to, with the least hop."""
        if self.hop == 0:
            return self._read(self.layers).drop("bucket").limit(0)
        return self._read(self.layers[1:]).groupBy("root", "urn").agg(F.min("hop").alias("hop"))


def reach(
    edges: DataFrame, roots: DataFrame, direction: str = "DOWNSTREAM", max_hops: int | None = None
) -> DataFrame:
    """(root, urn, hop): everything reached over at least one edge, with its least hop.

    A root appears in its own result only when a cycle leads back to it. Without
    ``max_hops`` the loop runs until a hop adds nothing.
    """
    _ends(direction)
    walk = Walk(edges, roots, direction)
    while walk.rows and (max_hops is None or walk.hop < max_hops):
        walk.step()
    return walk.reached()


def traverse(
    edges: DataFrame, roots: DataFrame, direction: str, max_hops: int | None = 3
) -> tuple[DataFrame, DataFrame]:
    """Nodes (root, urn, hop; the root itself at 0) and the edges walked over.

    An edge always reads upstream to downstream, whichever way it was walked.
    """
    near, _ = _ends(direction)
    reached = reach(edges, roots, direction, max_hops)
    start = roots.select(F.col("urn").alias("root"), "urn", F.lit(0).alias("hop"))
    nodes = start.unionByName(reached).groupBy("root", "urn").agg(F.min("hop").alias("hop"))
    expanded = nodes if max_hops is None else nodes.filter(F.col("hop") < max_hops)
    walked = (
        edges.select("source", "target")
        .join(expanded.select("root", F.col("urn").alias(near)), near)
        .select("root", "source", "target")
        .distinct()
    )
    return nodes, walked


def attach_columns(edges: DataFrame, column_lineage: DataFrame) -> DataFrame:
    """Column mappings per edge; an empty list where none is known.

    The list of one edge is as long as the two tables are wide, never as long as data.
    """
    maps = column_lineage.groupBy("source", "target").agg(
        F.array_sort(
            F.collect_set(F.struct(F.col("source_col").alias("upstream"), F.col("target_col").alias("downstream")))
        ).alias("columns")
    )
    empty = F.array().cast("array<struct<upstream:string,downstream:string>>")
    return edges.join(maps, ["source", "target"], "left").withColumn("columns", F.coalesce("columns", empty))


def column_key(asset: Column, column: Column) -> Column:
    """A column as a node: a struct, so any character may occur in either name."""
    return F.struct(asset.cast("string").alias("asset"), column.alias("column"))


def column_edges(column_lineage: DataFrame) -> DataFrame:
    """Column lineage as an edge list over (asset, column) nodes."""
    return column_lineage.select(
        column_key(F.col("source"), F.col("source_col")).alias("source"),
        column_key(F.col("target"), F.col("target_col")).alias("target"),
    )


def column_reach(
    column_lineage: DataFrame, asset, column: str, direction: str, max_hops: int | None = None
) -> DataFrame:
    """(urn, column, hop) reached from one column over column edges."""
    edges = column_edges(column_lineage)
    roots = edges.sparkSession.range(1).select(column_key(F.lit(asset), F.lit(column)).alias("urn"))
    return reach(edges, roots, direction, max_hops).select(
        F.col("urn.asset").alias("asset"), F.col("urn.column").alias("column"), "hop"
    ).withColumnRenamed("asset", "urn")


def blast_radius(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Everything downstream, without a hop limit."""
    return reach(edges, roots, "DOWNSTREAM")


def shortest_path(edges: DataFrame, start, goal) -> DataFrame:
    """One row (hops, path) of a shortest path, or no row; a node reaches itself in no hop.

    Among equally short paths the least one by node order wins, the first node first.

    The search walks from both ends, always on from the smaller layer, until two layers
    meet. The nodes before the meeting that lead to it are found by walking back. Then the
    path is read off node by node; only it, never a frontier, comes to the driver.
    """
    spark = edges.sparkSession
    ahead = Walk(edges, roots_of(spark, edges, start), "DOWNSTREAM", "path-ahead")
    back = Walk(edges, roots_of(spark, edges, goal), "UPSTREAM", "path-back")
    base = scratch_dir(spark, "path-useful")

    def meeting() -> DataFrame:
        return ahead.layer(ahead.hop).select("urn").join(back.layer(back.hop).select("urn"), "urn", "left_semi")

    path = []
    while ahead.rows and back.rows:
        useful, met = _store(meeting(), f"{base}/{ahead.hop}-{back.hop}")
        if met["rows"]:
            path = _least_path(edges, start, ahead, back, useful, base)
            break
        (ahead if ahead.rows <= back.rows else back).step()
    kind = edges.schema["source"].dataType.simpleString()
    nodes = F.array(*[F.lit(n) for n in path]).cast(f"array<{kind}>")
    return spark.range(int(bool(path))).select(F.lit(len(path) - 1).alias("hops"), nodes.alias("path"))


def _least_path(edges: DataFrame, start, ahead: Walk, back: Walk, useful: DataFrame, base: str) -> list:
    pairs = edges.select("source", "target")
    layers = [useful]
    for hop in range(ahead.hop - 1, 0, -1):
        leads = pairs.join(layers[0].withColumnRenamed("urn", "target"), "target", "left_semi")
        own = ahead.layer(hop).select("urn").join(leads.select(F.col("source").alias("urn")), "urn", "left_semi")
        layers.insert(0, _store(own, f"{base}/back-{hop}")[0])
    layers = layers if ahead.hop else []
    layers += [back.layer(hop).select("urn") for hop in range(back.hop - 1, -1, -1)]
    path = [start]
    for layer in layers:
        onward = pairs.filter(F.col("source") == F.lit(path[-1])).select(F.col("target").alias("urn"))
        path.append(onward.join(layer, "urn", "left_semi").agg(F.min("urn").alias("urn")).first()["urn"])
    return path


def merge_first_seen(sightings: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """One row per key: the earliest sighting wins, later ones change nothing."""
    rest = [c for c in sightings.columns if c not in keys]
    first = sightings.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(arrival, *rest)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


# Node states a confirmed cause may overwrite, and those a verified
# repair returns to healthy.
OPEN_STATES = ("healthy", "investigating", "suspicious")
CLEARED_STATES = ("affected", "suspicious", "investigating")


def propagate_status(nodes: DataFrame, edges: DataFrame, cause, verified: bool = False) -> DataFrame:
    """Node status after the cause is confirmed, or after its repair is verified."""
    closure = blast_radius(edges, roots_of(edges.sparkSession, edges, cause)).select(
        "urn", F.lit(True).alias("_down")
    )
    is_cause = F.col("urn") == F.lit(cause)
    down = F.coalesce(F.col("_down"), F.lit(False))
    if verified:
        status = F.when(down & F.col("_now").isin(*CLEARED_STATES), "healthy").when(is_cause, "repaired")
        now = F.when(is_cause, F.lit("root_cause")).otherwise(F.col("status"))
    else:
        status = F.when(is_cause, "root_cause").when(down & F.col("_now").isin(*OPEN_STATES), "affected")
        now = F.col("status")
    return (
        nodes.join(closure, "urn", "left")
        .withColumn("_now", now)
        .withColumn("status", status.otherwise(F.col("_now")))
        .drop("_down", "_now")
    )


# Node states counted as affected.
AFFECTED_STATES = ("suspicious", "affected", "root_cause")


def affected_count(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count_if(F.col("status").isin(*AFFECTED_STATES)).alias("affected"))
