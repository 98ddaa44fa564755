"""Graph questions answered by frontier loops over an edge table.

A level joins the frontier with the edges and drops what was seen. Each level's result is
checkpointed in the folder that the cluster shares. A caller that knows its graph to be
small can have it walked on the driver instead (``small``: at most so many edges, counted
first), with the same result: a level of a loop costs a job or two, and a small graph is
over in milliseconds there.
"""

from __future__ import annotations

import uuid
from collections import defaultdict, deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: For callers that answer one question of one project at a time.
SMALL = 300_000


def checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or own_folder(df.sparkSession))
    return df.checkpoint(True)


def dealt(df: DataFrame) -> DataFrame:
    """As :func:`checkpointed`, by a plan that is fixed beforehand: of an adaptive one Spark forgets how its rows are dealt out and sorted, and would shuffle them again for every join."""
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key, "true")
    conf.set(key, "false")
    try:
        return checkpointed(df)
    finally:
        conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder that the cluster shares: for wide results that several steps read a few columns of."""
    spark, schema = df.sparkSession, df.schema
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or own_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def own_folder(spark: SparkSession) -> str:
    """Where no folder is named: beside the warehouse, which a cluster shares; on one machine its temporary folder."""
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return "file:///tmp/checkpoints/callweave"
    if not spark.sparkContext.getConf().contains("spark.sql.warehouse.dir"):
        raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def _small(edges: DataFrame, limit: int) -> list | None:
    """The edges, if there are at most ``limit``."""
    found = edges.select("source_id", "target_id").limit(limit + 1).toArrow()
    return None if found.num_rows > limit else list(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, reverse: bool = False, small: int = 0) -> DataFrame:
    """(node_id, dist): the least number of edges from any start (column ``node_id``), within ``max_depth``."""
    if reverse:
        edges = edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    # dealt out and sorted by source once: no level shuffles the edges again
    by_source = edges.select("source_id", "target_id").repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_id")
    edges = dealt(by_source.distinct().sortWithinPartitions("source_id"))
    if small and (pairs := _small(edges, small)) is not None:
        out = defaultdict(list)
        for a, b in pairs:
            out[a].append(b)
        starts = starts.select("node_id").distinct()
        first, alone = starts.limit(small + 1).toArrow().column(0).to_pylist(), None
        if len(first) > small:  # more starts than edges: only linked ones go to the driver
            ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id"))
            alone, first = starts.join(ends, "node_id", "left_anti"), [r[0] for r in starts.join(ends, "node_id", "left_semi").collect()]
        dist = dict.fromkeys(first, 0)
        queue = deque(dist)
        while queue:
            n = queue.popleft()
            if max_depth is None or dist[n] < max_depth:
                for m in out[n]:
                    if m not in dist:
                        dist[m] = dist[n] + 1
                        queue.append(m)
        found = edges.sparkSession.createDataFrame(list(dist.items()), "node_id string, dist long")
        return found if alone is None else found.unionAll(alone.select("node_id", F.lit(0).cast("long")))
    seen = checkpointed(starts.select("node_id").distinct().withColumn("dist", F.lit(0).cast("long")))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, F.col("node_id") == F.col("source_id")).select(F.col("target_id").alias("node_id")).distinct()
        frontier = checkpointed(step.join(seen, "node_id", "left_anti").withColumn("dist", F.lit(depth).cast("long")))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.unionAll(frontier)) if depth % 4 == 0 else seen.unionAll(frontier)
    return seen


def bfs_by_name(callers: DataFrame, names: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """As :func:`bfs` against the calls, where ``callers`` (source_id, callee_name) call every node of the name in ``names`` (name, node_id).

    A name is a node of its own between its callers and its definitions, so a caller is no
    row for each namesake of what it calls.
    """
    hub = lambda c: F.concat(F.lit("\0"), c)
    links = callers.select("source_id", hub("callee_name").alias("target_id")).distinct().unionAll(names.select(hub("name").alias("source_id"), F.col("node_id").alias("target_id")))
    found = bfs(links, starts, None if max_depth is None else 2 * max_depth, reverse=True)
    return found.where(~F.col("node_id").startswith("\0")).select("node_id", F.expr("dist DIV 2").alias("dist"))


def blast_radius(edges: DataFrame, modified: DataFrame, small: int = 0) -> DataFrame:
    """(node_id, dist): everything that reaches a modified node along edges, with its least distance."""
    return bfs(edges, modified, reverse=True, small=small)


def external_dependents(radius: DataFrame, edges: DataFrame, entry: str | None = None) -> DataFrame:
    """Nodes of the radius that nothing calls, other than the entry."""
    free = radius.select("node_id").join(edges.select(F.col("target_id").alias("node_id")), "node_id", "left_anti")
    return free.where(F.col("node_id") != entry) if entry else free


def shortest_path(edges: DataFrame, source: str, target: str, small: int = 0) -> list[str]:
    """A shortest path along the edges, else against them (turned round); [] if neither exists. Ties go to the edge met first (smallest ``seq``, else ids)."""
    spark = edges.sparkSession
    for back in (False, True):
        a, b = (target, source) if back else (source, target)
        near = bfs(edges, spark.createDataFrame([(a,)], "node_id string"), small=small)
        row = near.where(F.col("node_id") == b).first()
        if row is None:
            continue
        # walk back: a parent of each node is a source one level nearer
        path, here = [b], b
        order = ["seq", "source_id"] if "seq" in edges.columns else ["source_id"]
        for d in range(row["dist"] - 1, -1, -1):
            up = edges.where(F.col("target_id") == here).join(near.where(F.col("dist") == d), F.col("source_id") == F.col("node_id"))
            here = up.orderBy(*order).first()["source_id"]
            path.append(here)
        return path if back else path[::-1]
    return []


def max_depth(edges: DataFrame, entry: str, without: list[str] = ()) -> int:
    """The largest distance from the entry, leaving out the nodes ``without``."""
    kept = edges.where(~F.col("source_id").isin(list(without)) & ~F.col("target_id").isin(list(without))) if without else edges
    return bfs(kept, edges.sparkSession.createDataFrame([(entry,)], "node_id string")).agg(F.max("dist")).first()[0]


def auto_collapsed(edges: DataFrame, entry: str, depth: int) -> DataFrame:
    """Nodes at ``depth`` or deeper that have an edge to another node."""
    near = bfs(edges, edges.sparkSession.createDataFrame([(entry,)], "node_id string"))
    return near.where(F.col("dist") >= depth).join(edges.where("source_id <> target_id").select(F.col("source_id").alias("node_id")), "node_id", "left_semi").select("node_id", "dist")


#: Bits of a bitmap of Spark's bitmap functions.
BITS = 32_768


def descendant_counts(edges: DataFrame, nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(node_id, descendants): nodes reachable by one edge or more; a node on a cycle counts itself.

    What the best linked node reaches is counted once for all that reach that node; only what
    lies outside is counted for each. What leads there lies in two parts of the graph: the
    edges that don't end in what it reaches, and those that start at nodes that don't reach it.
    A call graph has one large cycle, so both are small.
    """
    if depth is not None:
        return _descendant_bitmaps(edges, nodes, depth)
    edges = checkpointed(edges.select("source_id", "target_id").distinct())
    outs, ins = edges.groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("o")), edges.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("i"))
    top = outs.join(ins, "node_id").agg(F.max_by("node_id", F.struct(F.least("o", "i"), "node_id"))).first()[0]
    if top is None:  # no path of two edges
        return _descendant_bitmaps(edges, nodes)
    down = checkpointed(bfs(edges, edges.where(F.col("source_id") == top).select(F.col("target_id").alias("node_id"))).select("node_id"))
    up = checkpointed(bfs(edges, edges.where(F.col("target_id") == top).select(F.col("source_id").alias("node_id")).unionAll(nodes.sparkSession.createDataFrame([(top,)], "node_id string")), reverse=True).select("node_id"))
    apart = edges.join(up.select(F.col("node_id").alias("source_id")), "source_id", "left_anti")
    outside = edges.join(down.select(F.col("node_id").alias("target_id")), "target_id", "left_anti")
    nodes = nodes.select("node_id").distinct()
    whole = _descendant_bitmaps(outside, nodes.join(up, "node_id", "left_semi")).withColumn("descendants", F.col("descendants") + down.count())
    return whole.unionByName(_descendant_bitmaps(apart, nodes.join(up, "node_id", "left_anti")))


def _descendant_bitmaps(edges: DataFrame, nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """As :func:`descendant_counts`, for each node by itself.

    Targets are numbered in blocks of 32,768; what a node reaches in a block is one bitmap.
    A round sends the bitmaps that have grown back along the edges, where they are united
    before the shuffle, so no pair of origin and node is ever a row. Rounds: the longest of
    the shortest paths.
    """
    edges = checkpointed(edges.select("source_id", "target_id").distinct())
    ends = edges.select(F.col("target_id").alias("node_id")).distinct()
    blocks = -(-ends.count() // BITS)
    if not blocks:
        return nodes.select("node_id").distinct().withColumn("descendants", F.lit(0).cast("long"))
    # a partition is a block or a few; numbers hold once they are checkpointed
    numbered = checkpointed(ends.repartition(blocks, "node_id").select("node_id", (F.monotonically_increasing_id() + 1).alias("_i")))
    place = numbered.select(F.col("node_id").alias("target_id"), F.call_function("bitmap_bucket_number", "_i").alias("block"), F.call_function("bitmap_bit_position", "_i").alias("_bit"))
    first = edges.join(place, "target_id").groupBy(F.col("source_id").alias("node_id"), "block").agg(F.call_function("bitmap_construct_agg", "_bit").alias("bits"))
    size = lambda bits: F.call_function("bitmap_count", bits)
    seen = checkpointed(first.withColumn("n", size("bits")))
    grown, level = seen, 1
    while depth is None or level < depth:
        level += 1
        sent = edges.join(grown.select(F.col("node_id").alias("target_id"), "block", "bits"), "target_id").groupBy(F.col("source_id").alias("node_id"), "block").agg(F.call_function("bitmap_or_agg", "bits").alias("bits"))
        both = seen.select("node_id", "block", "bits", "n").unionByName(sent.withColumn("n", F.lit(0).cast("long")))
        seen = checkpointed(both.groupBy("node_id", "block").agg(F.call_function("bitmap_or_agg", "bits").alias("bits"), F.max("n").alias("was")).withColumn("n", size("bits")))
        grown = seen.where("n > was")
        seen = seen.drop("was")
        if grown.isEmpty():
            break
    counts = seen.groupBy(F.col("node_id").alias("_origin")).agg(F.sum("n").alias("descendants"))
    return nodes.select("node_id").distinct().join(counts, F.col("node_id") == F.col("_origin"), "left").select("node_id", F.coalesce("descendants", F.lit(0)).alias("descendants"))


def visible_nodes(edges: DataFrame, entry: str, collapsed: DataFrame) -> DataFrame:
    """Nodes reached from the entry without passing through a collapsed node."""
    open_ = edges.join(collapsed.select(F.col("node_id").alias("source_id")), "source_id", "left_anti")
    return bfs(open_, edges.sparkSession.createDataFrame([(entry,)], "node_id string")).select("node_id")


def ancestor_chains(edges: DataFrame) -> DataFrame:
    """(node_id, chain): for every node that has one, its parent, the parent's parent and so on up to a root, or until a node would repeat.

    A parent is the source of the last-written edge (largest ``seq``). Chains double: each
    is joined with the chain of its last node, so the longest takes a logarithm of its
    length in rounds. A self loop is no parent of its own.
    """
    parents = edges.groupBy("target_id").agg(F.max_by("source_id", "seq").alias("parent")).where("parent <> target_id")
    chains = checkpointed(parents.select(F.col("target_id").alias("node_id"), F.array("parent").alias("chain"), F.lit(False).alias("whole")))
    keep = lambda a, x: F.when(a["stop"] | F.array_contains(a["seen"], x), F.struct(a["seen"].alias("seen"), F.lit(True).alias("stop"))).otherwise(F.struct(F.array_append(a["seen"], x).alias("seen"), F.lit(False).alias("stop")))
    while not chains.where("NOT whole").isEmpty():
        far = chains.select(F.col("node_id").alias("last"), F.col("chain").alias("more"), F.col("whole").alias("more_whole"))
        open_ = chains.where("NOT whole").withColumn("last", F.element_at("chain", -1)).join(far, "last", "left")
        both = F.concat(F.array("node_id"), "chain", F.coalesce("more", F.array().cast("array<string>")))
        joined = open_.select("node_id", both.alias("all"), F.coalesce("more_whole", F.lit(True)).alias("whole"))
        repeats = F.size(F.array_distinct("all")) < F.size("all")
        first = F.aggregate("all", F.struct(F.array().cast("array<string>").alias("seen"), F.lit(False).alias("stop")), keep)["seen"]
        cut = F.when(repeats, first).otherwise(F.col("all"))
        chains = checkpointed(joined.select("node_id", F.slice(cut, F.lit(2), F.size(cut)).alias("chain"), (F.col("whole") | repeats).alias("whole")).unionByName(chains.where("whole")))
    return chains.select("node_id", "chain")


def ancestors(edges: DataFrame, node: str) -> list[str]:
    """The chain of one node; [] if it has no parent."""
    row = ancestor_chains(edges).where(F.col("node_id") == node).first()
    return row["chain"] if row else []


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(direction, node_id): one-hop callers and callees."""
    into = edges.where(F.col("target_id") == node).select(F.lit("caller").alias("direction"), F.col("source_id").alias("node_id"))
    out = edges.where(F.col("source_id") == node).select(F.lit("callee").alias("direction"), F.col("target_id").alias("node_id"))
    return into.unionAll(out).distinct()


def union_nodes(down_nodes: DataFrame, up_nodes: DataFrame) -> DataFrame:
    return down_nodes.unionByName(up_nodes.join(down_nodes.select("node_id"), "node_id", "left_anti"))


def union_graphs(down_nodes: DataFrame, up_nodes: DataFrame, down_edges: DataFrame, up_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes distinct by id (the downstream side's row wins), edges distinct by source, target and kind."""
    return union_nodes(down_nodes, up_nodes), down_edges.unionByName(up_edges).dropDuplicates(["source_id", "target_id", "kind"])


def prune_conditionals(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop conditionals without out-edges or with unresolved targets only, again and again until none is left."""
    nodes, edges = checkpointed(nodes), checkpointed(edges)
    while True:
        live = edges.join(nodes.where("kind <> 'unresolved'").select(F.col("node_id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("node_id"))
        dead = checkpointed(nodes.where("kind = 'conditional'").select("node_id").join(live, "node_id", "left_anti"))
        if dead.isEmpty():
            return nodes, edges
        nodes = checkpointed(nodes.join(dead, "node_id", "left_anti"))
        edges = checkpointed(edges.join(dead.select(F.col("node_id").alias("source_id")), "source_id", "left_anti").join(dead.select(F.col("node_id").alias("target_id")), "target_id", "left_anti"))


def drop_unresolved(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = nodes.where("kind = 'unresolved'").select("node_id")
    kept = edges.join(gone.select(F.col("node_id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("node_id").alias("target_id")), "target_id", "left_anti")
    return nodes.where("kind <> 'unresolved'"), kept


def condition_closure(spark: SparkSession, direct: DataFrame, callers: DataFrame, depth: int = 10, small: int = 0) -> DataFrame:
    """(node_id, dist): transitive callers of the direct matches, which are left out, within ``depth``."""
    return bfs(callers, direct, depth, reverse=True, small=small).where("dist > 0")
