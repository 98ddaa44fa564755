"""Community detection: local moving and label propagation.

Both are sequential: each move looks at the moves before it. They run on the driver over
an undirected edge list whose size is checked first. Larger graphs go to distributed forms
in which nodes move at once: ``move`` for local moving and ``propagate`` for labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, dealt, stored

SWEEPS, LABEL_SWEEPS = 20, 10
#: Edges the sequential forms take; larger graphs go to the distributed ones.
MOST_EDGES = 2_000_000
#: Clusters (two numbers each) up to which their weights are broadcast.
FEW_CLUSTERS = 500_000
#: Links, two numbers each, that a task of a sweep takes: with a session's number of tasks a sweep is mostly their start.
TASK_LINKS = 500_000


def louvain(nodes: list[str], edges: list[tuple[str, str, float]], resolution: float = 2.0) -> tuple[dict[str, int], float]:
    """Communities (numbered by first appearance) after one level of local moving, and the modularity over linked pairs.

    The gain's degree term counts ``resolution`` times. Ties go to the smallest community number.
    """
    at = {n: i for i, n in enumerate(nodes)}
    links: list[list[tuple[int, float]]] = [[] for _ in nodes]
    total = 0.0
    for s, t, w in edges:
        if s in at and t in at and s != t:
            links[at[s]].append((at[t], w))
            links[at[t]].append((at[s], w))
            total += w
    if total == 0 or len(nodes) < 2:
        return {n: i for i, n in enumerate(nodes)}, 0.0
    double = 2 * total
    degree = [sum(w for _, w in own) for own in links]
    home, weight = list(range(len(nodes))), list(degree)
    for _ in range(SWEEPS):
        moved = False
        for i, own in enumerate(links):
            toward: dict[int, float] = {}
            for j, w in own:
                toward[home[j]] = toward.get(home[j], 0.0) + w
            old = home[i]
            weight[old] -= degree[i]
            gain = lambda c, i=i, toward=toward: toward.get(c, 0.0) / double - resolution * weight[c] * degree[i] / double**2
            stay, best, most = gain(old), old, 0.0
            for c in sorted(toward):
                if gain(c) - stay > most:
                    most, best = gain(c) - stay, c
            weight[best] += degree[i]
            home[i] = best
            moved |= best != old
        if not moved:
            break
    number: dict[int, int] = {}
    found = {n: number.setdefault(home[i], len(number)) for i, n in enumerate(nodes)}
    q = sum(w - degree[i] * degree[j] / double for i, own in enumerate(links) for j, w in own if home[i] == home[j]) / double
    return found, q


def label_propagation(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, int]:
    """At most ten sweeps; a node takes its neighbours' commonest label, its own on a tie, else the one met first."""
    near: dict[str, dict[str, None]] = {n: {} for n in nodes}
    for s, t in edges:
        if s in near and t in near and s != t:
            near[s][t] = near[t][s] = None
    label = {n: i for i, n in enumerate(nodes)}
    for _ in range(LABEL_SWEEPS):
        changed = False
        for n in nodes:
            votes: dict[int, int] = {}
            for m in near[n]:
                votes[label[m]] = votes.get(label[m], 0) + 1
            if votes:
                top = max(votes.values())
                best = label[n] if votes.get(label[n]) == top else next(k for k, v in votes.items() if v == top)
                changed |= best != label[n]
                label[n] = best
        if not changed:
            break
    return label


def detect(nodes: DataFrame, pairs: DataFrame, method: str = "louvain", most: int = MOST_EDGES) -> DataFrame:
    """(node_id, cluster) over ``nodes`` (in order of ``seq``) and undirected ``pairs`` (a, b).

    Beyond ``most`` edges the distributed forms decide; their clusters are numbered by the
    place of their first node, as are those of the sequential ones for labels.
    """
    places, pairs = begins(nodes.select("node_id", "seq")), stored(pairs.select("a", "b"))
    if pairs.count() > most:
        label = move(nodes, pairs) if method == "louvain" else propagate(nodes, pairs)
        first = label.join(places, "node_id").groupBy("cluster").agg(F.min("place").alias("place"))
        return label.join(first, "cluster").select("node_id", F.col("place").alias("cluster"))
    found = pairs.toArrow()
    edges = sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
    # nodes without links never move, so only the others go to the driver
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node_id"))
    linked = {r["node_id"]: r["place"] for r in places.join(ends, "node_id", "left_semi").orderBy("place").collect()}
    ids = list(linked)
    if method == "louvain":
        label = louvain(ids, [(a, b, 1.0) for a, b in edges])[0]
        # numbers by first appearance among all nodes: a cluster's first node, and every node alone, count once
        first: dict[int, int] = {}
        for n in ids:
            first.setdefault(label[n], linked[n])
        label = {n: first[c] for n, c in label.items()}
    else:
        label = {n: linked[ids[c]] for n, c in label_propagation(ids, edges).items()}
    moved = nodes.sparkSession.createDataFrame(list(label.items()), "node_id string, cluster long")
    every = places.join(moved, "node_id", "left").select("node_id", F.coalesce("cluster", "place").alias("cluster"))
    if method != "louvain":
        return every
    numbers = begins(every.select(F.col("cluster").alias("node_id")).distinct().withColumn("seq", F.col("node_id")))
    return every.join(numbers.withColumnRenamed("node_id", "cluster"), "cluster").select("node_id", F.col("place").alias("cluster"))


def begins(rows: DataFrame) -> DataFrame:
    """(node_id, place): each node's number, from 0, by ``seq``: sorted in ranges, shifted by the rows of the ranges before."""
    ranged = checkpointed(rows.repartitionByRange("seq").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shifts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("seq")) - 1
    return checkpointed(ranged.withColumn("_own", own).join(F.broadcast(shifts), "_part").select("node_id", (F.col("_own") + F.col("_shift")).alias("place")))


def _numbered(nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(names, both, label, parts): linked nodes as numbers, in the order of their ids.

    ``names`` (node_id, place, turn), ``both`` (a, b, turn of a) with each pair both ways, and ``label`` (place, cluster,
    k: links, turn). Sweeps shuffle numbers alone, and what an end is told goes to it in one exchange, by its number.
    """
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-2 * pairs.count() // TASK_LINKS))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node_id")).distinct()
    names = checkpointed(begins(ends.withColumn("seq", F.col("node_id"))).withColumn("turn", F.pmod(F.xxhash64("node_id"), F.lit(2)).cast("int")))
    side = lambda c: names.select(F.col("node_id").alias(c), F.struct("place", "turn").alias(f"n{c}")).hint("shuffle_hash")
    way = lambda x, y: F.struct(F.col(f"{x}.place").alias("a"), F.col(f"{y}.place").alias("b"), F.col(f"{x}.turn").alias("turn"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").select(F.explode(F.array(way("na", "nb"), way("nb", "na"))).alias("l")).select("l.*")
    both = dealt(links.repartition(parts, "b").distinct())
    degree = both.groupBy("b").agg(F.count("*").cast("double").alias("k"))
    own = names.join(nodes.select("node_id").distinct(), "node_id", "left_semi")
    label = own.join(degree, F.col("place") == F.col("b")).select("place", F.col("place").alias("cluster"), "k", "turn").repartition(parts, "place")
    return names, both, stored(label), parts


def _named(nodes: DataFrame, names: DataFrame, label: DataFrame) -> DataFrame:
    """(node_id, cluster): a cluster by the id of its number; nodes without links are alone."""
    of = names.select("place", "node_id").join(label.select("place", "cluster"), "place")
    found = of.select("node_id", "cluster").join(names.select(F.col("place").alias("cluster"), F.col("node_id").alias("_name")), "cluster")
    return nodes.select("node_id").join(found.select("node_id", "_name"), "node_id", "left").select("node_id", F.coalesce("_name", "node_id").alias("cluster"))


def _heard(both: DataFrame, label: DataFrame) -> DataFrame:
    """(a, cluster): what each link tells its end ``a``."""
    return both.join(label.select(F.col("place").alias("b"), "cluster").hint("shuffle_hash"), "b").select("a", "cluster")


def _placed(label: DataFrame, parts: int) -> DataFrame:
    """``label`` as links are dealt out. A sweep stores it as a table, which forgets how it was made: of a checkpoint Spark keeps the size that it guesses, for a join the product of both sides, so from sweep to sweep that number got twice as many digits, until the driver did nothing but multiply it."""
    return label.repartition(parts, "place")


def move(nodes: DataFrame, pairs: DataFrame, sweeps: int = SWEEPS, resolution: float = 2.0) -> DataFrame:
    """(node_id, cluster): local moving in which nodes move at once, by the same gain.

    In each half of a sweep only nodes of one hash class move, lest linked nodes swap places
    for ever; ties go to the smallest cluster, and a node stays unless another one gains.
    """
    names, both, label, parts = _numbered(nodes, pairs)
    double, quiet = both.count(), 0
    # links lie by the end that is asked, through all sweeps
    halves = [dealt(both.where(F.col("turn") == t).select("a", "b").repartition(parts, "b")) for t in (0, 1)] if double else []
    for i in range(2 * sweeps if double else 0):
        label = _placed(label, parts)
        weight = checkpointed(label.groupBy("cluster").agg(F.sum("k").alias("all")))
        weight = F.broadcast(weight) if weight.count() <= FEW_CLUSTERS else weight.hint("shuffle_hash")
        own = label.where(F.col("turn") == i % 2)
        said = _heard(halves[i % 2], label).select("a", "cluster", F.lit(1.0).alias("toward")).unionAll(own.select("place", "cluster", F.lit(0.0)))
        tries = said.repartition(parts, "a").groupBy("a", "cluster").agg(F.sum("toward").alias("toward"))
        tries = tries.join(own.select(F.col("place").alias("a"), F.col("cluster").alias("old"), "k").hint("shuffle_hash"), "a").join(weight, "cluster")
        rest = F.col("all") - F.when(F.col("cluster") == F.col("old"), F.col("k")).otherwise(0.0)
        gain = F.col("toward") / float(double) - resolution * rest * F.col("k") / float(double) ** 2
        best = tries.groupBy("a").agg(F.min_by("cluster", F.struct(-gain, F.col("cluster") != F.col("old"), F.col("cluster"))).alias("best"))
        met = label.join(best.hint("shuffle_hash"), F.col("place") == F.col("a"), "left")
        label = stored(met.select("place", F.coalesce("best", "cluster").alias("cluster"), "k", "turn", (F.col("best") != F.col("cluster")).alias("moved")))
        quiet = quiet + 1 if label.where("moved").isEmpty() else 0
        if quiet == 2:  # neither half moved
            break
    return _named(nodes, names, label)


def propagate(nodes: DataFrame, pairs: DataFrame, sweeps: int = LABEL_SWEEPS) -> DataFrame:
    """(node_id, cluster): label propagation in which all nodes move at once, by the commonest label, the smallest on ties."""
    names, both, label, parts = _numbered(nodes, pairs)
    low = (1 << 32) - 1
    for _ in range(sweeps):
        label = _placed(label, parts)
        votes = _heard(both, label).repartition(parts, "a").groupBy("a", "cluster").agg(F.count("*").alias("n"))
        # votes and the label's number, both below 2^31, in one long: the largest is the commonest, the smallest on ties
        best = votes.groupBy("a").agg(F.max(F.call_function("shiftleft", F.col("n"), F.lit(32)).bitwiseOR(low - F.col("cluster"))).alias("top")).select("a", (F.lit(low) - F.col("top").bitwiseAND(F.lit(low))).alias("best"))
        label = stored(label.join(best, F.col("place") == F.col("a"), "left").select("place", F.coalesce("best", "cluster").alias("cluster"), "k", "turn", (F.col("best") != F.col("cluster")).alias("moved")))
        if label.where("moved").isEmpty():
            break
    return _named(nodes, names, label)
