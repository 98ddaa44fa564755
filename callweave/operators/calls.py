"""From call sites to call edges: range joins, enclosing symbols, resolution, dispatch.

Symbols carry ``seq``, their order of insertion; wherever the model says "first", the
smallest ``seq`` wins. Range joins get an equi key besides the file: a body is exploded
over the bins of lines it covers, so one very long file spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed

#: Lines a bin covers: most bodies lie in one or two.
BIN = 64


def _binned(bodies: DataFrame, start: str, end: str) -> DataFrame:
    return bodies.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.col(end) / BIN))))


def in_body(points: DataFrame, bodies: DataFrame, start: str = "body_start", end: str = "body_end") -> DataFrame:
    """Every (point, body) of one file with the point's ``line`` within the body, both ends included. Bodies' columns get the prefix ``sym_``."""
    b = _binned(bodies, start, end)
    b = b.select([F.col(c).alias(c if c == "_bin" else f"sym_{c}") for c in b.columns])
    p = points.withColumn("_pbin", F.floor(F.col("line") / BIN))
    within = (p["file_path"] == b["sym_file_path"]) & (p["_pbin"] == b["_bin"]) & p["line"].between(F.col(f"sym_{start}"), F.col(f"sym_{end}"))
    return p.join(b, within).drop("_bin", "_pbin")


def enclosing(points: DataFrame, symbols: DataFrame, keys: list[str], mode: str = "smallest") -> DataFrame:
    """Each point (``keys``) with the ``sym_node_id`` and, if there are names, ``sym_name`` of its enclosing symbol: the ``smallest`` body (first on ties), or the ``first`` inserted.

    The bodies over a bin of lines are one row, so a point meets one row; points are neither
    multiplied nor sorted, and a task holds no more than its bins' bodies.
    """
    size = [(F.col("body_end") - F.col("body_start")).alias("size")] if mode == "smallest" else []
    names = [c for c in ("node_id", "name") if c in symbols.columns]
    over = _binned(symbols, "body_start", "body_end").groupBy(F.col("file_path").alias("_file"), "_bin").agg(F.collect_list(F.struct(*size, "seq", "body_start", "body_end", *names)).alias("_over"))
    p = points.select(*keys).withColumn("_pbin", F.floor(F.col("line") / BIN))
    met = p.join(over.hint("shuffle_hash"), (p["file_path"] == over["_file"]) & (p["_pbin"] == over["_bin"]))
    best = F.array_min(F.filter("_over", lambda b: F.col("line").between(b["body_start"], b["body_end"])))
    return met.select(*keys, best.alias("_best")).where("_best IS NOT NULL").select(*keys, *[F.col(f"_best.{c}").alias(f"sym_{c}") for c in names])


def _first(symbols: DataFrame, keys: list[str]) -> DataFrame:
    return symbols.groupBy(*keys).agg(F.min_by("node_id", "seq").alias("target"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """``calls`` with ``target`` (null: unresolved) by the graph's order of strategies.

    The callee's text as a simple name, same file before first inserted; again without a
    leading ``this.``; for one-dot text by the method's name: the same file or the first, if
    the receiver is known (a symbol or a candidate's file has its name, as given or
    capitalised), else the first candidate whose path contains a source the caller's file
    imports, else the same file.

    A text that is a name needs two look-ups, by name and by name and file. Of all others
    those with a dot are left. What they resolve to depends on their file and text alone, so
    each such pair is dealt out once under the names that its strategies look up, alone and
    with its file; one join with one row for each name, for each name in a file and for each
    name in a file of a base name answers all, and one grouping brings the answers together.
    Popular names do not fan out; only receivers left unknown meet all candidates of their
    method. ``calls`` themselves take part in the last join alone. ``asked``: calls that hold
    every file and text of ``calls`` and are cheaper to read.
    """
    return calls.join(_targets(calls if asked is None else asked, symbols, imports), ["file_path", "callee_name"], "left").select(*calls.columns, "target")


#: (file, text) pairs that calls resolve by, up to which they are broadcast: some 60 MB.
FEW_TEXTS = 400_000


def _targets(calls: DataFrame, symbols: DataFrame, imports: DataFrame | None) -> DataFrame:
    """(file_path, callee_name, target) of those that resolve, to be looked up in a hash table: of all while they are few, else of a share."""
    resolved = checkpointed(_resolved(calls, symbols, imports).where("target IS NOT NULL"))
    return F.broadcast(resolved) if resolved.count() <= FEW_TEXTS else resolved.hint("shuffle_hash")


def _resolved(calls: DataFrame, symbols: DataFrame, imports: DataFrame | None) -> DataFrame:
    """(file_path, callee_name, target): :func:`resolve_calls` of each file and text."""
    # Spark would make the pairs for each look-up anew, and push look-ups below the distinct, to every call
    calls = checkpointed(calls.select("file_path", "callee_name").distinct())
    file, text = F.col("file_path"), F.col("callee_name")
    any_ = symbols.groupBy(F.col("name").alias("_n")).agg(F.min_by("node_id", "seq").alias("_any"))
    own_ = symbols.groupBy(F.col("name").alias("_on"), F.col("file_path").alias("_of")).agg(F.min_by("node_id", "seq").alias("_in_file"))
    bare = F.when(text.startswith("this."), F.substr(text, F.lit(6))).otherwise(text)
    dotted = bare.contains(".") & ~F.regexp_replace(bare, r"\.[^.]*$", "").contains(".")
    asks = calls.where(text.contains(".")).join(any_, text == F.col("_n"), "left_anti").withColumn("_bare", F.when(bare != text, bare))
    asks = asks.withColumn("_method", F.when(dotted, F.substring_index(bare, ".", -1))).withColumn("_receiver", F.when(dotted, F.substring_index(bare, ".", 1)))
    big = F.concat(F.upper(F.substring("_receiver", 1, 1)), F.substr("_receiver", F.lit(2)))
    every, stemmed = F.lit(""), lambda c: F.concat(F.lit("\0"), c)
    keys = [("o2", F.col("_bare"), file), ("a2", F.col("_bare"), every), ("o3", F.col("_method"), file), ("a3", F.col("_method"), every),
            ("k0", F.col("_receiver"), every), ("k1", big, every), ("s0", F.col("_method"), stemmed(F.col("_receiver"))), ("s1", F.col("_method"), stemmed(big))]
    dealt = asks.select("file_path", "callee_name", "_method", F.explode(F.array_compact(F.array(*[F.when(n.isNotNull(), F.struct(F.lit(slot).alias("slot"), n.alias("n"), f.alias("f"))) for slot, n, f in keys]))).alias("k"))
    stem = F.regexp_replace(F.substring_index("file_path", "/", -1), r"\.[^.]*$", "")
    names = symbols.select(F.col("name").alias("n"), F.explode(F.array(every, F.col("file_path"), stemmed(stem))).alias("f"), "node_id", "seq").groupBy("n", "f").agg(F.min_by("node_id", "seq").alias("t"))
    met = dealt.select("file_path", "callee_name", "_method", "k.*").join(names, ["n", "f"])
    slots = F.map_from_entries(F.collect_list(F.struct("slot", "t")))
    answers = met.groupBy("file_path", "callee_name").agg(slots.alias("_m"))
    got = lambda slot: F.try_element_at("_m", F.lit(slot))
    known = F.coalesce(*map(got, ("k0", "k1", "s0", "s1"))).isNotNull()
    direct = F.coalesce(*map(got, ("o2", "a2")), F.when(known, F.coalesce(got("o3"), got("a3"))))
    answers = answers.select("file_path", "callee_name", direct.alias("_direct"), got("o3").alias("_own"), got("a3").isNotNull().alias("_named"))
    if imports is None:
        found = answers.select("file_path", "callee_name", F.coalesce("_direct", "_own").alias("target"))
    else:
        # which paths hold a source is settled once for each source and path, then each name has one best candidate for each
        # source, so no caller meets every candidate; a path that contains a source contains it without its leading dots as well
        sources = imports.select(F.col("file_path").alias("_if"), F.regexp_replace("source", r"^\.\.?/", "").alias("_source")).distinct()
        answers = checkpointed(answers)  # read twice
        left = answers.where("_direct IS NULL AND _named").withColumn("_method", F.substring_index("callee_name", ".", -1))
        candidates = symbols.groupBy(F.col("name").alias("_method"), F.col("file_path").alias("_cf")).agg(F.min_by("node_id", "seq").alias("node_id"), F.min("seq").alias("seq"))
        holds = candidates.select("_cf").distinct().crossJoin(sources.select("_source").distinct()).where(F.col("_cf").contains(F.col("_source")))
        best = candidates.join(holds, "_cf").groupBy("_method", "_source").agg(F.min_by("node_id", "seq").alias("node_id"), F.min("seq").alias("seq"))
        via = left.join(sources, F.col("file_path") == F.col("_if")).join(best, ["_method", "_source"]).groupBy("file_path", "callee_name").agg(F.min_by("node_id", "seq").alias("_via"))
        found = answers.join(via, ["file_path", "callee_name"], "left").select("file_path", "callee_name", F.coalesce("_direct", "_via", "_own").alias("target"))
    plain = calls.join(any_, text == F.col("_n"), "left").join(own_, (text == F.col("_on")) & (file == F.col("_of")), "left")
    return plain.join(found, ["file_path", "callee_name"], "left").select("file_path", "callee_name", F.coalesce("_in_file", "_any", "target").alias("target"))


def resolve_native(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``calls`` with ``target`` by the native index's four strategies.

    Same file by simple or qualified name; then any candidate of the name that the caller's
    file imports by specifier; then a candidate whose file matches an import source; then,
    for dotted text, the first symbol whose qualified name has a dot and ends with the method.
    """
    both = symbols.select(F.col("name").alias("_n"), "file_path", "node_id", "seq").unionAll(symbols.where("qualified_name <> name").select("qualified_name", "file_path", "node_id", "seq"))
    own = both.groupBy("_n", F.col("file_path").alias("_f")).agg(F.min_by("node_id", "seq").alias("_own"))
    first = both.groupBy("_n").agg(F.min_by("node_id", "seq").alias("_any"))
    spec = imports.select(F.col("file_path").alias("_sf"), F.col("specifier").alias("_sp")).distinct().withColumn("_spec", F.lit(True))
    df = calls.join(own, (calls["callee_name"] == F.col("_n")) & (calls["file_path"] == F.col("_f")), "left").drop("_n", "_f")
    df = df.join(first, df["callee_name"] == F.col("_n"), "left").drop("_n")
    df = df.join(spec, (df["file_path"] == F.col("_sf")) & (df["callee_name"] == F.col("_sp")), "left").drop("_sf", "_sp")
    sources = imports.select(F.col("file_path").alias("_if"), F.regexp_replace("source", r"^\.\.?/", "").alias("_src")).distinct()
    asked = df.where("_own IS NULL AND _spec IS NULL AND _any IS NOT NULL").select("file_path", "callee_name").distinct()
    hit = asked.join(both.select("_n", F.col("file_path").alias("_cf"), "node_id", "seq"), F.col("callee_name") == F.col("_n")).join(sources, (F.col("file_path") == F.col("_if")) & F.col("_cf").contains(F.col("_src")))
    via = hit.groupBy(F.col("file_path").alias("_vf"), F.col("callee_name").alias("_vc")).agg(F.min_by("node_id", "seq").alias("_via"))
    df = df.join(via, (df["file_path"] == F.col("_vf")) & (df["callee_name"] == F.col("_vc")), "left").drop("_vf", "_vc")
    method = F.when(F.col("callee_name").contains("."), F.substring_index("callee_name", ".", -1))
    tails = symbols.where(F.col("qualified_name").contains(".")).groupBy(F.substring_index("qualified_name", ".", -1).alias("_t")).agg(F.min_by("node_id", "seq").alias("_tail"))
    df = df.withColumn("_m", method).join(tails, F.col("_m") == F.col("_t"), "left")
    target = F.coalesce("_own", F.when(F.col("_spec"), F.col("_any")), "_via", "_tail")
    return df.withColumn("target", target).select(*calls.columns, "target")


def call_edges(calls: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, repeats: bool = False) -> DataFrame:
    """Distinct (source_id, target_id): the smallest enclosing symbol of every resolved call. ``repeats``: an edge for every call, for callers that drop repeats themselves."""
    # what a call resolves to depends on its file and text alone
    within = enclosing(calls, symbols, calls.columns).select("file_path", "callee_name", F.col("sym_node_id").alias("source_id"))
    edges = within.join(_targets(calls, symbols, imports), ["file_path", "callee_name"]).select("source_id", F.col("target").alias("target_id"))
    return edges if repeats else edges.distinct()


def callers_of(name: str, calls: DataFrame, symbols: DataFrame, keep_self: bool = False, mode: str = "first") -> DataFrame:
    """Symbols around calls whose text is exactly ``name``: first inserted (graph) or smallest (trace); the target itself goes unless kept."""
    hits = enclosing(calls.where(F.col("callee_name") == name), symbols, calls.columns, mode)
    out = hits.select(F.col("sym_node_id").alias("caller_id"), F.col("sym_name").alias("caller_name")).distinct()
    return out if keep_self else out.where(F.col("caller_name") != name)


def callees_in(symbols: DataFrame, calls: DataFrame, of: Column) -> DataFrame:
    """(caller_id, callee_id): for symbols that ``of`` selects, every definition named exactly like a call in their body.

    A node has one name, so distinct callers of a name and distinct nodes of it make distinct pairs, which are not shuffled.
    """
    inside = in_body(calls, symbols.where(of)).select(F.col("sym_node_id").alias("caller_id"), "callee_name").distinct()
    pairs = by_name(checkpointed(inside), "caller_id", symbols.select(F.col("name").alias("callee_name"), F.col("node_id").alias("callee_id")).distinct(), "callee_id")
    return pairs.select("caller_id", "callee_id")


#: Callers, and definitions, of a name that meet in one place; pairs that a task makes.
CALLER_LOT, NAMED_LOT, TASK_PAIRS = 8_192, 2_048, 20_000_000


def by_name(callers: DataFrame, source: str, named: DataFrame, target: str) -> DataFrame:
    """(``source``, ``callee_name``, ``target``): every caller of a name with every definition of it; both sides are read twice.

    There are as many pairs as the product of both, so it is pairs that are dealt out: a name's callers and its
    definitions are cut into lots, and each lot of the one meets each of the other in a place of its own, where a lot of
    definitions is one row. Tasks are counted by pairs, as what they are made of is little to Spark, and a popular name is
    no single task.
    """
    count = lambda df, out: df.groupBy("callee_name").agg(F.count("*").alias(out))
    lots = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    each = count(callers, "_c").join(count(named, "_d"), "callee_name")
    sizes = checkpointed(each.select("callee_name", lots("_c", CALLER_LOT).alias("_cs"), lots("_d", NAMED_LOT).alias("_ds"), (F.col("_c") * F.col("_d")).alias("_pairs")))
    tasks = max(int(callers.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sizes.agg(F.sum("_pairs")).first()[0] or 0) // TASK_PAIRS))
    cut = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = ["callee_name", "_at", "_to"]
    asks = callers.join(sizes, "callee_name").select(source, "callee_name", cut(source, "_cs").alias("_at"), every("_ds").alias("_to")).repartition(tasks, *place)
    held = named.join(sizes, "callee_name").select("callee_name", "_cs", cut(target, "_ds").alias("_to"), target).groupBy("callee_name", "_to").agg(F.collect_list(target).alias("_held"), F.first("_cs").alias("_cs"))
    held = held.select("callee_name", "_to", "_held", every("_cs").alias("_at")).repartition(tasks, *place)
    return asks.join(held.hint("shuffle_hash"), place).select(source, "callee_name", F.explode("_held").alias(target))


def dispatch(targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """(node_id, impl_id): one-line declarations stand for every multi-line namesake elsewhere, if there is one; others for themselves."""
    t = targets.select("node_id", "name", "body_start", "body_end")
    bodies = symbols.where("body_start <> body_end").select(F.col("name").alias("_n"), F.col("node_id").alias("impl"))
    flat = F.col("body_start") == F.col("body_end")
    joined = t.join(bodies, flat & (F.col("name") == F.col("_n")) & (F.col("node_id") != F.col("impl")), "left")
    return joined.select("node_id", F.coalesce("impl", "node_id").alias("impl_id"))


def route(calls: DataFrame, conditionals: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls in bodies with ``route_line``: the first conditional of the body, in source order, with over one branch around the call (null: none)."""
    keys = [*calls.columns, "sym_node_id"]
    inside = in_body(calls, symbols).select(*keys).withColumn("_bin", F.floor(F.col("line") / BIN))
    held = in_body(conditionals.where("branches > 1"), symbols).select(F.col("sym_node_id").alias("_owner"), F.col("line").alias("route_line"), F.col("end_line").alias("_ce"), F.col("seq").alias("_cs"))
    # conditionals are dealt out over the bins of lines they cover, so a long body is no single key
    held = _binned(held, "route_line", "_ce").withColumnRenamed("_bin", "_cbin")
    over = inside.join(held, (F.col("sym_node_id") == F.col("_owner")) & (F.col("_bin") == F.col("_cbin")) & F.col("line").between(F.col("route_line"), F.col("_ce")), "left")
    # the bin follows from the line: with it in the key the rows stay where the join dealt them
    return over.groupBy(*keys, "_bin").agg(F.min_by("route_line", "_cs").alias("route_line")).drop("_bin")


def find_entry(symbols: DataFrame, spec: str) -> DataFrame:
    """At most one symbol: ``file:function`` (path equal or a suffix, any case), else the exact name, else the name as a substring; first inserted."""
    head, colon, tail = spec.rpartition(":")
    file, name = (head, tail) if colon and len(head) > 1 else ("", spec)
    path = F.lower("file_path")
    want = file.replace("\\", "/").lower()
    here = (path == want) | path.endswith(f"/{want}" if not want.startswith("/") else want) if file else F.lit(False)
    either = (F.col("name") == name) | (F.col("qualified_name") == name)
    rank = F.when(here & either, 0).when(either, 1).when(F.lower("name").contains(name.lower()), 2)
    return symbols.withColumn("_r", rank).where("_r IS NOT NULL").orderBy("_r", "seq").limit(1).drop("_r")
