"""Graphs as edge tables (src, dst): degrees, reach, cycles, importance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import stem
from tidemark.session import discard, materialise


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in, instability (out over all). Repeated edges count once;
    edges with a NULL end don't count."""
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    g = ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return g.withColumn("instability", F.col("n_out") / (F.col("n_out") + F.col("n_in")))


def reach(edges: DataFrame, start: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """node, depth: what can be reached from the nodes of start (column node)
    in at most depth steps, with the least depth; NULL nodes and ends count for
    nothing. Each step joins only the newest nodes, which are all that is
    written, so cycles end by themselves and the plan doesn't grow with the
    depth. Edges are written, without repeats, only where many steps read
    them."""
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(*(("dst", "src") if reverse else ("src", "dst"))).toDF("a", "b")
    if depth > 3:
        e = materialise(e.distinct())
    steps = [start.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0))]
    for d in range(1, depth + 1):
        step = e.join(steps[-1].select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        for before in steps:
            step = step.join(before.select("node"), "node", "left_anti")
        new = step.withColumn("depth", F.lit(d))
        if depth > 1:
            new = materialise(new)
        steps.append(new)
        if d < depth and new.isEmpty():
            break
    out = steps[0]
    for x in steps[1:]:
        out = out.unionByName(x)
    return out


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """src, dst, depth for all pairs joined by a path of at most depth edges."""
    e = materialise(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    seen = e.withColumn("depth", F.lit(1))
    new = seen
    for d in range(2, depth + 1):
        step = new.select("src", F.col("dst").alias("m")).join(e.toDF("m", "dst"), "m").select("src", "dst").distinct()
        new = materialise(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(d)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def cycles(edges: DataFrame, depth: int) -> DataFrame:
    """node, length: nodes that lie on a cycle of at most depth edges, with the
    shortest length."""
    c = closure(edges, depth)
    return c.where("src = dst").groupBy(F.col("src").alias("node")).agg(F.min("depth").alias("length"))


def all_cycles(edges: DataFrame) -> DataFrame:
    """node, length: all nodes that lie on a cycle of any length, with the
    shortest. Only edges within a component (see components()) can lie on a
    cycle; the known lengths of paths among these are joined with themselves
    until none changes, so rounds grow with the logarithm of the longest path.
    The work is that of all pairs of a component's nodes."""
    part = components(edges)
    ends = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"tm_{c}"))
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    e = materialise(e.join(ends("src"), "src").join(ends("dst"), "dst").where("tm_src = tm_dst").select("src", "dst"))
    size = lambda x: x.agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
    paths = e.withColumn("length", F.lit(1).cast("long"))
    now = size(paths)
    while True:
        further = paths.toDF("src", "m", "one").join(paths.toDF("m", "dst", "two"), "m").select("src", "dst", (F.col("one") + F.col("two")).alias("length"))
        longer = materialise(paths.unionByName(further).groupBy("src", "dst").agg(F.min("length").alias("length")))
        discard(paths)
        paths = longer
        before, now = now, size(paths)
        if before == now:
            return paths.where("src = dst").select(F.col("src").alias("node"), F.col("length").cast("int").alias("length"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the strongly connected component of every node of a
    graph, named by its greatest node; a node on no cycle is its own. Repeated
    edges count once, those with a NULL end don't.

    By colouring: nodes without edges in or out are components of their own and
    go first, over and over; then each node takes the greatest label that
    reaches it, and those that reach their label back through nodes of the same
    label are its component. What is left goes into the next round. Each step
    is a join and an aggregate over the edges left, so no node's neighbours are
    ever brought together."""
    e = materialise(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    left = materialise(nodes)
    done = []
    while not left.isEmpty():
        while True:  # what lies on no cycle
            inner = left.join(e.select(F.col("src").alias("node")), "node", "left_semi").join(e.select(F.col("dst").alias("node")), "node", "left_semi")
            inner = materialise(inner)
            trimmed = materialise(left.join(inner, "node", "left_anti"))
            if trimmed.isEmpty():
                discard(inner, trimmed)
                break
            done.append(trimmed.withColumn("component", F.col("node")))
            kept = materialise(e.join(inner.select(F.col("node").alias("src")), "src", "left_semi").join(inner.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
            discard(left, e)
            left, e = inner, kept
        if left.isEmpty():
            break
        colour = materialise(left.withColumn("c", F.col("node")))
        while True:  # the greatest label that reaches a node
            got = e.join(colour.select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("g"))
            new = materialise(colour.join(got, "node", "left").select("node", F.greatest("c", "g").alias("c"), (F.coalesce("g", "c") > F.col("c")).alias("moved")))
            discard(colour)
            colour = new.select("node", "c")
            colour.tm_path = new.tm_path
            if new.where("moved").isEmpty():
                break
        within = e.join(colour.select(F.col("node").alias("src"), F.col("c").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("c2")), "dst").where("c1 = c2").select("src", "dst")
        within = materialise(within)
        back = materialise(colour.where("node = c").select("node"))
        found = [back.join(colour, "node").select("node", F.col("c").alias("component"))]
        seen = back
        while True:
            more = within.join(back.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(seen, "node", "left_anti")
            back = materialise(more)
            if back.isEmpty():
                break
            seen = materialise(seen.unionByName(back))
            found.append(back.join(colour, "node").select("node", F.col("c").alias("component")))
        done += found
        rest = materialise(left.join(seen, "node", "left_anti"))
        kept = materialise(e.join(rest.select(F.col("node").alias("src")), "src", "left_semi").join(rest.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
        discard(left, e, within)
        left, e = rest, kept
    if not done:
        return nodes.withColumn("component", F.col("node"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def importance(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """node, rank: PageRank after so many rounds, from equal ranks; nodes
    without edges out give theirs to all."""
    e = materialise(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    nodes = materialise(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().join(e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")), "node", "left"))
    total = nodes.count()
    ranks = nodes.select("node", "n", F.lit(1.0 / max(1, total)).alias("rank"))
    for i in range(rounds):
        lost = ranks.where("n IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = e.join(ranks.select(F.col("node").alias("src"), (F.col("rank") / F.col("n")).alias("share")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("got"))
        new = nodes.join(given, "node", "left").crossJoin(F.broadcast(lost))
        ranks = new.select("node", "n", ((1 - damping) / total + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / total)).alias("rank"))
        if i % 3 == 2:
            ranks = materialise(ranks)
    return ranks.select("node", "rank")


def violations(edges: DataFrame, layer_of: DataFrame, order: list[str]) -> DataFrame:
    """src, dst, src_layer, dst_layer: edges from a lower layer to a higher one.
    layer_of: node, layer; order: layers from top to bottom."""
    place = F.create_map(*[x for i, layer in enumerate(order) for x in (F.lit(layer), F.lit(i))])
    a = layer_of.select(F.col("node").alias("src"), F.col("layer").alias("src_layer"))
    b = layer_of.select(F.col("node").alias("dst"), F.col("layer").alias("dst_layer"))
    return edges.join(a, "src").join(b, "dst").where(place[F.col("src_layer")] > place[F.col("dst_layer")])


def import_edges(files: DataFrame, *, path: str, imports: str) -> DataFrame:
    """src, dst: one edge per import of a file. imports is JSON, a list of
    objects with specifier and names; what isn't gives no edges."""
    t = "array<struct<specifier:string,names:array<string>>>"
    return files.select(F.col(path).alias("src"), F.explode(F.from_json(imports, t)).alias("i")).select("src", F.col("i.specifier").alias("dst")).where("dst IS NOT NULL")


def reference_files(files: DataFrame, *, path: str, imports: str, wanted: list[str], limit: int | None = 50) -> DataFrame:
    """path of files that import one of the wanted names, or a module whose stem
    is one of them, without regard to case; the first limit in order, or all in
    none."""
    w = F.array(*[F.lit(x.lower()) for x in wanted]) if wanted else F.array().cast("array<string>")
    i = F.from_json(imports, "array<struct<specifier:string,names:array<string>>>")
    hit = F.exists(i, lambda x: F.coalesce(F.arrays_overlap(F.transform(x["names"], lambda n: F.lower(n)), w), F.lit(False)) | F.coalesce(F.array_contains(w, F.lower(stem(x["specifier"]))), F.lit(False)))
    found = files.where(hit).where(F.col(path).isNotNull()).select(F.col(path).alias("path"))
    return found if limit is None else found.orderBy("path").limit(limit)
