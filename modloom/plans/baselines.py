"""Other clusterers: local moving with contraction, greedy merging, edge betweenness, spectral k-means; and graph traversal."""

from __future__ import annotations

from collections import deque
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import key
from ..operators.matrices import degrees
from .spectral import DENSE, embedding
from .tables import discard, materialise, materialise_by


def move_gains(edges: DataFrame, labels: DataFrame, gamma: float = 1.0, d: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(id, own, cand, gain): what moving a node from its own community to a neighbouring one adds to 2m times half the modularity. d:
    (id, d) of the graph where it is at hand; nodes: (id) of the nodes that may move, all without it."""
    d = (degrees(edges) if d is None else d).select("id", F.col("d").cast("double").alias("d"))
    l = labels.select("id", "label").join(d, "id")  # noqa: E741
    by = l.groupBy("label").agg(F.sum("d").alias("dc"))
    total = F.broadcast(d.agg(F.sum("d").alias("tot")))  # one row
    if nodes is not None:
        edges, l = edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi"), l.join(nodes, "id", "left_semi")  # noqa: E741
    near = edges.filter("src <> dst").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("cand")), "dst").groupBy(F.col("src").alias("id"), "cand").agg(F.sum("w").cast("double").alias("k"))
    # a node's own community is a candidate with no weight where it borders on none of it
    near = near.unionByName(l.select("id", F.col("label").alias("cand"), F.lit(0.0).alias("k"))).groupBy("id", "cand").agg(F.sum("k").alias("k"))
    g = near.join(l, "id").join(by.withColumnRenamed("label", "cand"), "cand").crossJoin(total)
    own = F.col("cand") == F.col("label")
    value = F.col("k") - gamma * F.col("d") * (F.col("dc") - F.when(own, F.col("d")).otherwise(0.0)) / F.col("tot")
    stay = F.max(F.when(own, value)).over(Window.partitionBy("id"))
    g = g.select("id", F.col("label").alias("own"), "cand", (value - stay).alias("gain"))
    return g.filter("cand <> own")


def contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The graph of communities; inner weight becomes a loop."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    return edges.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))


def affected(graph: DataFrame, labels: DataFrame, communities: DataFrame) -> DataFrame:
    """(id): the nodes in these communities (label) and their neighbours; no other node's gains depend on who is in them."""
    within = labels.join(communities, "label", "left_semi").select("id")
    return within.union(graph.join(within.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))).distinct()


def local_moves(graph: DataFrame, gamma: float = 1.0, rounds: int | None = None) -> tuple[DataFrame, bool]:
    """(id, label, moved), written, and whether anything has moved: from single nodes, rounds of moves to the best neighbouring community
    by nodes of alternating keyed parity, so that neighbours do not swap. They end when two rounds move nothing, when the labels
    come again (moves made at once may undo each other, and would do so for ever), or after `rounds`.

    A node whose gains were all spent at its last turn, two rounds ago, has none until a community changes that it is in or borders
    on. So from the third round on only nodes at communities that changed in the last two rounds are asked, and only their edges are joined."""
    seen: set[tuple] = set()
    graph = materialise_by(graph.select("src", "dst", "w"), "src")
    kept = materialise(graph.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("label"), F.lit(False).alias("moved")))
    moved_any, still, d = False, 0, materialise(degrees(graph))
    touched: list[DataFrame] = []  # communities (label) that the last two rounds have changed
    for r in count() if rounds is None else range(rounds):
        labels = kept.select("id", "label")
        turn = labels.select("id") if r < 2 else affected(graph, labels, touched[0].union(touched[1]))
        turn = turn.filter(key("id", 5) % 2 == r % 2)
        best = move_gains(graph, labels, gamma, d, turn).filter(F.col("gain") > 1e-9).groupBy("id").agg(F.max_by("cand", F.struct(F.round("gain", 9).alias("g"), (-F.col("cand")).alias("o"))).alias("to"))
        new = materialise(labels.join(best, "id", "left").select("id", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("moved"), F.col("label").alias("was")))
        moved, a, b = new.agg(F.count_if("moved"), F.bit_xor(F.xxhash64("id", "label")), F.bit_xor(F.xxhash64("label", "id", F.lit(5)))).first()
        touched.append(materialise(new.filter("moved").select(F.explode(F.array("label", "was")).alias("label")).distinct()))
        discard(kept, *touched[:-2])
        kept, touched = new, touched[-2:]
        moved_any |= bool(moved)
        still = 0 if moved else still + 1
        if still == 2 or (moved and (r % 2, a, b) in seen):
            break
        seen.add((r % 2, a, b))
    discard(d, graph, *touched)
    out = kept.select("id", "label", "moved")
    out._modloom_path = kept._modloom_path
    return out, moved_any


def louvain(edges: DataFrame, gamma: float = 1.0, levels: int | None = None) -> DataFrame:
    """(id, label): local moves, then contraction, until a level moves nothing (or for `levels` levels)."""
    graph = materialise(edges.select("src", "dst", F.col("w").cast("double").alias("w")))
    whole = materialise(graph.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    for _ in count() if levels is None else range(levels):
        labels, moved = local_moves(graph, gamma)
        if moved:
            before = graph, whole
            whole = materialise(whole.join(labels.select(F.col("id").alias("label"), F.col("label").alias("next")), "label").select("id", F.col("next").alias("label")))
            graph = materialise(contract(graph, labels.select("id", "label")))
            discard(*before)
        discard(labels)
        if not moved:
            break
    discard(graph)
    return canonical(whole)


def canonical(labels: DataFrame) -> DataFrame:
    """Labels named by their smallest member."""
    names = labels.groupBy("label").agg(F.min("id").alias("name"))
    return labels.join(names, "label").select("id", F.col("name").alias("label"))


def first_merge(edges: DataFrame) -> DataFrame:
    """(a, b, gain): the pair of nodes whose merging adds most to the modularity; the smaller pair in a tie."""
    d = degrees(edges).withColumn("d", F.col("d").cast("double"))
    tot = F.broadcast(d.agg(F.sum("d").alias("tot")))  # one row
    e = edges.filter("src < dst").join(d.select(F.col("id").alias("src"), F.col("d").alias("di")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("dj")), "dst").crossJoin(tot)
    gain = 2 * (F.col("w") / F.col("tot") - F.col("di") * F.col("dj") / (F.col("tot") * F.col("tot")))
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.round(gain, 9).alias("gain")).orderBy(F.desc("gain"), "a", "b").limit(1)


#: Pairs that a distributed round of greedy merging looks at.
BATCH = 256


def greedy_merge(edges: DataFrame, gamma: float = 1.0, most_pairs: int = 100_000, batch: int = BATCH) -> DataFrame:
    """(id, label): pairs of communities merged by largest gain, the smaller pair in a tie, until none is positive. Graphs of at most
    most_pairs edges (checked) are merged on the driver, larger ones by merge_batches; both make the same merges."""
    if edges.limit(2 * most_pairs + 1).count() > 2 * most_pairs:
        return merge_batches(edges, gamma, batch)
    rows = [(r["src"], r["dst"], float(r["w"])) for r in edges.collect()]
    total = sum(w for _, _, w in rows)
    near: dict[int, dict[int, float]] = {}
    d: dict[int, float] = {}
    for i, j, w in rows:
        d[i] = d.get(i, 0.0) + w
        near.setdefault(i, {})
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + w
    group = {i: i for i in near}
    while True:
        gain, i, j = max(((w * total - gamma * d[i] * d[j], -i, -j) for i, row in near.items() for j, w in row.items() if i < j), default=(0.0, 0, 0))
        if gain <= LEAST_GAIN * total * total:
            break
        i, j = -i, -j
        for k, w in near.pop(j).items():
            near[k].pop(j, None)
            if k != i:
                near[i][k] = near[i].get(k, 0.0) + w
                near[k][i] = near[i][k]
        d[i] += d.pop(j)
        for k, g in group.items():
            if g == j:
                group[k] = i
    return canonical(edges.sparkSession.createDataFrame([(int(i), int(g)) for i, g in group.items()], "id long, label long"))


#: A merge must add more than twice this to the modularity.
LEAST_GAIN = 5e-13


def _next_merges(pairs: list, least_new: dict, adjacent: set, floor: float) -> list[tuple[int, int]]:
    """The merges that the sequential rule makes next, as far as these pairs (all above the last one's gain, in its order) can tell.

    A pair that shares a community with an earlier merge is gone: what replaces it gains least_new at most. A pair is next while its
    gain is above all that earlier merges of the batch can have made, and while no community of it borders on theirs (then gains between two
    merged pairs would count too)."""
    out: list[tuple[int, int]] = []
    used: set[int] = set()
    made = floor
    for a, b, gain in pairs:
        if a in used or b in used:
            continue
        if gain <= made or any((x, y) in adjacent for x in (a, b) for y in used):
            break
        out.append((a, b))
        used |= {a, b}
        made = max(made, least_new[a, b])
    return out


def merge_batches(edges: DataFrame, gamma: float = 1.0, batch: int = BATCH) -> DataFrame:
    """(id, label) of greedy merging, from a table of pairs of communities. A round takes the `batch` pairs of largest gain and, by a join, the
    largest gain that each one's merging would make; the first of them that are provably the next merges in order are made at
    once, and only pairs of merged communities are summed anew. The driver holds `batch` pairs and the edges among them."""
    spark = edges.sparkSession
    pairs = materialise(edges.filter("src <> dst").groupBy("src", "dst").agg(F.sum("w").cast("double").alias("w")))
    sizes = materialise(degrees(edges).select("id", F.col("d").cast("double").alias("d")))
    whole = materialise(sizes.select("id", F.col("id").alias("label")))
    total = sizes.agg(F.sum("d")).first()[0] or 0.0
    value = F.col("w") * total - gamma * F.col("di") * F.col("dj")
    di, dj = sizes.toDF("src", "di"), sizes.toDF("dst", "dj")
    while True:
        top = pairs.filter("src < dst").join(di, "src").join(dj, "dst").select("src", "dst", value.alias("gain")).orderBy(F.desc("gain"), "src", "dst").limit(batch).collect()
        top = [(r["src"], r["dst"], r["gain"]) for r in top if r["gain"] > LEAST_GAIN * total * total]
        if not top:
            break
        # what each pair's merging would make: gains with all that either side borders on
        side = F.broadcast(spark.createDataFrame([(a, b, x) for a, b, _ in top for x in (a, b)], "a long, b long, src long"))
        around = pairs.join(side, "src").filter("dst <> a AND dst <> b").groupBy("a", "b", "dst").agg(F.sum("w").alias("w"))
        own = F.broadcast(sizes.join(side, sizes.id == side.src).groupBy("a", "b").agg(F.sum("d").alias("di")))
        made = around.join(own, ["a", "b"]).join(dj, "dst").groupBy("a", "b").agg(F.max(value).alias("made"))
        least_new = dict.fromkeys(((a, b) for a, b, _ in top), float("-inf")) | {(r["a"], r["b"]): r["made"] for r in made.collect()}
        nodes = F.broadcast(spark.createDataFrame(sorted({(x,) for a, b, _ in top for x in (a, b)}), "x long"))
        adjacent = {(r["src"], r["dst"]) for r in pairs.join(nodes, F.col("src") == F.col("x"), "left_semi").join(nodes, F.col("dst") == F.col("x"), "left_semi").select("src", "dst").collect()}
        merges = _next_merges(top, least_new, adjacent, LEAST_GAIN * total * total)
        to = F.broadcast(spark.createDataFrame([(b, a) for a, b in merges], "old long, new long"))
        before = pairs, sizes, whole

        def renamed(table: DataFrame, col: str, to: DataFrame = to) -> DataFrame:
            return table.join(to, F.col(col) == F.col("old"), "left").withColumn(col, F.coalesce("new", col)).drop("old", "new")

        pairs = materialise(renamed(renamed(pairs, "src"), "dst").filter("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w")))
        sizes = materialise(renamed(sizes, "id").groupBy("id").agg(F.sum("d").alias("d")))
        whole = materialise(renamed(whole, "label"))
        di, dj = sizes.toDF("src", "di"), sizes.toDF("dst", "dj")
        discard(*before)
    discard(pairs, sizes)
    return canonical(whole)


def bfs_levels(edges: DataFrame) -> DataFrame:
    """(source, id, dist) from every node, level by level."""
    nodes = edges.select(F.col("src").alias("source")).distinct()
    seen = front = materialise(nodes.select("source", F.col("source").alias("id"), F.lit(0).alias("dist")))
    while True:
        step = front.join(edges.select(F.col("src").alias("id"), "dst"), "id").select("source", F.col("dst").alias("id"), (F.col("dist") + 1).alias("dist")).distinct()
        front = materialise(step.join(seen.select("source", "id"), ["source", "id"], "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = materialise(seen.union(front))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest node of each component, by propagation with pointer jumping."""
    labels = materialise(edges.groupBy(F.col("src").alias("id")).agg(F.min(F.least("src", "dst")).alias("label")))
    while True:
        heard = edges.join(labels.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label")
        least = labels.union(heard).groupBy("id").agg(F.min("label").alias("label"))
        jump = least.join(labels.select(F.col("id").alias("label"), F.col("label").alias("far")), "label").select("id", F.least("label", "far").alias("label"))
        new = materialise(jump)
        if not new.join(labels.withColumnRenamed("label", "was"), "id").filter("label <> was").limit(1).count():
            return new
        labels = new


def _betweenness(near: dict[int, set[int]]) -> dict[tuple[int, int], float]:
    """Shortest-path counts through each edge, from every source, accumulated backwards."""
    out: dict[tuple[int, int], float] = {}
    for s in near:
        dist, paths, order, queue = {s: 0}, {s: 1.0}, [], deque([s])
        while queue:
            u = queue.popleft()
            order.append(u)
            for v in sorted(near[u]):
                if v not in dist:
                    dist[v], paths[v] = dist[u] + 1, 0.0
                    queue.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        flow = dict.fromkeys(order, 1.0)
        for v in reversed(order):
            for u in near[v]:
                if dist[u] == dist[v] - 1:
                    part = flow[v] * paths[u] / paths[v]
                    e = (min(u, v), max(u, v))
                    out[e] = out.get(e, 0.0) + part / 2
                    flow[u] += part
    return out


def _parts(near: dict[int, set[int]]) -> dict[int, int]:
    label: dict[int, int] = {}
    for s in sorted(near):
        if s not in label:
            todo = [s]
            label[s] = s
            while todo:
                for v in near[todo.pop()]:
                    if v not in label:
                        label[v] = s
                        todo.append(v)
    return label


#: Sources that distributed betweenness follows at once.
SOURCES = 1024


def edge_betweenness(edges: DataFrame, block: int = SOURCES, sample: int | None = None, seed: int = 7) -> DataFrame:
    """(src, dst, paths), src < dst: the number of shortest paths between pairs of nodes that use an edge, parts of ties by their number.

    Sources go in blocks of about `block`. From all sources of a block at once, levels of (source, id, number of shortest paths) are
    reached by a join each and written; a node's neighbours lie in its level and those beside it, so a level is told from the last two
    alone. Shares then flow back level by level. A block holds block * n rows at most.

    sample: only so many sources (of least keyed number), paths scaled by n / sample. With probability 1 - p every edge is then within
    n * (n - 1) / 2 * sqrt(ln(2 * edges / p) / (2 * sample)) of its value (Hoeffding's bound)."""
    near = materialise(edges.filter("src <> dst").select("src", "dst").distinct())
    nodes = near.select(F.col("src").alias("source")).distinct()
    n, scale = nodes.count(), 1.0
    if sample is not None and sample < n:
        nodes, scale = nodes.orderBy(key("source", seed), "source").limit(sample), n / sample
        n = sample
    blocks = max(1, -(-n // block))
    nodes = materialise(nodes.withColumn("block", (key("source", 3) % blocks).cast("int")))
    parts: list[DataFrame] = []
    for k in range(blocks):
        parts.append(_block_betweenness(near, nodes.filter(F.col("block") == k).select("source")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = materialise(out.groupBy("src", "dst").agg((F.sum("paths") * scale).alias("paths")))
    discard(near, nodes, *parts)
    return out


def _block_betweenness(near: DataFrame, sources: DataFrame) -> DataFrame:
    levels = [materialise(sources.select("source", F.col("source").alias("id"), F.lit(1.0).alias("paths")))]
    while True:
        step = levels[-1].join(near.select(F.col("src").alias("id"), "dst"), "id").groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        for old in levels[-2:]:
            step = step.join(old.select("source", "id"), ["source", "id"], "left_anti")
        reached = materialise(step)
        if not reached.limit(1).count():
            discard(reached)
            break
        levels.append(reached)
    told: list[DataFrame] = []
    flow = None  # (source, id, flow): what goes through the nodes of a level, themselves included
    for d in range(len(levels) - 1, 0, -1):
        here = levels[d] if flow is None else levels[d].join(flow, ["source", "id"], "left")
        here = here.select("source", F.col("id").alias("dst"), ((F.lit(1.0) if flow is None else 1 + F.coalesce("flow", F.lit(0.0))) / F.col("paths")).alias("each"))
        back = here.join(near, "dst").join(levels[d - 1].select("source", F.col("id").alias("src"), "paths"), ["source", "src"])
        share = materialise(back.select("source", "src", "dst", (F.col("paths") * F.col("each")).alias("share")))
        told.append(share)
        flow = share.groupBy("source", F.col("src").alias("id")).agg(F.sum("share").alias("flow"))
    if not told:
        return materialise(near.select("src", "dst", F.lit(0.0).alias("paths")).limit(0))
    every = told[0]
    for s in told[1:]:
        every = every.unionByName(s)
    out = materialise(every.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg((F.sum("share") / 2).alias("paths")))
    discard(*levels, *told)
    return out


def girvan_newman(edges: DataFrame, most_nodes: int = DENSE, block: int = SOURCES) -> DataFrame:
    """(id, label): the first split by removing edges of largest betweenness, the smaller edge in a tie. Each removal needs all shortest paths
    anew: on the driver for graphs of at most most_nodes nodes (checked), by edge_betweenness beyond; both remove the same edges."""
    if edges.select("src").distinct().count() > most_nodes:
        return _distributed_split(edges, block)
    near: dict[int, set[int]] = {r["src"]: set() for r in edges.select("src").distinct().collect()}
    for r in edges.filter("src <> dst").select("src", "dst").collect():
        near[r["src"]].add(r["dst"])
    parts = _parts(near)
    start = len(set(parts.values()))
    while len(set(parts.values())) == start and any(near.values()):
        b = _betweenness(near)
        (i, j), _ = max(b.items(), key=lambda x: (round(x[1], 9), -x[0][0], -x[0][1]))
        near[i].discard(j)
        near[j].discard(i)
        parts = _parts(near)
    return edges.sparkSession.createDataFrame([(int(i), int(p)) for i, p in parts.items()], "id long, label long")


def _distributed_split(edges: DataFrame, block: int) -> DataFrame:
    nodes = materialise(edges.select(F.col("src").alias("id")).distinct())
    now = materialise(edges.filter("src <> dst").select("src", "dst").distinct())

    def parts() -> tuple[DataFrame, int]:
        found = nodes.join(connected_components(now), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
        found = materialise(found)
        return found, found.select("label").distinct().count()

    labels, start = parts()
    count = start
    while count == start and now.limit(1).count():
        b = edge_betweenness(now, block)
        i, j = b.orderBy(F.desc(F.round("paths", 9)), "src", "dst").select("src", "dst").first()
        after = materialise(now.filter(~F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).eqNullSafe(F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")))))
        discard(now, b, labels)
        now = after
        labels, count = parts()
    discard(now, nodes)
    return labels.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"))


def power_vector(edges: DataFrame, steps: int | None = None, tol: float = 1e-5) -> DataFrame:
    """(id, x), written: products of D^-1 W with the degrees' shares, each brought to a sum of 1. Cut short on purpose: it ends when
    no entry's change differs from its last change by more than tol / n (what is left by then is what tells clusters apart), or after `steps`."""
    d = materialise(degrees(edges).select("id", F.col("d").cast("double").alias("d")))
    n, total = d.agg(F.count("id"), F.sum("d")).first()
    x = materialise(d.select("id", (F.col("d") / F.lit(total or 1.0)).alias("x"), F.lit(0.0).alias("change")))
    for _ in count() if steps is None else range(steps):
        y = edges.join(x.select(F.col("id").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("y")).join(d, "id").select("id", (F.col("y") / F.col("d")).alias("y"))
        both = materialise(y.join(x, "id"))
        size = both.agg(F.sum("y")).first()[0] or 1.0
        now = both.select("id", (F.col("y") / size).alias("x"), F.abs(F.col("y") / size - F.col("x")).alias("change"), F.col("change").alias("before"))
        written = materialise(now)
        turn = written.agg(F.max(F.abs(F.col("change") - F.col("before")))).first()[0]
        discard(x, both)
        x = written
        if steps is None and (turn is None or turn <= tol / n):
            break
    discard(d)
    return x.select("id", "x")


def kmeans_line(values: DataFrame, k: int, rounds: int | None = None) -> DataFrame:
    """(id, label) of (id, x): Lloyd's rounds on the line from k centres evenly spaced between the ends, until no centre moves by 1e-12, or
    exactly `rounds` of them: values may span no more than some 1e-12, where moves below that still change labels. A centre without points stays. The driver holds k sums a round; ties go to the lower centre."""
    low, high = values.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return values.select("id", F.lit(0).alias("label"))
    centres = [low + (i + 0.5) / k * (high - low) for i in range(k)]

    def assigned() -> DataFrame:
        near = F.array_min(F.array(*[F.struct(F.round(F.abs(F.col("x") - c), 12).alias("gap"), F.lit(i).alias("label")) for i, c in enumerate(centres)]))
        return values.select("id", "x", near["label"].alias("label"))

    for _ in count() if rounds is None else range(rounds):
        means = {r["label"]: r["m"] for r in assigned().groupBy("label").agg(F.avg("x").alias("m")).collect()}
        after = [means.get(i, c) for i, c in enumerate(centres)]
        still = max(abs(a - b) for a, b in zip(after, centres, strict=True)) <= 1e-12
        centres = after
        if still and rounds is None:
            break
    return assigned().select("id", "label")


def power_clusters(edges: DataFrame, k: int, steps: int | None = None, rounds: int | None = None) -> DataFrame:
    """(id, label): power-iteration clustering, the spectral clustering that needs no eigenvectors."""
    return kmeans_line(power_vector(edges, steps), k, rounds)


def spectral_kmeans(edges: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(id, label): k-means over rows of the k smallest eigenvectors of the symmetric Laplacian, scaled to unit length."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    _, v = embedding(edges, "laplacian_sym", k)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = v.select("id", array_to_vector(F.transform("v", lambda x: F.coalesce(x / F.nullif(norm, F.lit(0.0)), F.lit(0.0)))).alias("features"))
    rows = materialise(rows)
    model = KMeans(k=k, seed=seed, maxIter=50).fit(rows)
    return canonical(model.transform(rows).select("id", F.col("prediction").alias("label")))
