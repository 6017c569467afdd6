"""Graph operators on edge tables, as bounded or converging rounds of joins and aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut


def undirected(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Both directions of each distinct edge, without loops."""
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    return e.union(e.select("v", "u")).distinct()


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hops): all nodes within so many hops of each seed (u, v are both directions); the frontier alone is joined."""
    seen = seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["u"]).select("seed", F.col("v").alias("node")).distinct()
        frontier = cut(step.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(d)))
        seen = seen.union(frontier)
    return seen


def distance_to(edges: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(node, hops) to the nearest target within a depth: one search from all targets at once."""
    seen = targets.select("node").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["u"]).select(F.col("v").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(d)))
        seen = seen.union(frontier)
    return seen


def call_chain(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, hops, path) reached along directed edges (u, v) from start (node), by the shortest path first in order."""
    seen = start.select("node").distinct().select("node", F.lit(0).alias("hops"), F.array(F.col("node").cast("string")).alias("path"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(edges.select("u", "v").distinct(), frontier["node"] == F.col("u")).select(F.col("v").alias("node"), F.lit(d).alias("hops"), F.concat("path", F.array(F.col("v").cast("string"))).alias("path"))
        step = step.join(seen.select("node"), "node", "left_anti")
        frontier = cut(step.groupBy("node", "hops").agg(F.min("path").alias("path")))
        seen = seen.unionByName(frontier)
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, role) over distinct edges; roots have no way in, leaves no way out."""
    e = edges.select("u", "v").distinct()
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("v", F.lit(0), F.lit(1)))
    by = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return by.withColumn("role", F.when(F.col("in_degree") == 0, "root").when(F.col("out_degree") == 0, "leaf").otherwise("inner"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex with an edge (u, v); the component is its smallest vertex.

    Each round links every vertex's larger neighbours to the least one (large star), then its smaller ones (small
    star); the rounds grow with the logarithm of the vertices. Minima are taken before the shuffle and joins split
    skewed keys, so a hub of any degree is held nowhere. Rows with nulls, loops and repeated edges count for nothing.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    mark = _mark(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(parent, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(parent.select("u", F.col("m").alias("v")))
        now = cut(below.distinct())
        if (then := _mark(now)) == mark:
            break
        mark = then
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())


def bipartite_groups(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(component, lefts, rights, kind) of a mapping: one_to_one, renumbered, split, merge or complex. Components are named by their least tagged end."""
    tag = lambda side, c: F.concat(F.lit(side), F.format_string("%020d", F.col(c)))
    e = edges.select(left, right, tag("L", left).alias("u"), tag("R", right).alias("v"))
    of = components(e.select("u", "v"))
    by = e.join(of, e["u"] == of["vertex"]).groupBy("component").agg(F.count_distinct(left).alias("lefts"), F.count_distinct(right).alias("rights"), F.min(left).alias("_l"), F.min(right).alias("_r"))
    one = (F.col("lefts") == 1) & (F.col("rights") == 1)
    kind = F.when(one & (F.col("_l") == F.col("_r")), "one_to_one").when(one, "renumbered").when(F.col("lefts") == 1, "split").when(F.col("rights") == 1, "merge").otherwise("complex")
    return by.select("component", "lefts", "rights", kind.alias("kind"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of cyclic strongly connected components, loops included; named by their least vertex.

    Colours spread forwards until each vertex has the least vertex that reaches it; within a colour, what reaches its
    origin backwards is the origin's component. Found vertices leave, and the rest goes on.
    """
    e = cut(edges.select("u", "v").where("u is not null and v is not null").distinct())
    loops = e.where("u = v").select("u")
    e, out = e.where("u <> v"), None
    while True:
        e = cut(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"))
        if e.isEmpty():
            break
        colour = _spread(e, e.select(F.col("u").alias("node")).union(e.select("v")).distinct().withColumn("c", F.col("node")))
        inner = e.join(colour.select(F.col("node").alias("u"), F.col("c").alias("cu")), "u").join(colour.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv")
        back = cut(inner.select(F.col("v").alias("u"), F.col("u").alias("v")))
        reach = colour.where("node = c").select("node", "c")
        frontier = reach
        while True:
            frontier = cut(frontier.join(back, frontier["node"] == back["u"]).select(F.col("v").alias("node"), "c").distinct().join(reach, ["node", "c"], "left_anti"))
            if frontier.isEmpty():
                break
            reach = cut(reach.union(frontier))
        out = reach if out is None else out.union(reach)
        gone = reach.select("node")
        e = cut(e.join(gone.select(F.col("node").alias("u")), "u", "left_anti").join(gone.select(F.col("node").alias("v")), "v", "left_anti").select("u", "v"))
    named = loops.select(F.col("u").alias("vertex"), F.col("u").alias("component"))
    if out is not None:
        sized = out.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("c"))).where("n > 1").select(F.col("node").alias("vertex"), F.col("c").alias("component"))
        named = sized.union(named.join(sized.select("vertex"), "vertex", "left_anti"))
    return named


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """The least colour that reaches each node along the edges."""
    colour = cut(colour)
    while True:
        sent = colour.join(edges, colour["node"] == edges["u"]).groupBy(F.col("v").alias("node")).agg(F.min("c").alias("n"))
        new = cut(colour.join(sent, "node", "left").select("node", F.least("c", F.coalesce("n", "c")).alias("c"), (F.col("n") < F.col("c")).alias("moved")))
        colour = new.select("node", "c")
        if new.where("moved").isEmpty():
            return colour


def shortest_paths(edges: DataFrame, starts: DataFrame, rounds: int, most: float | None = None) -> DataFrame:
    """(node, cost, previous) by relaxing directed edges (u, v, w) from starts (node) until nothing improves; of equal costs the lower predecessor. Nodes that cost over `most` are left out, and not gone on from."""
    best = cut(starts.select("node", F.lit(0.0).alias("cost"), F.lit(None).cast(edges.schema["u"].dataType).alias("previous")))
    frontier = best
    for _ in range(rounds):
        offer = frontier.join(edges, frontier["node"] == edges["u"]).select(F.col("v").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("u").alias("previous"))
        offer = offer.where(F.col("cost") <= most) if most is not None else offer
        offer = offer.groupBy("node").agg(F.min(F.struct("cost", "previous")).alias("o")).select("node", "o.*")
        old = best.select("node", F.col("cost").alias("_c"), F.col("previous").alias("_p"))
        better = cut(offer.join(old, "node", "left").where(F.col("_c").isNull() | (F.col("cost") < F.col("_c")) | ((F.col("cost") == F.col("_c")) & (F.col("previous") < F.col("_p")))).select("node", "cost", "previous"))
        if better.isEmpty():
            break
        best = cut(best.join(better.select("node"), "node", "left_anti").union(better))
        frontier = better
    return best


def route(edges: DataFrame, start: int, end: int, rounds: int) -> DataFrame:
    """(step, node, cost) of the cheapest path; empty without one. Its length bounds the walk back."""
    start_row = edges.sparkSession.createDataFrame([(start,)], "node long")
    best = shortest_paths(edges, start_row, rounds)
    path, node = [], end
    while node is not None and (row := best.where(F.col("node") == node).first()):
        path.append((int(node), float(row["cost"])))
        node = row["previous"]
    return edges.sparkSession.createDataFrame([(i, n, c) for i, (n, c) in enumerate(reversed(path))], "step int, node long, cost double")


def scenic_or_shortest(edges: DataFrame, start: int, end: int, rounds: int, most: float = 1.25) -> tuple[str, DataFrame]:
    """The route by the column `scenic`, if its true length (w) is at most so many times the shortest one's."""
    short = route(edges, start, end, rounds)
    nice = route(edges.select("u", "v", F.col("scenic").alias("w")), start, end, rounds)
    step = Window.orderBy("step")
    legs = nice.select(F.lag("node").over(step).alias("_from"), F.col("node").alias("_to")).join(edges, (F.col("_from") == F.col("u")) & (F.col("_to") == F.col("v"))).agg(F.sum("w")).first()[0]
    least = short.agg(F.max("cost")).first()[0]
    return ("scenic", nice) if legs is not None and least is not None and legs <= most * least else ("shortest", short)


#: Which kinds of edges a mode takes, if both ends are its own.
ROUTE_KINDS = {
    "land": ["land_boundary", "strait", "river_crossing", "mountain_pass", "land_passage", "underground_internal", "explicit_passage"],
    "sea": ["water_boundary", "sea_route"],
}


def edge_allowed(mode: str, kind: Column, blocked: Column, from_sea: Column, to_sea: Column) -> Column:
    """Whether a route by land, sea or both (`mixed`) may take an edge: the mode must be at home at both ends and know the kind, and only where water touches doesn't `blocked` count. Sea routes join seas in every mode; a mixed route goes aboard and ashore where land and water touch."""
    home = {"land": ~from_sea & ~to_sea, "sea": from_sea & to_sea, "mixed": F.lit(True)}[mode]
    known = kind.isin(*[k for m, ks in ROUTE_KINDS.items() if mode in (m, "mixed") for k in ks])
    return home & known & (~blocked | (kind == "water_boundary")) & ((kind != "sea_route") | (from_sea & to_sea))


def diffuse(values: DataFrame, edges: DataFrame, rounds: int, rates: list[float], kind: str = "neighbor_mean", cap: float | None = None, floor: float | None = None) -> DataFrame:
    """values (node, value, absorption) after rounds in which each node moves towards its neighbours (u, v, w): high_to_low takes gains only. Rounds are synchronous; floor and cap hold before, cap after each."""
    v = F.col("value")
    v = F.greatest(v, F.lit(floor)) if floor is not None else v
    v = F.least(v, F.lit(cap)) if cap is not None else v
    now = cut(values.select("node", v.cast("double").alias("value"), F.coalesce("absorption", F.lit(1.0)).alias("absorption")))
    for r in range(max(1, rounds)):
        rate = rates[r] if r < len(rates) else (rates[-1] if rates else 0.2)
        rate = rate if rate > 0 else 0.2
        near = now.select(F.col("node").alias("v"), F.col("value").alias("theirs"))
        pull = edges.join(near, "v").join(now.select(F.col("node").alias("u"), F.col("value").alias("mine")), "u").withColumn("d", F.col("theirs") - F.col("mine"))
        if kind == "high_to_low":
            pull = pull.where("d > 0")
        moved = pull.groupBy(F.col("u").alias("node")).agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("step"))
        new = F.col("value") + rate * F.coalesce("step", F.lit(0.0)) * F.col("absorption")
        new = F.least(new, F.lit(cap)) if cap is not None else new
        now = cut(now.join(moved, "node", "left").select("node", new.alias("value"), "absorption"))
    return now.select("node", "value")


def decay(values: DataFrame, edges: DataFrame, seeds: DataFrame, rate: float, depth: int) -> DataFrame:
    """values (node, value) times rate ** hops from the nearest seed; nodes not reached keep theirs."""
    far = distance_to(edges, seeds, depth)
    return values.join(far, "node", "left").select("node", (F.col("value") * F.coalesce(F.pow(F.lit(rate if rate > 0 else 0.5), F.col("hops")), F.lit(1.0))).alias("value"))


def ancestors(parents: DataFrame, depth: int) -> DataFrame:
    """(node, ancestor, hops) up a hierarchy (node, parent) to a depth; a cycle ends where it closes."""
    up = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_p")).where("_p is not null")
    now = parents.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("hops"), F.array("node").alias("_path"))
    out = now
    for d in range(1, depth + 1):
        now = now.join(up, now["ancestor"] == up["_n"]).where(~F.array_contains("_path", F.col("_p"))).select("node", F.col("_p").alias("ancestor"), F.lit(d).alias("hops"), F.concat("_path", F.array("_p")).alias("_path"))
        out = out.union(now)
    return out.drop("_path")


def nearest_valid(chain: DataFrame, holders: DataFrame, valid: Callable[[Column], Column]) -> DataFrame:
    """(node, holder, hops): of each node's ancestors the nearest with a valid holder (node, holder)."""
    h = holders.where(valid(F.col("holder"))).select(F.col("node").alias("ancestor"), "holder")
    return chain.join(h, "ancestor").groupBy("node").agg(F.min(F.struct("hops", "holder")).alias("b")).select("node", "b.holder", "b.hops")


def closure(members: DataFrame, depth: int) -> DataFrame:
    """(node, member): all that a node holds, through others it holds (node, member), to a depth."""
    out = frontier = members.select("node", "member").distinct()
    for _ in range(depth):
        step = frontier.join(members.select(F.col("node").alias("member"), F.col("member").alias("_next")), "member").select("node", F.col("_next").alias("member")).distinct()
        frontier = cut(step.join(out, ["node", "member"], "left_anti"))
        out = out.union(frontier)
    return out


def colours(edges: DataFrame, palette: int) -> DataFrame:
    """(node, colour): a proper colouring by rounds. In each, the nodes that outrank all their uncoloured neighbours - by degree, then id - take the least colour unused around them, modulo the palette."""
    near = cut(undirected(edges))
    rank = cut(near.groupBy("u").agg(F.count(F.lit(1)).alias("deg")))
    done = None
    left = rank
    while not left.isEmpty():
        open_ = near.join(left, "u").join(left.select(F.col("u").alias("v"), F.col("deg").alias("deg_v")), "v")
        beaten = open_.where("deg_v > deg or (deg_v = deg and v < u)").select("u").distinct()
        turn = cut(left.join(beaten, "u", "left_anti"))
        if done is None:
            new = turn.select("u", F.lit(0).alias("colour"))
        else:
            used = near.join(turn.select("u"), "u").join(done.select(F.col("u").alias("v"), "colour"), "v").groupBy("u").agg(F.collect_set("colour").alias("used"))
            free = F.filter(F.sequence(F.lit(0), F.size("used")), lambda i: ~F.array_contains("used", i))[0]
            new = turn.join(used, "u", "left").select("u", F.coalesce(free, F.lit(0)).alias("colour"))
        done = cut(new if done is None else done.union(new))
        left = cut(left.join(turn.select("u"), "u", "left_anti"))
    return done.select(F.col("u").alias("node"), F.pmod("colour", F.lit(palette)).alias("colour")) if done is not None else near.select(F.col("u").alias("node"), F.lit(0).alias("colour"))


def membership_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between groups, from edges (u, v, w) between members (node, grp): (a, b, w) with a < b."""
    a, b = (members.select(F.col("node").alias(n), F.col("grp").alias(g)) for n, g in (("u", "a0"), ("v", "b0")))
    both = edges.join(a, "u").join(b, "v").where("a0 <> b0")
    return both.groupBy(F.least("a0", "b0").alias("a"), F.greatest("a0", "b0").alias("b")).agg(F.sum("w").alias("w"))
