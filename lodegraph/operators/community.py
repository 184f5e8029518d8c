"""Communities: detection, and what a given partition says about the architecture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions.text import round_half_up
from lodegraph.operators.components import connected_components
from lodegraph.operators.graph import degrees
from lodegraph.schema import Graph
from lodegraph.storage import drop, materialise

WEIGHTS = {"calls": 1.0, "inherits": 0.8, "implements": 0.7, "depends_on": 0.6, "imports": 0.5, "tested_by": 0.4}
OTHER_WEIGHT = 0.3
SPLIT_ABOVE = 50
ROLES = (
    ("test", r"/(test|__tests?__|spec)/|\.(test|spec)\."), ("ui", r"/(component|page|screen|ui|view)/"), ("service", r"/(api|controller|handler|route|service)/"),
    ("data", r"/(database|db|entity|model|repo|schema|store)/"), ("config", r"/(config|env|settings)/"), ("util", r"/(common|helper|lib|shared|util)/"),
)


def weighted_pairs(graph: Graph) -> DataFrame:
    """u < v, w: the heaviest edge between two existing, non-external nodes, in either direction; no self-loops."""
    w = F.lit(OTHER_WEIGHT)
    for k, v in WEIGHTS.items():
        w = F.when(F.col("kind") == k, v).otherwise(w)
    own = graph.nodes.where("not is_external").select("id")
    e = graph.edges.select("from_id", "to_id", w.alias("w")).where("from_id != to_id")
    e = e.join(own.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(own.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return e.groupBy(F.least("from_id", "to_id").alias("u"), F.greatest("from_id", "to_id").alias("v")).agg(F.max("w").alias("w"))


def local_moves(pairs: DataFrame, most_rounds: int = 1000, degree: DataFrame | None = None, settle: bool = True) -> DataFrame:
    """id, community by weighted modularity moves, all in DataFrames, until no node gains by one; within each ``parent`` if ``pairs`` has that column.

    ``degree`` (parent, id, k) may say what weight ends in each node, pairs inside it counted twice; else the pairs say.

    A node wants to move to the neighbouring community with the largest gain in modularity, ties to the smaller name.
    At first half of the nodes (by hash and round) do so and the others hold still, so that no two neighbours swap for ever.
    Once that lowers the number of those who want to by less than a twentieth, moves are chosen so that modularity rises with each of them
    (``_safe``), and they end when no node wants to move. Labels that have not come to that after ``most_rounds`` are an error.
    There is no other end; ``settle`` is the name by which callers ask for it.
    """
    if not settle:
        raise ValueError("moves end only when no node gains")
    if "parent" not in pairs.columns:
        pairs = pairs.withColumn("parent", F.lit(""))
    both = materialise(pairs.select("parent", F.col("u").alias("id"), F.col("v").alias("other"), "w").union(pairs.select("parent", "v", "u", "w")), "louvain")
    degree = materialise(both.groupBy("parent", "id").agg(F.sum("w").alias("k")) if degree is None else degree, "louvain")
    total = materialise(degree.groupBy("parent").agg(F.sum("k").alias("total")), "louvain")
    label = materialise(degree.join(total, "parent").select("id", F.col("id").alias("community"), "k", "total"), "louvain")
    safe, fewest = False, None
    for r in range(most_rounds):
        sums = label.groupBy("community").agg(F.sum("k").alias("s"))
        links = both.join(label.select(F.col("id").alias("other"), "community"), "other").groupBy("id", "community").agg(F.sum("w").alias("inside"))
        mine = label.select("id", F.col("community").alias("now"), "k", "total")
        gain = F.col("inside") - F.col("k") * (F.col("s") - F.when(F.col("community") == F.col("now"), F.col("k")).otherwise(0.0)) / F.col("total")
        scored = links.join(mine, "id").join(sums, "community").select("id", "now", "k", "total", "community", gain.alias("gain"))
        stay = label.join(sums, "community").select("id", F.col("community").alias("now"), "k", "total", "community", (-F.col("k") * (F.col("s") - F.col("k")) / F.col("total")).alias("gain"))
        first = F.min_by(F.struct("community"), F.struct((-round_half_up(F.col("gain"), 9)).alias("g"), (F.col("community") != F.col("now")).alias("moves"), "community"))
        more = F.max("gain") - F.max(F.when(F.col("community") == F.col("now"), F.col("gain")))
        best = scored.unionByName(stay).groupBy("id", "now", "k", "total").agg(first.alias("b"), more.alias("more"))
        nxt = materialise(best.select("id", "now", F.col("b.community").alias("to"), "k", "total", "more"), "louvain")
        wishes = nxt.where("now != to")
        wants = wishes.count()
        if not wants:
            break
        safe = safe or (fewest is not None and wants > 0.95 * fewest)
        fewest = min(wants, fewest or wants)
        if safe:
            placed = nxt.join(materialise(_safe(wishes, r), "louvain"), "id", "left")
        else:
            placed = nxt.withColumn("turn", F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0)
        moved = materialise(placed.select("id", F.when(F.col("turn"), F.col("to")).otherwise(F.col("now")).alias("community"), "k", "total"), "louvain")
        drop(label)
        drop(nxt)
        label = moved
    else:
        raise RuntimeError(f"{wants} nodes still want to move after {most_rounds} rounds")
    return label.select("id", "community")


def _safe(wishes: DataFrame, r: int) -> DataFrame:
    """id, turn: many moves at once, each of which raises modularity whichever come before it.

    A community only gives or only receives in a round, as in the strongest wish that touches it, so that no one finds
    fewer neighbours than counted where they go. What those before in line add to that community and take from the old one
    lessens a gain by k times that weight by the total at most; whose gain is larger than that may go. The strongest wish always may.
    """
    line = F.struct((-round_half_up(F.col("more"), 9)).alias("g"), F.xxhash64("id", F.lit(r)).alias("h"), "id")
    w = wishes.withColumn("line", line)
    touch = w.select("line", F.inline(F.array(F.struct(F.col("now").alias("c"), F.lit(False).alias("gets")), F.struct(F.col("to").alias("c"), F.lit(True).alias("gets")))))
    role = touch.groupBy("c").agg(F.min_by("gets", "line").alias("gets"))
    w = w.join(role.where("not gets").select(F.col("c").alias("now")), "now", "left_semi").join(role.where("gets").select(F.col("c").alias("to")), "to", "left_semi")
    before = lambda c: F.coalesce(F.sum("k").over(W.partitionBy(c).orderBy("line").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = w.withColumn("in", before("to")).withColumn("out", before("now"))
    free = (F.col("in") == 0) & (F.col("out") == 0)
    return left.where(free | (F.col("more") - F.col("k") * (F.col("in") + F.col("out")) / F.col("total") > 1e-9)).select("id", F.lit(True).alias("turn"))


def louvain(pairs: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """id, community: moves of nodes, then of whole communities as the nodes of a coarser graph, until none of them moves."""
    ends = pairs.select(F.col("u").alias("id"), "w").union(pairs.select("v", "w"))
    label = materialise(local_moves(pairs, most_rounds), "louvain")
    while True:
        of = lambda c: label.select(F.col("id").alias(c), F.col("community").alias(f"c{c}"))
        between = pairs.join(of("u"), "u").join(of("v"), "v").where("cu != cv")
        coarse = materialise(between.groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("w").alias("w")), "louvain")
        if coarse.isEmpty():
            return label
        degree = ends.join(label, "id").groupBy(F.lit("").alias("parent"), F.col("community").alias("id")).agg(F.sum("w").alias("k"))
        upper = materialise(local_moves(coarse, most_rounds, degree), "louvain")
        if upper.where("id != community").isEmpty():
            return label
        label = materialise(label.join(upper.select(F.col("id").alias("community"), F.col("community").alias("top")), "community").select("id", F.col("top").alias("community")), "louvain")


def modularity(pairs: DataFrame, members: DataFrame) -> float:
    """How much more weight lies inside the communities than chance would put there."""
    of = lambda c: members.select(F.col("id").alias(c), F.col("community").alias(f"c{c}"))
    e = pairs.join(of("u"), "u").join(of("v"), "v")
    inside, total = e.agg(F.coalesce(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w"))), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    k = e.select(F.col("cu").alias("c"), "w").union(e.select("cv", "w")).groupBy("c").agg(F.sum("w").alias("k"))
    return inside / total - k.agg(F.sum(F.col("k") * F.col("k"))).first()[0] / (4 * total * total) if total else 0.0


def detect(graph: Graph, most_rounds: int = 1000, method: str = "louvain") -> DataFrame:
    """id, community of non-external nodes in communities of two and more; those of more than 50 are split once, whatever their size.

    ``method`` components: the files that imports join, with all their nodes; without any pair of nodes that is what is left to tell, too.
    """
    pairs = materialise(weighted_pairs(graph), "pairs")
    if method == "components" or pairs.isEmpty():
        own = graph.nodes.where("not is_external").select("id", "file_path").join(file_components(graph), "file_path").select("id", F.col("component").alias("community"))
        every = materialise(own, "louvain")
        return every.join(every.groupBy("community").agg(F.count("*").alias("n")).where("n >= 2").select("community"), "community", "left_semi").select("id", "community")
    # ids by numbers in their order, so that ties fall alike and rounds shuffle a third of the bytes
    names = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct().orderBy("id")
    names = materialise(names.withColumn("n", F.monotonically_increasing_id()), "names")
    of = lambda c: names.select(F.col("id").alias(f"{c}_name"), F.col("n").alias(c))
    number = lambda c: names.select(F.col("id").alias(c), F.col("n").alias(f"{c}_number"))
    pairs = pairs.join(number("u"), "u").join(number("v"), "v").select(F.col("u_number").alias("u"), F.col("v_number").alias("v"), "w")
    pairs = materialise(pairs, "pairs")
    label = materialise(louvain(pairs, most_rounds), "louvain")
    size = label.groupBy("community").agg(F.count("*").alias("n"))
    inner = pairs.join(label.select(F.col("id").alias("u"), F.col("community").alias("parent")), "u").join(label.select(F.col("id").alias("v"), F.col("community").alias("p2")), "v").where("parent = p2")
    inner = materialise(inner.join(size.where(F.col("n") > SPLIT_ABOVE).select(F.col("community").alias("parent")), "parent", "left_semi").select("parent", "u", "v", "w"), "louvain")
    parts = local_moves(inner, most_rounds).withColumnRenamed("community", "part")
    # a node without a pair inside a community that is split stands for itself
    every = label.join(size.withColumnRenamed("n", "size"), "community").join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    every = every.join(of("id"), "id").join(of("community"), "community").join(of("part"), "part")
    named = F.when(F.col("size") > SPLIT_ABOVE, F.concat("community_name", F.lit("/"), "part_name")).otherwise(F.col("community_name"))
    every = materialise(every.select(F.col("id_name").alias("id"), named.alias("community")), "louvain")
    return every.join(every.groupBy("community").agg(F.count("*").alias("n")).where("n >= 2").select("community"), "community", "left_semi").select("id", "community")


def file_components(graph: Graph) -> DataFrame:
    """file_path, component: files joined by imports between non-external nodes."""
    own = graph.nodes.where("not is_external").select("id", "file_path")
    e = graph.edges.where("kind = 'imports'").join(own.select(F.col("id").alias("from_id"), F.col("file_path").alias("a")), "from_id").join(own.select(F.col("id").alias("to_id"), F.col("file_path").alias("b")), "to_id")
    cc = connected_components(e.select("a", "b"), "a", "b").withColumnRenamed("id", "file_path")
    return graph.nodes.where("kind = 'file' and not is_external").select("file_path").distinct().join(cc, "file_path", "left").select("file_path", F.coalesce("component", "file_path").alias("component"))


# --- given a partition: members (id, community)
def _between(graph: Graph, members: DataFrame) -> DataFrame:
    """x, has_x, y, has_y, n: edges counted by the communities of their ends; has_: whether that end is a member at all.

    Each edge is shuffled once for each of its ends, with its two ids only.
    """
    of = lambda c, x: members.select(F.col("id").alias(c), F.col("community").alias(x), F.lit(True).alias(f"has_{x}"))
    e = graph.edges.select("from_id", "to_id").join(of("from_id", "x"), "from_id", "left").join(of("to_id", "y"), "to_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return e.groupBy("x", no("has_x"), "y", no("has_y")).agg(F.count("*").alias("n"))


def cohesion(graph: Graph, members: DataFrame) -> DataFrame:
    """community, size, internal, external, cohesion; 1 for fewer than two members or no edges."""
    end = lambda x, y: F.struct(F.col(x).alias("community"), F.col(f"has_{x}").alias("has"), F.coalesce(F.col(x) == F.col(y), F.lit(False)).alias("same"))
    ends = _between(graph, members).select("n", F.inline(F.array(end("x", "y"), end("y", "x")))).where("has")
    seen = ends.groupBy("community").agg(F.floor(F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)) / 2).alias("internal"), F.sum(F.when(F.col("same"), 0).otherwise(F.col("n"))).alias("external"))
    size = members.groupBy("community").agg(F.count("*").alias("size"))
    z = size.join(seen, "community", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("internal", "external")})
    value = F.when((F.col("size") < 2) | (F.col("internal") + F.col("external") == 0), 1.0).otherwise(F.col("internal") / F.nullif(F.col("internal") + F.col("external"), F.lit(0)))
    return z.withColumn("cohesion", value)


def coupling(graph: Graph, members: DataFrame) -> DataFrame:
    """a < b, edges: edges between two communities."""
    e = _between(graph, members).where("x != y")
    return e.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("n").alias("edges")).orderBy(F.desc("edges"), "a", "b")


def hubs(graph: Graph, members: DataFrame, limit: int = 5) -> DataFrame:
    """community, id, name, fan_in: the most called and imported nodes of each community."""
    n = graph.nodes.where(F.col("kind").isin("file", "class", "function", "method") & ~F.col("is_external")).select("id", "name").join(members, "id")
    d = n.join(degrees(graph, ["calls", "imports"]).where("fan_in > 0").select("id", "fan_in"), "id")
    best = W.partitionBy("community").orderBy(F.desc("fan_in"), "id")
    return d.withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit).select("community", "id", "name", F.col("fan_in").cast("bigint").alias("fan_in"))


def dominant_language(graph: Graph, members: DataFrame) -> DataFrame:
    """community, language: the most frequent; ties to the first by name; null where no node has one."""
    c = graph.nodes.select("id", "language").join(members, "id").groupBy("community", "language").agg(F.count("*").alias("n"))
    best = F.min_by("language", F.when(F.col("language").isNotNull(), F.struct(-F.col("n"), "language")))
    return c.groupBy("community").agg(best.alias("language"))


def roles(graph: Graph, members: DataFrame) -> DataFrame:
    """community, role: the first role one of whose patterns a path matches."""
    paths = graph.nodes.select("id", F.lower("file_path").alias("p")).join(members, "id")
    any_ = paths.groupBy("community").agg(*[F.bool_or(F.col("p").rlike(rx)).alias(r) for r, rx in ROLES])
    out = F.lit("unknown")
    for r, _ in reversed(ROLES):
        out = F.when(F.col(r), r).otherwise(out)
    return any_.select("community", out.alias("role"))


def names(graph: Graph, members: DataFrame) -> DataFrame:
    """community, label: last common directory, else a class if those prevail, else the commonest word, else cluster-n."""
    n = graph.nodes.select("id", "kind", "name", F.replace("file_path", F.lit("\\"), F.lit("/")).alias("p")).join(members, "id")
    dirs = n.select("community", F.slice(F.split("p", "/"), F.lit(1), F.size(F.split("p", "/")) - 1).alias("d"))
    size = n.groupBy("community").agg(F.count("*").alias("n"), F.avg(F.col("kind").isin("class", "interface").cast("int")).alias("share"), F.min_by("name", F.when(F.col("kind").isin("class", "interface"), F.struct("id"))).alias("first_class"))
    at = dirs.select("community", F.posexplode("d").alias("i", "part")).groupBy("community", "i").agg(F.countDistinct("part").alias("k"), F.count("*").alias("c"), F.min("part").alias("part"))
    at = at.join(size.select("community", "n"), "community").withColumn("same", (F.col("k") == 1) & (F.col("c") == F.col("n")))
    # the common prefix ends before the first place that differs
    first = at.groupBy("community").agg(F.min(F.when(~F.col("same"), F.col("i"))).alias("stop"))
    tail = at.join(first, "community").where("same and (stop is null or i < stop) and part != ''").groupBy("community").agg(F.max_by("part", "i").alias("tail"))
    words = n.select("community", F.explode(F.regexp_extract_all("name", F.lit("([A-Z]?[a-z]+)"), F.lit(1))).alias("w")).where(F.length("w") >= 3).groupBy("community", "w").agg(F.count("*").alias("c")).where("c >= 2")
    top = words.groupBy("community").agg(F.min_by("w", F.struct(-F.col("c"), "w")).alias("word"))
    joined = size.join(tail, "community", "left").join(top, "community", "left")
    label = F.coalesce(F.when(F.length("tail") > 2, F.col("tail")), F.when(F.col("share") > 0.4, F.col("first_class")), F.col("word"), F.concat(F.lit("cluster-"), F.col("n")))
    return joined.select("community", label.alias("label"))


def file_labels(files: DataFrame) -> DataFrame:
    """component, label from component, file_path: the base name of one file, the last of two common segments, else a count."""
    p = files.select("component", F.split("file_path", r"[/\\]").alias("s"))
    size = p.groupBy("component").agg(F.count("*").alias("n"), F.min("s").alias("one"))
    at = p.select("component", F.posexplode("s").alias("i", "part")).groupBy("component", "i").agg(F.countDistinct("part").alias("k"), F.count("*").alias("c"), F.min("part").alias("part")).join(size.select("component", "n"), "component")
    at = at.withColumn("same", (F.col("k") == 1) & (F.col("c") == F.col("n")))
    stop = at.groupBy("component").agg(F.coalesce(F.min(F.when(~F.col("same"), F.col("i"))), F.max("i") + 1).alias("stop"))
    last = at.join(stop, "component").where("i = stop - 1 and stop >= 2").select("component", F.col("part").alias("last"))
    out = F.when(F.col("n") == 1, F.element_at("one", -1)).otherwise(F.coalesce("last", F.concat(F.lit("cluster-"), "n", F.lit("-files"))))
    return size.join(last, "component", "left").select("component", out.alias("label"))


def health(n_cycles: int, n_orphans: int, n_heavy: int, largest: int, n_files: int) -> tuple[int, list[str]]:
    """Score and notes; lists are counted as capped by their makers (5 cycles, 10 orphans)."""
    cycles, lone = min(n_cycles, 5), min(n_orphans, 10)
    notes = [f"{cycles} circular dependencies"] * bool(cycles) + [f"{lone} files without connections"] * bool(lone)
    notes += ["more than half of all files are in one community"] * (largest > n_files * 0.5) + [f"{n_heavy} pairs of communities share more than ten edges"] * bool(n_heavy)
    return max(0, 100 - 10 * cycles - 2 * lone - 5 * n_heavy - 15 * (largest > n_files * 0.7)), notes


def overview(graph: Graph, members: DataFrame) -> dict:
    """Layers, cycles, orphans, coupling, health of a partition."""
    from lodegraph.operators import graph as ops

    cyc = ops.cycle_members(graph).select("cycle").distinct().count()
    lone = ops.orphans(graph).orderBy("name", "id").limit(10).select("file_path")
    pairs = materialise(coupling(graph, members), "coupling")
    largest = members.groupBy("community").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    files = graph.nodes.where("kind = 'file'").count()
    score, notes = health(cyc, lone.count(), pairs.where("edges > 10").count(), largest, files)
    return {"layers": ops.layers(graph).limit(20), "n_cycles": cyc, "orphans": lone, "coupling": pairs.orderBy(F.desc("edges"), "a", "b").limit(20), "score": score, "notes": notes, "files": files}


def persist(graph: Graph, members: DataFrame, created_at: int = 0) -> tuple[DataFrame, DataFrame]:
    """(communities table, nodes with community_id): nodes as assigned, ids counted by size."""
    size = members.groupBy("community").agg(F.count("*").cast("int").alias("size"))
    c = cohesion(graph, members).select("community", "cohesion")
    rows = size.join(c, "community").join(names(graph, members), "community").join(roles(graph, members), "community").join(dominant_language(graph, members), "community")
    numbered = materialise(rows.withColumn("id", F.row_number().over(W.orderBy(F.desc("size"), "community")).cast("bigint")), "communities")
    note = F.concat("role", F.lit(" community with "), "size", F.lit(" nodes"))
    table = numbered.select("id", F.col("label").alias("name"), F.lit(0).alias("level"), F.lit(None).cast("bigint").alias("parent_id"), "cohesion", "size", F.col("language").alias("dominant_language"), note.alias("description"), F.lit(created_at).cast("bigint").alias("created_at"))
    ids = members.join(numbered.select("community", F.col("id").alias("community_id")), "community").select("id", "community_id")
    return table, graph.nodes.drop("community_id").join(ids, "id", "left")
