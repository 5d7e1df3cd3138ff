"""Graph tables and metrics (G1-G18) as DataFrame rounds; every round is written to the shared folder to cut the lineage."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.components import connected_components
from corvane.operators.cycles import dependency_cycles, longest_layers
from corvane.operators.paths import numbered, path_loads, tiled
from corvane.operators.registry import with_ids
from corvane.session import free, written

# The ontology's vocabulary and its version.
VERSION = "1.0.0"
RELATIONS = ("CONTAINS", "DECLARES", "IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "DEPENDS_ON", "MODIFIES", "REFERENCES", "RESOLVES", "RELEASE_INCLUDES", "PARENT_OF", "AUTHORED", "REVIEWED", "PART_OF_SUBSYSTEM", "ABOUT", "DERIVED_FROM", "IMPLEMENTED_BY", "AFFECTS", "RECOMMENDED_BEFORE", "RELATED_TO")
ENTITIES = ("repository", "repository_snapshot", "directory", "file", "symbol", "external_dependency", "issue", "pull_request", "commit", "release", "discussion", "person", "label", "graph_metric", "contributor_metric", "subsystem", "topic", "decision", "learning_step", "architecture_summary")
KINDS = ("deterministic", "derived", "inferred")
#: Rounds after which an accumulated union is written anew, so that plans stay short at any depth.
COMPACT = 8
#: Neighbours of a node in one row.
PACK = 4096


def nodes(df: DataFrame, entity_type: str, key: Column, name: Column, kind: str = "deterministic", confidence: float = 1.0) -> DataFrame:
    """Rows of one entity kind as graph nodes (G1)."""
    return df.select(F.concat_ws(":", F.lit(entity_type), key.cast("string")).alias("node_key"), F.lit(entity_type).alias("entity_type"), name.cast("string").alias("name"), F.lit(kind).alias("knowledge_kind"), F.lit(confidence).alias("confidence"))


def edges(df: DataFrame, relation: str, source_type: str, source: Column, target_type: str, target: Column, kind: str = "deterministic") -> DataFrame:
    """Rows of one relation as graph edges."""
    key = lambda t, c: F.concat_ws(":", F.lit(t), c.cast("string"))
    ends = df.select(source.alias("source"), target.alias("target")).distinct()  # before they are text, so numbers are shuffled
    return ends.select(key(source_type, F.col("source")).alias("source_key"), key(target_type, F.col("target")).alias("target_key"), F.lit(relation).alias("relationship_type"), F.lit(kind).alias("knowledge_kind"))


def union(*frames: DataFrame) -> DataFrame:
    """U2."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unknown_entities(node_table: DataFrame) -> DataFrame:
    """Nodes of a type that the ontology doesn't have."""
    return node_table.where(~F.coalesce(F.col("entity_type").isin(*ENTITIES), F.lit(False)))


def validate_graph(node_table: DataFrame, edge_table: DataFrame, pairs: DataFrame, self_loops: tuple[str, ...] = ("RELATED_TO",), evidence: DataFrame | None = None) -> DataFrame:
    """Edges with reject_reason, null if valid.

    ``pairs`` has the allowed (relationship_type, source_type, target_type). Reasons in order: unknown relation, missing
    source, missing target, self-loop, unknown entity type, pair of types; then, where ``edge_table`` has the columns, an inferred edge
    without confidence or without provenance, and a confirmed one that ``evidence`` (source_key, target_key) doesn't have.
    """
    kinds = node_table.select("node_key", "entity_type")
    out = edge_table.join(kinds.select(F.col("node_key").alias("source_key"), F.col("entity_type").alias("source_type")), "source_key", "left")
    out = out.join(kinds.select(F.col("node_key").alias("target_key"), F.col("entity_type").alias("target_type")), "target_key", "left")
    out = out.join(pairs.withColumn("allowed", F.lit(True)), ["relationship_type", "source_type", "target_type"], "left")
    reason = (
        F.when(~F.col("relationship_type").isin(*RELATIONS), "unknown_relation")
        .when(F.col("source_type").isNull(), "missing_source")
        .when(F.col("target_type").isNull(), "missing_target")
        .when((F.col("source_key") == F.col("target_key")) & ~F.col("relationship_type").isin(*self_loops), "self_loop")
        .when(~F.col("source_type").isin(*ENTITIES) | ~F.col("target_type").isin(*ENTITIES), "unknown_entity_type")
        .when(F.col("allowed").isNull(), "pair_not_allowed")
    )
    inferred = F.col("knowledge_kind") == "inferred"
    for column in ("confidence", "provenance"):
        if column in edge_table.columns:
            reason = reason.when(inferred & F.col(column).isNull(), f"inferred_without_{column}")
    if evidence is not None:
        proof = evidence.select("source_key", "target_key").distinct().withColumn("proven", F.lit(True))
        out = out.join(proof, ["source_key", "target_key"], "left")
        reason = reason.when((F.col("status") == "confirmed") & F.col("proven").isNull(), "confirmed_without_evidence")
    return out.select(*edge_table.columns, reason.alias("reject_reason"))


def both_ways(edge_table: DataFrame) -> DataFrame:
    """(node, other) of each undirected edge, both ways, once; self-loops left out."""
    way = edge_table.where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("other"))
    return way.unionByName(way.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()


def vertex_set(edge_table: DataFrame) -> DataFrame:
    return edge_table.select(F.col("src").alias("node")).union(edge_table.select("dst")).distinct()


def degree_centrality(edge_table: DataFrame) -> DataFrame:
    """In, out and total degree, and the total over the number of other nodes."""
    sides = edge_table.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edge_table.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    out = sides.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    total = out.agg(F.count(F.lit(1)).alias("n"))  # one row
    ratio = F.when(F.col("n") > 1, (F.col("in_degree") + F.col("out_degree")) / (F.col("n") - 1)).otherwise(0.0)
    return out.crossJoin(F.broadcast(total)).select("node", "in_degree", "out_degree", F.round(ratio, 8).alias("centrality"))


def packed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, ``value`` + s), written: the number of a key's rows, and their values in one array, or in several of about ``PACK`` where there are more."""
    sizes = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    lot = F.pmod(F.xxhash64(value), F.ceil(F.col("n") / PACK))
    out = written(rows.join(sizes, key).groupBy(key, "n", lot.alias("lot")).agg(F.collect_list(value).alias(f"{value}s")).drop("lot"))
    free(sizes)
    return out


def pagerank(edge_table: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """``rounds`` rounds from equal ranks; the mass of nodes without successors is spread evenly. Ranks sum to 1."""
    links = packed(written(edge_table.select("src", "dst").distinct()), "src", "dst")
    all_nodes = written(vertex_set(edge_table))
    n = all_nodes.count()
    if not n:
        return all_nodes.withColumn("rank", F.lit(0.0))
    ranks = all_nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        spread = links.join(ranks.withColumnRenamed("node", "src"), "src").select(F.explode("dsts").alias("dst"), (F.col("rank") / F.col("n")).alias("part"))
        got = written(spread.groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("got")))
        held = 1.0 - (got.agg(F.sum("got")).first()[0] or 0.0)
        ranks = written(all_nodes.join(got, "node", "left").select("node", (F.lit((1 - damping + damping * held) / n) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank")), ranks)
        free(got)
    return ranks


def communities(edge_table: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, label, settled) after ``rounds`` rounds of synchronous label propagation, or earlier if nothing changes any more.

    Each node takes the most frequent label around it and its own, ties to the smallest. ``settled`` says whether the last
    round left the node's label alone; synchronous labels may swing for ever, so rounds are a parameter, not a bound on data.
    """
    rows = both_ways(edge_table).where("node is not null and other is not null")
    around = packed(written(rows), "other", "node")
    labels = written(vertex_set(edge_table).where("node is not null").select("node", F.col("node").alias("label"), F.lit(False).alias("settled")))
    low, high, ends = *labels.agg(F.min("label"), F.max("label")).first(), around.agg(F.max("n")).first()[0]
    room = 62 - ((ends or 0) + 1).bit_length()  # votes and label share a number where they fit, and numbers are added up faster than structs
    if low is not None and 0 <= low and high < 1 << room:
        rate, of = F.shiftleft("votes", room) + (F.lit((1 << room) - 1) - F.col("label")), lambda best: F.lit((1 << room) - 1) - best.bitwiseAND(F.lit((1 << room) - 1))
    else:
        rate, of = F.struct("votes", (-F.col("label")).alias("low")), lambda best: -best["low"]
    for _ in range(rounds):
        votes = around.join(labels.select(F.col("node").alias("other"), "label"), "other").select(F.explode("nodes").alias("node"), "label")
        votes = votes.unionByName(labels.select("node", "label")).repartition("node")  # both sums and the join below stay where they are
        counts = votes.groupBy("node", "label").agg(F.count(F.lit(1)).alias("votes"))
        best = counts.groupBy("node").agg(F.max(rate).alias("best")).select("node", of(F.col("best")).alias("label"))
        was = labels.select("node", F.col("label").alias("was"))
        labels = written(best.join(was, "node").select("node", "label", (F.col("label") == F.col("was")).alias("settled")), labels)
        if labels.where("not settled").isEmpty():
            break
    free(around)
    return labels


def bridge_nodes(edge_table: DataFrame, labels: DataFrame, least: int = 2) -> DataFrame:
    """Nodes with neighbours in ``least`` or more communities other than their own."""
    own = labels.select("node", F.col("label").alias("own"))
    near = both_ways(edge_table).join(labels.withColumnRenamed("node", "other"), "other").join(own, "node").where("label <> own")
    return near.groupBy("node").agg(F.count_distinct("label").alias("n_communities")).where(F.col("n_communities") >= least)


def co_change(commit_files: DataFrame, min_support: int = 2, large: int = 1000, blocks: int = 32) -> DataFrame:
    """(file_a, file_b, support, confidence, lift) of file pairs changed together in ``min_support`` commits or more.

    Every commit counts. Pairs inside commits of more than ``large`` files are not all listed: those that a smaller commit has,
    too, are looked up, and others can only be of files in ``min_support`` large commits; these are joined in ``blocks``.
    """
    rows = written(commit_files.select("sha", "file_id").where("sha is not null").distinct())
    total = rows.agg(F.count_distinct("sha").alias("n_commits"))  # one row
    each = written(rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")))
    able = written(rows.join(each.where(F.col("n") >= min_support), "file_id", "left_semi"))
    mass = able.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("sha")
    big = written(able.join(mass, "sha", "left_semi"))
    usual = able.join(mass, "sha", "left_anti")
    support = F.count(F.lit(1)).alias("support")
    pairs = usual.select("sha", F.col("file_id").alias("file_a")).join(usual.select("sha", F.col("file_id").alias("file_b")), "sha").where("file_a < file_b").groupBy("file_a", "file_b").agg(support)
    if not big.isEmpty():
        few = written(pairs)
        more = few.select("file_a", "file_b").join(big.select("sha", F.col("file_id").alias("file_a")), "file_a").join(big.select("sha", F.col("file_id").alias("file_b")), ["sha", "file_b"]).groupBy("file_a", "file_b").agg(support)
        again = big.join(big.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support), "file_id", "left_semi")
        a = again.select("sha", F.col("file_id").alias("file_a"), F.pmod(F.xxhash64("file_id"), F.lit(blocks)).alias("block"))
        b = again.select("sha", F.col("file_id").alias("file_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        only = a.join(b, ["sha", "block"]).where("file_a < file_b").groupBy("file_a", "file_b").agg(support).join(few, ["file_a", "file_b"], "left_anti")
        pairs = few.unionByName(more).groupBy("file_a", "file_b").agg(F.sum("support").alias("support")).unionByName(only)
    pairs = pairs.where(F.col("support") >= min_support)
    out = pairs.join(each.select(F.col("file_id").alias("file_a"), F.col("n").alias("n_a")), "file_a").join(each.select(F.col("file_id").alias("file_b"), F.col("n").alias("n_b")), "file_b").crossJoin(F.broadcast(total))
    return out.select("file_a", "file_b", "support", F.round(F.col("support") / F.col("n_a"), 6).alias("confidence"), F.round(F.col("support") * F.col("n_commits") / (F.col("n_a") * F.col("n_b")), 6).alias("lift"))


def neighbors(seeds: DataFrame, edge_table: DataFrame, depth: int = 3, limit: int | None = 500, where: Column | None = None) -> DataFrame:
    """(seed, node, depth) within ``depth`` directed steps over the edges that fulfil ``where``; of each seed the first ``limit`` by (depth, node)."""
    edge_table = edge_table if where is None else edge_table.where(where)
    if not 1 <= depth <= 3:
        raise ValueError("depth from 1 to 3")
    seen = written(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct())
    edge, step = seen, edge_table.select("src", "dst").distinct()
    for d in range(1, depth + 1):
        new = edge.join(step, edge.node == step.src).select("seed", F.col("dst").alias("node"), F.lit(d).alias("depth")).distinct()
        edge = written(new.join(seen.select("seed", "node"), ["seed", "node"], "left_anti"))
        seen = seen.unionByName(edge)
    if limit is None:
        return seen
    place = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))
    return seen.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def subgraph(node_table: DataFrame, edge_table: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes that fulfil ``predicate`` and the edges between them."""
    kept = node_table.where(predicate)
    keys = kept.select("node")
    return kept, edge_table.join(keys.withColumnRenamed("node", "src"), "src", "left_semi").join(keys.withColumnRenamed("node", "dst"), "dst", "left_semi")


def shortest_paths(source: int, edge_table: DataFrame) -> DataFrame:
    """(node, depth, parent) of each node that ``source`` reaches, at any depth; of several parents the smallest."""
    step = written(edge_table.select("src", "dst").distinct())
    seen = written(step.sparkSession.range(1).select(F.lit(source).cast("long").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")))
    edge, d = seen, 0
    while not edge.isEmpty():
        d += 1
        new = edge.select(F.col("node").alias("src")).join(step, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        edge = written(new.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), "parent"))
        seen = seen.unionByName(edge)
        if d % COMPACT == 0:
            seen = written(seen)
    return seen


def path_to(target: int, tree: DataFrame) -> DataFrame:
    """The edges (step, src, dst) from the source of ``tree`` to ``target``, walked back a depth at a time."""
    tree = written(tree)
    last = tree.where(F.col("node") == target).select(F.col("depth").alias("step"), F.col("parent").alias("src"), F.col("node").alias("dst"))
    depth = last.agg(F.max("step")).first()[0] or 0
    out, edge = last, last
    for d in range(depth - 1, 0, -1):
        edge = tree.where(F.col("depth") == d).join(edge.select(F.col("src").alias("node")), "node").select(F.col("depth").alias("step"), F.col("parent").alias("src"), F.col("node").alias("dst"))
        out = out.unionByName(edge)
        if d % COMPACT == 0:
            edge, out = written(edge), written(out)
    return out.where("src is not null")


def paths_unproven(paths: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Steps of paths that are no stored edge."""
    return paths.join(edge_table.select("src", "dst"), ["src", "dst"], "left_anti")


def betweenness(edge_table: DataFrame, pivots: DataFrame) -> DataFrame:
    """Betweenness summed over the shortest paths of any length from the ``pivots`` (node) only; an estimate unless they are all nodes."""
    step = written(edge_table.select("src", "dst").distinct())
    total = path_loads(step, numbered(vertex_set(step)), pivots)
    if total is None:
        return step.select(F.col("src").alias("node"), F.lit(0.0).alias("betweenness")).limit(0)
    return total.select("node", F.col("s").alias("betweenness"))


def betweenness_within(edge_table: DataFrame, tolerance: float, delta: float = 0.1, first: int = 64, block: int = 256) -> DataFrame:
    """(node, betweenness, error, n_pivots) for every node, as a share (0 to 1) of the ordered pairs of other nodes.

    Pivots come in an order drawn from a hash of the node, first ``first``, then twice as many each time, until every ``error`` is at most
    ``tolerance`` or all nodes are pivots (then the values are exact and the errors 0). With a probability of ``1 - delta`` no node in
    any of the samples is off by more than its error: the smaller of the bounds of Hoeffding and of Bernstein (with the variance seen) for samples
    drawn without repeats (Bardenet and Maillard 2015), each at ``delta`` shared evenly over nodes, samples and both. ``block`` pivots are searched at
    a time, so a block keeps ``block`` values a node, of which two sums are left. Without edges there are no rows.
    """
    step = written(edge_table.where("src <> dst").select("src", "dst").distinct())
    order = written(with_ids(vertex_set(edge_table).where("node is not null").withColumn("drawn", F.xxhash64("node")), ["drawn", "node"], id_col="place").select("node", "place"))
    n = order.count()
    if n < 3:
        return order.select("node", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("error"), F.lit(n).cast("long").alias("n_pivots"))
    places = numbered(order.select("node"))
    tiles = tiled(step, places)
    samples = math.ceil(math.log2(max(n / first, 1))) + 1
    share, scale = delta / (2 * n * samples), n / (n - 1)
    sums, done, k = order.select("node", F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), 0, min(first, n)
    while True:
        for at in range(done, k, block):
            got = path_loads(step, places, order.where(F.col("place").between(at + 1, min(at + block, k))).select("node"), tiles=tiles)
            if got is not None:
                got = got.select("node", (F.col("s") / (n - 2)).alias("s"), (F.col("q") / (n - 2) ** 2).alias("q"))
                sums = written(sums.unionByName(got).groupBy("node").agg(F.sum("s").alias("s"), F.sum("q").alias("q")), sums)
        rest = 1 - (k - 1) / n if 2 * k <= n else (1 - k / n) * (1 + 1 / k)
        mean = F.col("s") / k
        spread = F.sqrt(F.greatest(F.col("q") / k - mean * mean, F.lit(0.0)))
        bernstein = spread * math.sqrt(2 * rest * math.log(10 / share) / k) + (7 / 3 + 3 / math.sqrt(2)) * math.log(10 / share) / k
        error = F.least(bernstein, F.lit(math.sqrt(rest * math.log(2 / share) / (2 * k))), F.lit(1.0)) * scale if k < n else F.lit(0.0)
        out = sums.select("node", (mean * scale).alias("betweenness"), error.alias("error"), F.lit(k).cast("long").alias("n_pivots"))
        if k == n or out.agg(F.max("error")).first()[0] <= tolerance:
            return out
        done, k = k, min(2 * k, n)


def learning_order(edge_table: DataFrame) -> DataFrame:
    """(node, layer) where what a node depends on comes in an earlier layer; nodes on a cycle share their group's layer."""
    groups = dependency_cycles(edge_table).select("node", F.col("component").alias("grp"))
    of = written(vertex_set(edge_table).join(groups, "node", "left").select("node", F.coalesce("grp", "node").alias("grp")))
    step = edge_table.join(of.select(F.col("node").alias("src"), F.col("grp").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("grp").alias("b")), "dst").where("a <> b")
    layers = longest_layers(of.select(F.col("grp").alias("node")).distinct(), step.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return of.join(layers.select(F.col("node").alias("grp"), F.col("layer").cast("int").alias("layer")), "grp").select("node", "layer")


def learning_places(layers: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, layer, place): rows of ``learning_order`` numbered from 1 by layer, then from the highest rank (node, rank), then by node."""
    order = layers.join(ranks, "node").select("node", "layer", (-F.round("rank", 8)).alias("low"))
    return with_ids(order, ["layer", "low", "node"], id_col="place").select("node", "layer", "place")


def subsystem_edges(edge_table: DataFrame, membership: DataFrame) -> DataFrame:
    """(src_subsystem, dst_subsystem, n_edges) between different subsystems."""
    a = membership.select(F.col("file_id").alias("src"), F.col("subsystem").alias("src_subsystem"))
    b = membership.select(F.col("file_id").alias("dst"), F.col("subsystem").alias("dst_subsystem"))
    return edge_table.join(a, "src").join(b, "dst").where("src_subsystem <> dst_subsystem").groupBy("src_subsystem", "dst_subsystem").agg(F.count(F.lit(1)).alias("n_edges"))


def subsystem_quality(edge_table: DataFrame, membership: DataFrame) -> DataFrame:
    """Per subsystem inner and crossing edges, cohesion, separation and its part of the modularity."""
    a = membership.select(F.col("file_id").alias("src"), F.col("subsystem").alias("sa"))
    b = membership.select(F.col("file_id").alias("dst"), F.col("subsystem").alias("sb"))
    both = edge_table.join(a, "src").join(b, "dst")
    ends = both.select(F.col("sa").alias("subsystem"), (F.col("sa") == F.col("sb")).cast("int").alias("inner")).unionByName(both.select(F.col("sb").alias("subsystem"), (F.col("sa") == F.col("sb")).cast("int").alias("inner")))
    out = ends.groupBy("subsystem").agg((F.sum("inner") / 2).alias("n_inner"), F.sum(1 - F.col("inner")).alias("n_crossing"), F.count(F.lit(1)).alias("ends"))
    total = both.agg(F.count(F.lit(1)).alias("m"))  # one row
    out = out.crossJoin(F.broadcast(total))
    cohesion = F.col("n_inner") / (F.col("n_inner") + F.col("n_crossing"))
    modularity = F.col("n_inner") / F.col("m") - (F.col("ends") / (2 * F.col("m"))) ** 2
    return out.select("subsystem", F.col("n_inner").cast("long").alias("n_inner"), "n_crossing", F.round(cohesion, 6).alias("cohesion"), F.round(1 - cohesion, 6).alias("crossing_share"), F.round(modularity + 1e-12, 6).alias("modularity"))


def stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """(subsystem, kept, added, lost, jaccard) of members (subsystem, file_id) between two snapshots."""
    a, b = before.distinct().withColumn("was", F.lit(1)), after.distinct().withColumn("is", F.lit(1))
    both = a.join(b, ["subsystem", "file_id"], "full_outer").fillna(0, ["was", "is"])
    out = both.groupBy("subsystem").agg(F.sum(F.col("was") * F.col("is")).alias("kept"), F.sum(F.col("is") * (1 - F.col("was"))).alias("added"), F.sum(F.col("was") * (1 - F.col("is"))).alias("lost"))
    return out.withColumn("jaccard", F.round(F.col("kept") / (F.col("kept") + F.col("added") + F.col("lost")), 6))


def persist_metrics(metrics: dict[str, DataFrame], version: str = VERSION) -> DataFrame:
    """Frames of (node, value) as one long table (node, metric, value, algorithm_version)."""
    return union(*(df.select("node", F.lit(m).alias("metric"), F.col("value").cast("double").alias("value"), F.lit(version).alias("algorithm_version")) for m, df in metrics.items()))


def components(edge_table: DataFrame) -> DataFrame:
    """G4."""
    return connected_components(edge_table)
