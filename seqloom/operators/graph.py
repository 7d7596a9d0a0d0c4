"""Fragment graphs as tables.

nodes: graph_id, node_id, fragment, weight, headtail (1 starts a sequence, 2 ends one), coord
edges: graph_id, src, dst, weight
occurrence: graph_id, node_id, seq_ord, site (place of the fragment's last symbol)
lineage: node_id, src_graph, src_node

Merging nodes is one group-by, re-keying edges two joins with the mapping; ties go to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.profile import windows


def flagged_windows(seqs: DataFrame, k: int, *columns: str) -> DataFrame:
    """Windows with headtail: 1 at the start of a sequence, 2 at its end, 3 if it has only one."""
    head = F.when(F.col("pos") == 0, 1).otherwise(0) + F.when(F.col("pos") == F.col("last"), 2).otherwise(0)
    return windows(seqs, k, *columns).withColumn("headtail", head.cast("int"))


def node_key(*columns) -> Column:
    """A node's id from what makes it one node."""
    return F.xxhash64(*columns)


def chain_nodes(seqs: DataFrame, k: int, graph: str = "graph_id") -> DataFrame:
    """Nodes of the graph in which every sequence is a chain and equal fragments at equal places are one node."""
    rows = flagged_windows(seqs, k, graph)
    return rows.groupBy(graph, "fragment", "headtail", (F.col("pos") + 1).alias("coord")).agg(F.count(F.lit(1)).alias("weight")).withColumn(
        "node_id", node_key("fragment", "headtail", "coord")
    )


def chain_paths(seqs: DataFrame, k: int, graph: str = "graph_id") -> DataFrame:
    """graph_id, seq_ord, pos, node_id."""
    rows = flagged_windows(seqs, k, graph)
    return rows.select(graph, "seq_ord", "pos", node_key("fragment", "headtail", F.col("pos") + 1).alias("node_id"))


def chain_edges(seqs: DataFrame, k: int, graph: str = "graph_id") -> DataFrame:
    """Edges between consecutive windows, by how often they are walked.

    The window before comes from the same row's text, not from a sort: k + 1 symbols make an edge.
    """
    rows = windows(seqs, k + 1, graph)
    head = F.when(F.col("pos") == 0, 1).otherwise(0)
    tail = F.when(F.col("pos") == F.col("last"), 2).otherwise(0)
    src = node_key(F.substring("fragment", 1, k), head.cast("int"), F.col("pos") + 1)
    dst = node_key(F.substring("fragment", 2, k), tail.cast("int"), F.col("pos") + 2)
    return rows.select(graph, src.alias("src"), dst.alias("dst")).groupBy(graph, "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def occurrences(paths: DataFrame, k: int) -> DataFrame:
    return paths.select("graph_id", "node_id", "seq_ord", (F.col("pos") + k - 1).alias("site"))


def fragment_index(nodes: DataFrame) -> DataFrame:
    """Candidates of each fragment by role (start, end, inner)."""
    role = F.when(F.col("headtail").bitwiseAND(F.lit(1)) != 0, "start").when(F.col("headtail").bitwiseAND(F.lit(2)) != 0, "end").otherwise("inner")
    return nodes.groupBy("graph_id", "fragment", role.alias("role")).agg(F.count(F.lit(1)).alias("candidates"), F.max("weight").alias("heaviest"))


def heaviest_anchors(candidates: DataFrame, *key: str) -> DataFrame:
    """The one heaviest candidate of each key; none if several tie."""
    top = candidates.groupBy(*key).agg(F.max("weight").alias("w"))
    rows = candidates.join(top, list(key)).where(F.col("weight") == F.col("w"))
    chosen = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("ties"), F.min("node_id").alias("node_id"), F.min("coord").alias("coord"))
    return chosen.where("ties = 1").drop("ties")


def merge_equivalent(nodes: DataFrame, edges: DataFrame, coord: str = "coord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of equal graph, fragment, headtail and coordinate become the smallest of them.

    Gives nodes, edges and the mapping (graph_id, old, node_id).
    """
    key = ["graph_id", "fragment", "headtail", coord]
    survivors = nodes.groupBy(*key).agg(F.min("node_id").alias("keeps"), F.sum("weight").alias("total"))
    mapping = nodes.join(survivors, key).select("graph_id", F.col("node_id").alias("old"), "keeps")
    merged = survivors.select("graph_id", F.col("keeps").alias("node_id"), "fragment", F.col("total").alias("weight"), "headtail", coord)
    return merged, rekey_edges(edges, mapping), mapping.withColumnRenamed("keeps", "node_id")


def rekey_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between the nodes that the mapping (graph_id, old, keeps) names; weights add up."""
    a = mapping.select("graph_id", F.col("old").alias("src"), F.col("keeps").alias("new_src"))
    b = mapping.select("graph_id", F.col("old").alias("dst"), F.col("keeps").alias("new_dst"))
    rows = edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    return rows.groupBy("graph_id", F.col("new_src").alias("src"), F.col("new_dst").alias("dst")).agg(F.sum("weight").alias("weight"))


def compacted(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without nodes of weight 0 and edges that lost an end."""
    kept = nodes.where("weight > 0")
    ids = kept.select("graph_id", "node_id")
    edges = edges.join(ids.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi")
    return kept, edges.join(ids.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi")


def removed(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    return nodes.join(gone.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti")


def reduce_fragments(nodes: DataFrame, edges: DataFrame, k: int, m: int) -> tuple[DataFrame, DataFrame]:
    """Fragments of k symbols become their last m; each start node brings a chain of k - m nodes for the symbols before.

    Gives nodes with offset (0, or the distance from the start node) and edges.  m >= k changes nothing.
    """
    nodes = nodes.withColumn("offset", F.lit(0))
    if m >= k:
        return nodes, edges
    starts = nodes.where(F.col("headtail").bitwiseAND(F.lit(1)) != 0)
    chained = starts.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(k - m))))
    part = F.substring("fragment", F.lit(k - m + 1) - F.col("i"), F.lit(m))
    new = chained.select(
        "graph_id", node_key("node_id", "i").alias("node_id"), part.alias("fragment"), "weight",
        F.when(F.col("i") == k - m, F.lit(1)).otherwise(F.lit(0)).alias("headtail"), (F.col("coord") + k - m - F.col("i")).alias("coord"), F.col("i").alias("offset"),
    )
    before = F.when(F.col("i") == 1, F.col("node_id")).otherwise(node_key("node_id", F.col("i") - 1))
    links = chained.select("graph_id", node_key("node_id", "i").alias("src"), before.alias("dst"), "weight")
    own = nodes.select(
        "graph_id", "node_id", F.substring("fragment", k - m + 1, m).alias("fragment"), "weight",
        F.col("headtail").bitwiseAND(F.lit(2)).alias("headtail"), (F.col("coord") + k - m).alias("coord"), "offset",
    )
    return own.unionByName(new), edges.select("graph_id", "src", "dst", "weight").unionByName(links)


def union_graphs(nodes: DataFrame, pair: int = 2) -> DataFrame:
    """Nodes of each ``pair`` of neighbouring graphs united by fragment, headtail and coordinate; the odd one goes on alone."""
    pair_id = F.ceil(F.col("graph_id") / pair).cast("int")
    return nodes.groupBy(pair_id.alias("graph_id"), "fragment", "headtail", "coord").agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("sources"), F.min("node_id").alias("node_id")
    )


def lineage_of_union(nodes: DataFrame, pair: int = 2) -> DataFrame:
    """graph_id, node_id, src_graph, src_node of a union: where each node came from."""
    pair_id = F.ceil(F.col("graph_id") / pair).cast("int")
    return nodes.select(
        pair_id.alias("graph_id"), node_key("fragment", "headtail", "coord").alias("node_id"), F.col("graph_id").alias("src_graph"), F.col("node_id").alias("src_node")
    )


def composed_lineage(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Lineage over two unions: the upper's sources replaced by theirs in the lower."""
    below = lower.select(F.col("graph_id").alias("src_graph"), F.col("node_id").alias("src_node"), F.col("src_graph").alias("g"), F.col("src_node").alias("n"))
    return upper.join(below, ["src_graph", "src_node"]).select("graph_id", "node_id", F.col("g").alias("src_graph"), F.col("n").alias("src_node"))


def occurrence_lookup(lineage: DataFrame, occurrence: DataFrame) -> DataFrame:
    """Source places of merged nodes: graph_id, node_id, src_graph, seq_ord, site."""
    found = occurrence.select(F.col("graph_id").alias("src_graph"), F.col("node_id").alias("src_node"), "seq_ord", "site")
    return lineage.join(found, ["src_graph", "src_node"]).select("graph_id", "node_id", "src_graph", "seq_ord", "site")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In and out degree of every node."""
    out = edges.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n_in"))
    key = ["graph_id", "node_id"]
    return nodes.select(*key).join(out, key, "left").join(into, key, "left").fillna(0, ["n_out", "n_in"])


def stem_edges(nodes: DataFrame, edges: DataFrame, share: float) -> DataFrame:
    """Edges that carry more than ``share`` of both ends' weight."""
    w = nodes.select("graph_id", "node_id", F.col("weight").alias("w"))
    rows = edges.join(w.select("graph_id", F.col("node_id").alias("src"), F.col("w").alias("ws")), ["graph_id", "src"])
    rows = rows.join(w.select("graph_id", F.col("node_id").alias("dst"), F.col("w").alias("wd")), ["graph_id", "dst"])
    return rows.where((F.col("weight") > share * F.col("ws")) & (F.col("weight") > share * F.col("wd"))).select("graph_id", "src", "dst", "weight")


def heavy_nodes(nodes: DataFrame, sequences: Column, share: float) -> DataFrame:
    """Nodes that more than ``share`` of the sequences visit, by coordinate."""
    return nodes.where(F.col("weight") > sequences * share).orderBy("graph_id", "coord", "node_id")


def edge_prior(edges: DataFrame) -> DataFrame:
    """Share of each edge in what enters its target."""
    into = edges.groupBy("graph_id", "dst").agg(F.sum("weight").alias("w_in"))
    return edges.join(into, ["graph_id", "dst"]).select("graph_id", "src", "dst", (F.col("weight") / F.col("w_in")).alias("prior"))


def neighbours(edges: DataFrame, of: DataFrame, children: bool = True) -> DataFrame:
    """Distinct children (or parents) of a set of nodes, with the edge's weight added up."""
    near, far = ("src", "dst") if children else ("dst", "src")
    rows = edges.join(of.select("graph_id", F.col("node_id").alias(near)), ["graph_id", near], "left_semi")
    return rows.groupBy("graph_id", F.col(far).alias("node_id")).agg(F.sum("weight").alias("weight"))


def same_fragment_pairs(nodes: DataFrame, least_weight: float, distance: int) -> DataFrame:
    """Pairs of nodes of one fragment, close in coordinate, that hold more than half of the fragment's weight."""
    total = nodes.groupBy("graph_id", "fragment").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("rows"))
    rows = nodes.join(total.where((F.col("total") > least_weight) & (F.col("rows") > 1)), ["graph_id", "fragment"])
    # pairs in reach of one another: bucketed by distance, so each node meets two buckets
    bucket = F.floor(F.col("coord") / distance)
    a = rows.select("graph_id", "fragment", "total", F.col("node_id").alias("a"), F.col("coord").alias("ca"), F.col("weight").alias("wa"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    b = rows.select("graph_id", "fragment", F.col("node_id").alias("b"), F.col("coord").alias("cb"), F.col("weight").alias("wb"), bucket.alias("bucket"))
    near = a.join(b, ["graph_id", "fragment", "bucket"]).where((F.col("ca") <= F.col("cb")) & (F.col("a") != F.col("b")) & (F.col("cb") - F.col("ca") < distance))
    return near.where((F.col("ca") < F.col("cb")) | (F.col("a") < F.col("b"))).where(F.col("wa") + F.col("wb") > 0.5 * F.col("total")).select("graph_id", "a", "b")


# ---- rounds of joins; ``write`` puts a DataFrame into shared storage, which cuts the lineage after each round


def compact_ids(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of weight above 0, numbered from 0 within each graph in the order of their ids; edges between them; the mapping
    (graph_id, old, node_id).

    Numbering runs in two steps, within ranges of ids and over the ranges' counts, so no task sorts a whole graph.
    """
    kept = nodes.where("weight > 0").withColumn("range", F.shiftright("node_id", 48))
    counts = kept.groupBy("graph_id", "range").agg(F.count(F.lit(1)).alias("c"))
    ahead = Window.partitionBy("graph_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 2^16 ranges at most
    bases = counts.select("graph_id", "range", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("graph_id", "range").orderBy("node_id")) - 1
    numbered = kept.withColumn("place", place).join(bases, ["graph_id", "range"]).withColumn("new", F.col("base") + F.col("place"))
    mapping = numbered.select("graph_id", F.col("node_id").alias("old"), F.col("new").alias("node_id"))
    columns = [F.col("new").alias("node_id") if c == "node_id" else F.col(c) for c in nodes.columns]
    return numbered.select(*columns), rekey_edges(edges, mapping.withColumnRenamed("node_id", "keeps")), mapping


def layered(nodes: DataFrame, edges: DataFrame, write, forward: bool = True) -> DataFrame:
    """graph_id, node_id, level: longest-path level from 1, from the sources (or the sinks); as many rounds as there are levels."""
    near, far = ("src", "dst") if forward else ("dst", "src")
    level = write(nodes.select("graph_id", "node_id", F.lit(1).alias("level"), F.lit(True).alias("moved")))
    while True:
        at = level.where("moved").select("graph_id", F.col("node_id").alias(near), (F.col("level") + 1).alias("least"))
        pushed = edges.join(at, ["graph_id", near]).groupBy("graph_id", F.col(far).alias("node_id")).agg(F.max("least").alias("least"))
        moved = F.coalesce(F.col("least") > F.col("level"), F.lit(False))
        level = write(level.drop("moved").join(pushed, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.greatest("level", "least").alias("level"), moved.alias("moved")))
        if level.where("moved").isEmpty():
            return level.drop("moved")


def merge_to_fixpoint(nodes: DataFrame, edges: DataFrame, write) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of equal fragment, headtail and level become one, levels counted backward, then forward, until none are left.

    Gives nodes (coord: their level from the sources), edges, and the mapping (graph_id, old, node_id) of all nodes.
    """
    plain = [c for c in nodes.columns if c != "coord"]
    mapping = write(nodes.select("graph_id", F.col("node_id").alias("old"), "node_id"))
    nodes, edges = write(nodes.select(*plain)), write(edges)
    before = None
    while before != (before := nodes.count()):
        for forward in (False, True):
            placed = nodes.join(layered(nodes, edges, write, forward).withColumnRenamed("level", "coord"), ["graph_id", "node_id"])
            merged, links, step = merge_equivalent(placed, edges)
            after = step.select("graph_id", F.col("old").alias("node_id"), F.col("node_id").alias("new"))
            mapping = write(mapping.join(after, ["graph_id", "node_id"]).select("graph_id", "old", F.col("new").alias("node_id")))
            nodes, edges = write(merged.select(*plain)), write(links)
    placed = nodes.join(layered(nodes, edges, write).withColumnRenamed("level", "coord"), ["graph_id", "node_id"])
    return write(placed), edges, mapping


def reached(nodes: DataFrame, edges: DataFrame, sources: DataFrame, write, forward: bool = True, banned: DataFrame | None = None, step: Column | None = None) -> DataFrame:
    """graph_id, node_id, tag: nodes that the sources (graph_id, node_id, tag) lead to, themselves included, with each tag that
    comes there.  Banned nodes (graph_id, node_id) are not entered; ``step`` says of an edge (coord, next_coord) whether it is walked."""
    near, far = ("src", "dst") if forward else ("dst", "src")
    place = nodes.select("graph_id", "node_id", "coord")
    ways = edges.join(place.select("graph_id", F.col("node_id").alias(near), "coord"), ["graph_id", near])
    ways = ways.join(place.select("graph_id", F.col("node_id").alias(far), F.col("coord").alias("next_coord")), ["graph_id", far])
    if step is not None:
        ways = ways.where(step)
    if banned is not None:
        ways = ways.join(banned.select("graph_id", F.col("node_id").alias(far)), ["graph_id", far], "left_anti")
        sources = sources.join(banned.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti")
    ways = write(ways.select("graph_id", near, far))
    seen = front = write(sources.select("graph_id", "node_id", "tag").distinct())
    while not front.isEmpty():
        onward = front.join(ways.withColumnRenamed(near, "node_id"), ["graph_id", "node_id"]).select("graph_id", F.col(far).alias("node_id"), "tag").distinct()
        front = write(onward.join(seen, ["graph_id", "node_id", "tag"], "left_anti"))
        seen = write(seen.unionByName(front))
    return seen
