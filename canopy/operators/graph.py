"""Graph traversal: trees of any depth (H5) and the links between files and topics.

Every step is a join and a grouping of whole tables, written to the shared
folder before the next one, so a lost executor repeats one step at most.
A topic that holds a large share of all links is carried as one aggregated
row; where its value goes back to its links, its row is copied once for each
part of ``HOT_LINKS`` links, so no task meets all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.session import materialize

HOT_LINKS = 1_000_000   # links of one topic that one task takes


# ------------------------------------------------------------ trees

def closure(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """``ancestor_id, descendant_id, distance`` of a forest of any depth, every node with itself at 0.

    Pointer jumping: a node's chain of ancestors is continued by the chain of
    its last one, so chains double and a tree of depth d takes log2(d) rounds.
    A parent without a row of its own ends the chain and belongs to it.  On a
    cycle every other node of it is an ancestor, once, at its distance along the
    parents.  Rows without id are left out; of rows that repeat an id the least
    parent counts.  Empty table: no rows.
    """
    node, parent = F.col(id_col).alias("id"), F.col(parent_col).alias("parent")
    empty = F.array().cast("array<string>")
    chains = (nodes.select(node.cast("string").alias("id"), parent.cast("string").alias("parent")).where("id is not null")
              .groupBy("id").agg(F.min("parent").alias("parent"))
              .select("id", F.when(F.col("parent").isNull() | (F.col("parent") == F.col("id")), empty)
                      .otherwise(F.array("parent")).alias("chain"))
              .withColumn("open", F.size("chain") > 0))
    chains = materialize(chains, "closure")
    while not chains.where("open").isEmpty():
        onward = chains.select(F.col("id").alias("last"), F.col("chain").alias("more"), F.col("open").alias("goes_on"))
        # closed chains have no key, so they meet no row and no hot key
        last = F.when(F.col("open"), F.element_at("chain", -1))
        walked = F.concat("chain", F.coalesce("more", empty))
        fresh = F.array_remove(F.array_distinct(walked), F.col("id"))
        longer = (chains.withColumn("last", last).join(onward, "last", "left")
                  .select("id", fresh.alias("chain"),
                          (F.coalesce("goes_on", F.lit(False)) & (F.size(fresh) == F.size(walked))).alias("open")))
        chains = materialize(longer, "closure")
    return chains.select(F.posexplode(F.concat(F.array("id"), "chain")).alias("distance", "ancestor_id"),
                         F.col("id").alias("descendant_id")) \
        .select("ancestor_id", "descendant_id", "distance")


# ------------------------------------------------------------ files and topics

def _edges(links: DataFrame) -> DataFrame:
    """Distinct ``node_id, topic_id``; links that lack one of them say nothing."""
    return links.select("node_id", "topic_id").where("node_id is not null and topic_id is not null").distinct()


def hops(links: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``node_id, hops``: least number of shared topics to walk over from any seed.

    Breadth first: each round takes the frontier's topics that were not taken
    before, then their files, so every link is read into the frontier twice at
    most over the whole search, however large its topic.  It ends when a round
    finds no new file or after ``max_hops`` rounds.  Files out of reach have no
    row.  Seeds (``node_id``) without a link are reached at 0; null seeds and
    repeated ones count for nothing.  No seeds: no rows.
    """
    edges = materialize(_edges(links), "edges")
    frontier = materialize(seeds.select("node_id").where("node_id is not null").distinct()
                           .select("node_id", F.lit(0).alias("hops")), "frontier")
    reached, topics, n = frontier, None, 0
    while (max_hops is None or n < max_hops) and not frontier.isEmpty():
        n += 1
        near = edges.join(frontier, "node_id", "left_semi").select("topic_id").distinct()
        near = materialize(near if topics is None else near.join(topics, "topic_id", "left_anti"), "topics")
        topics = near if topics is None else topics.unionByName(near)
        found = edges.join(near, "topic_id", "left_semi").select("node_id").distinct()
        frontier = materialize(found.join(reached, "node_id", "left_anti")
                               .select("node_id", F.lit(n).alias("hops")), "frontier")
        reached = reached.unionByName(frontier)
    return reached


def walk_scores(links: DataFrame, seeds: DataFrame, restart: float = 0.15, tolerance: float = 1e-6,
                max_rounds: int = 100) -> DataFrame:
    """``node_id, score``: how often a random walk from the seeds stands on a file.

    A step goes from a file to one of its topics, then to one of that topic's
    files, each equally likely; with probability ``restart`` the walk starts
    again at a seed.  Rounds stop when no more than ``tolerance`` of the walk
    changes place; a round shrinks that by 1 - ``restart`` at least, which
    bounds their number.  Scores add up to 1.  Files that no walk reaches have
    no row, nor have seeds without a link (a walk could not leave them).  No seeds: no rows.
    """
    edges = materialize(_edges(links), "edges")
    of_file = edges.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_topics"))
    of_topic = edges.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_files"))
    of_topic = materialize(of_topic.withColumn("parts", _parts(F.col("n_files"))), "topics")
    weighted = _to_links(edges, of_topic).join(of_file, "node_id")
    weighted = materialize(weighted.select("node_id", "topic_id", "part", "n_topics"), "weighted")
    chosen = seeds.select("node_id").where("node_id is not null").distinct().join(of_file, "node_id", "left_semi")
    chosen = materialize(chosen, "start")
    start = chosen.withColumn("score", F.lit(1.0) / max(1, chosen.count()))
    scores = start
    for _ in range(max_rounds):
        given = weighted.join(scores, "node_id").groupBy("topic_id").agg(F.sum(F.col("score") / F.col("n_topics")).alias("held"))
        held = given.join(of_topic, "topic_id") \
            .select("topic_id", (F.col("held") / F.col("n_files")).alias("share"),
                    F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        walked = weighted.join(held, ["topic_id", "part"]).select("node_id", (F.col("share") * (1 - restart)).alias("new"))
        parts = walked.unionByName(start.select("node_id", (F.col("score") * restart).alias("new"))) \
            .groupBy("node_id").agg(F.sum("new").alias("score"))
        after = materialize(parts, "scores")
        moved = after.select("node_id", "score").unionByName(scores.select("node_id", (-F.col("score")).alias("score"))) \
            .groupBy("node_id").agg(F.abs(F.sum("score")).alias("d")).agg(F.sum("d").alias("d")).first()["d"]
        scores = after
        if moved is None or moved / 2 <= tolerance:
            break
    return scores


def _parts(n: Column) -> Column:
    return F.ceil(n / HOT_LINKS).cast("int")


def _to_links(edges: DataFrame, topics: DataFrame) -> DataFrame:
    """Each link with the part of its topic that it belongs to.

    Only topics of more than one part need their number, and there are at most
    links / ``HOT_LINKS`` of them; the others' links are part 0.
    """
    hot = topics.where("parts > 1").select("topic_id", "parts")
    return edges.join(hot, "topic_id", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("node_id"), F.col("parts")), F.lit(0)).cast("int"))


def components(links: DataFrame) -> DataFrame:
    """``node_id, component_id``: the least file id that shared topics connect a file with.

    Labels go from files to topics and back as minima, and each round also
    takes the label of its label, so long chains shorten quickly; it ends when
    no label changes.  Files without a link have no row.
    """
    edges = materialize(_edges(links).select(F.col("node_id").cast("string").alias("node_id"), "topic_id"), "edges")
    labels = materialize(edges.select("node_id").distinct().select("node_id", F.col("node_id").alias("label")), "labels")
    while True:
        by_topic = edges.join(labels, "node_id").groupBy("topic_id").agg(F.min("label").alias("least"))
        by_file = edges.join(by_topic, "topic_id").groupBy("node_id").agg(F.min("least").alias("near"))
        both = labels.join(by_file, "node_id").select("node_id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        both = materialize(both, "labels")
        # a label is itself a file, which may know a lesser one by now
        roots = both.select(F.col("node_id").alias("label"), F.col("label").alias("root")).where("label <> root")
        jumped = both.join(roots, "label", "left").select("node_id", "old", F.coalesce("root", "label").alias("label"))
        jumped = materialize(jumped, "labels")
        labels = jumped.select("node_id", "label")
        if jumped.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component_id")
