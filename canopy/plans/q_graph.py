"""Catalogue: graph traversal (H5, X3) and similar pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import text as tx
from canopy.operators import graph as g
from canopy.operators import similar
from canopy.plans import oracle_sql as o
from canopy.plans.catalog import r6, register
from canopy.plans.q_ontology import _links, _topics
from canopy.sources import standins as st

ROUNDS = 4  # of the walk in topic_walk, whose SQL has as many steps

o.add_cte("path_nodes", f"""SELECT DISTINCT p AS id, CASE WHEN instr(p, '/') > 0 THEN {o.dirname('p')} END AS parent_id
    FROM (SELECT unnest({o.prefixes('path')}) AS p FROM files_deep)""", ["files_deep"])
# Sparse links: a page belongs to its first two folders, named without the site.
o.add_cte("page_links", """SELECT DISTINCT CAST(file_id AS VARCHAR) AS node_id, topic_id
    FROM (SELECT file_id, unnest(string_split(path, '/')[2:]) AS topic_id FROM files_deep)""", ["files_deep"])
_SEEDS = "SELECT DISTINCT CAST(file_id AS VARCHAR) AS node_id FROM files_deep WHERE file_id % 100 = 0"


def _page_links(spark, d):
    f, parts = st.files_deep(spark, d), F.split("path", "/")
    return f.select(F.col("file_id").cast("string").alias("node_id"), F.explode(F.slice(parts, 2, F.size(parts))).alias("topic_id"))


def _seeds(spark, d):
    return st.files_deep(spark, d).where("file_id % 100 = 0").select(F.col("file_id").cast("string").alias("node_id"))


def _closure_sql(table: str) -> str:
    return (f"WITH RECURSIVE c(ancestor_id, descendant_id, distance) AS (SELECT id, id, 0 FROM {table} UNION ALL "
            f"SELECT t.parent_id, c.descendant_id, c.distance + 1 FROM c JOIN {table} t ON t.id = c.ancestor_id "
            f"WHERE t.parent_id IS NOT NULL) SELECT * FROM c")


@register("topic_closure", o.with_ctes(f"SELECT * FROM ({_closure_sql('topics')})", "topics"))
def q_topic_closure(spark, d):
    """H5: the topic tree's ancestors at any depth."""
    return g.closure(_topics(spark, d))


@register("path_closure", o.with_ctes(f"SELECT * FROM ({_closure_sql('path_nodes')})", "path_nodes"))
def q_path_closure(spark, d):
    """H5 on folders of uneven depth, pages included."""
    f = st.files_deep(spark, d)
    nodes = f.select(F.explode(tx.prefixes("path")).alias("id")).distinct()
    return g.closure(nodes.withColumn("parent_id", F.when(F.col("id").contains("/"), tx.dirname("id"))))


@register("topic_hops", o.with_ctes(f"""SELECT node_id, CAST(min(hops) AS INTEGER) AS hops FROM (
      WITH RECURSIVE r(node_id, hops) AS ({_SEEDS.replace('AS node_id', 'AS node_id, 0')}
        UNION SELECT b.node_id, r.hops + 1 FROM r JOIN page_links a ON a.node_id = r.node_id
        JOIN page_links b ON b.topic_id = a.topic_id WHERE r.hops < 3) SELECT * FROM r)
    GROUP BY node_id""", "page_links"))
def q_topic_hops(spark, d):
    """Distance of files over shared topics, up to three."""
    return g.hops(_page_links(spark, d), _seeds(spark, d), 3)


def _walk_sql() -> str:
    steps = [f"s0 AS (SELECT node_id, 1.0 / (SELECT count(*) FROM start) AS score FROM start)"]
    for i in range(ROUNDS):
        steps.append(f"""h{i} AS (SELECT l.topic_id, sum(s.score / f.n) / any_value(t.n) AS share FROM page_links l
            JOIN s{i} s ON s.node_id = l.node_id JOIN of_file f ON f.node_id = l.node_id
            JOIN of_topic t ON t.topic_id = l.topic_id GROUP BY l.topic_id)""")
        steps.append(f"""s{i + 1} AS (SELECT node_id, sum(v) AS score FROM (
            SELECT l.node_id, h.share * 0.85 AS v FROM page_links l JOIN h{i} h ON h.topic_id = l.topic_id
            UNION ALL SELECT node_id, score * 0.15 FROM s0) GROUP BY node_id)""")
    return f"""SELECT * FROM (WITH of_file AS (SELECT node_id, count(*) AS n FROM page_links GROUP BY node_id),
        of_topic AS (SELECT topic_id, count(*) AS n FROM page_links GROUP BY topic_id),
        start AS (SELECT node_id FROM ({_SEEDS}) WHERE node_id IN (SELECT node_id FROM page_links)),
        {', '.join(steps)} SELECT node_id, {o.r6('score')} AS score FROM s{ROUNDS})"""


@register("topic_walk", o.with_ctes(_walk_sql(), "page_links"))
def q_topic_walk(spark, d):
    """Scores of a random walk with restart from the seeds, a stated number of rounds."""
    s = g.walk_scores(_page_links(spark, d), _seeds(spark, d), tolerance=0.0, max_rounds=ROUNDS)
    return s.select("node_id", r6("score").alias("score"))


@register("topic_components", o.with_ctes("""SELECT l.node_id, min(m.least) AS component_id FROM links l JOIN (
      SELECT r.a, min(n.least) AS least FROM (WITH RECURSIVE r(a, b) AS (SELECT topic_id, topic_id FROM links
          UNION SELECT r.a, y.topic_id FROM r JOIN links x ON x.topic_id = r.b JOIN links y ON y.node_id = x.node_id)
        SELECT * FROM r) r JOIN (SELECT topic_id, min(node_id) AS least FROM links GROUP BY topic_id) n ON n.topic_id = r.b
      GROUP BY r.a) m ON m.a = l.topic_id GROUP BY l.node_id""", "links"))
def q_topic_components(spark, d):
    """Files that shared topics connect."""
    return g.components(_links(spark, d))


# Vectors with near copies (every component moved by up to a tenth of itself) and exact ones of every tenth.
o.add_cte("copied_vectors", """SELECT CAST(vec_id AS VARCHAR) AS id, embedding AS vector FROM embeddings
    UNION ALL SELECT 'n' || vec_id, list_transform(range(1, len(embedding) + 1), lambda i:
        CAST(embedding[i] * CAST(1 + ((vec_id * 31 + i * i) % 21 - 10) / 100.0 AS FLOAT) AS FLOAT)) FROM embeddings
    UNION ALL SELECT 'e' || vec_id, embedding FROM embeddings WHERE vec_id % 10 = 0""", [])


def _copied_vectors(spark, d):
    e = st.node_embeddings(spark, d)
    moved = F.transform("vector", lambda x, i: (x * (1 + (F.pmod(F.col("vec_id") * 31 + (i + 1) * (i + 1), F.lit(21)) - 10) / 100.0)
                                                .cast("float")).cast("float"))
    return e.select("id", "vector").unionByName(e.select(F.concat(F.lit("n"), "id").alias("id"), moved.alias("vector"))) \
        .unionByName(e.where("vec_id % 10 = 0").select(F.concat(F.lit("e"), "id").alias("id"), "vector"))


@register("similar_pairs", o.with_ctes(f"""SELECT 'member' AS kind, min(id) OVER (PARTITION BY vector) AS a, id AS b, 1.0::DOUBLE AS score
    FROM copied_vectors
    UNION ALL SELECT 'pair', x.a, y.a, {o.r6(o.cosine('x.vector', 'y.vector'))}
    FROM (SELECT vector, min(id) AS a FROM copied_vectors GROUP BY vector) x
    JOIN (SELECT vector, min(id) AS a FROM copied_vectors GROUP BY vector) y ON x.a < y.a
    WHERE list_cosine_similarity(x.vector, y.vector) >= 0.9""", "copied_vectors"))
def q_similar_pairs(spark, d):
    """J8 with its pairs: classes of equal vectors, and pairs of classes with a cosine of 0.9 or more."""
    pairs, members = similar.similar_pairs(_copied_vectors(spark, d), 64, 0.9)
    m = members.select(F.lit("member").alias("kind"), F.col("class_id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    return m.unionByName(pairs.select(F.lit("pair").alias("kind"), "a", "b", r6("score").alias("score")))
