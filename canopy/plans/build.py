"""Composite jobs: ontology build (O6, A14, S15) and the end-to-end run.

Each stage ends in a written table, so its time is the time of its work and
later stages read it instead of computing it again.  Failures of the optional
stages (ontology, embeddings) are recorded in the status table instead of
stopping the run, as the reference does.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions.text import content_hash
from canopy.operators import cost as co
from canopy.operators import discovery as dv
from canopy.operators import ontology as on
from canopy.operators import tree
from canopy.operators import vectors as vo
from canopy.operators.summarise import summarise_files
from canopy.session import cut_lineage, materialize
from canopy.sources.store import TableStore

ROOT = ("Corpus", "All documents of the corpus")
ASSIGN_TRIES = 3


def _ms(t0: float) -> int:
    return int((time.time() - t0) * 1000)


def default_assigner(assign: DataFrame, subtopics: DataFrame, threshold: float) -> DataFrame:
    """(domain_id, path, subtopics) by cosine to the subtopic vectors."""
    t = on.assign_subtopics(assign, subtopics, threshold, keep=["path"], listed=True)
    # at most 10 titles, so few different lists of a path
    return t.groupBy("domain_id", "path").agg(F.array_compact(F.array_distinct(F.flatten(F.collect_set("titles")))).alias("subtopics"))


def checked_assignments(assign: DataFrame, subtopics: DataFrame, threshold: float, assigner: Callable,
                        tries: int = ASSIGN_TRIES) -> DataFrame:
    """The assigner's table once it passes the checks of J11; asked again up to ``tries`` times, then an error."""
    for _ in range(tries):
        got = materialize(assigner(assign, subtopics, threshold), "assignments")
        bad = on.assignment_violations(got, assign.select("domain_id", "path"), subtopics) \
            .groupBy("reason").count().orderBy("reason").collect()   # four reasons
        if not bad:
            return got
    raise ValueError("subtopic assignment failed its checks: " + ", ".join(f"{r['reason']} {r['count']}" for r in bad))


def build_ontology(files: DataFrame, store: TableStore | None = None, n_domains: int = 10,
                   threshold: float = on.THRESHOLD, root: tuple[str, str] = ROOT,
                   assigner: Callable[[DataFrame, DataFrame, float], DataFrame] = default_assigner) -> dict:
    """Discovery -> clustering -> subtopics -> assignment -> persistence.

    ``files``: (file_id, path, vector) and, for titles from content, text.
    Files without a direction (null or zero vector) are assigned by fallback.
    Returns the DataFrames and a one-row ``metrics`` DataFrame (timings,
    counts, coverage, quality, call count).
    """
    spark = files.sparkSession
    timing = {}
    t_all = t0 = time.time()

    def done(stage: str) -> None:
        nonlocal t0
        timing[f"{stage}_ms"] = _ms(t0)
        t0 = time.time()

    domains = cut_lineage(dv.discover_domains(files, k=n_domains))  # 2 to 10 rows
    done("domain_discovery")

    assign = materialize(on.assign_domains(files, domains, threshold, keep=["path", "vector"], batched=True), "assignment")
    texts = files.select("file_id", "text") if "text" in files.columns else None
    if texts is not None:
        own = assign.where(~F.col("via_fallback")).select("domain_id", "file_id")
        domains = cut_lineage(dv.with_titles(domains, dv.cluster_titles(own, texts, ["domain_id"]), ["domain_id"], []))
    done("clustering")

    subs, members = dv.discover_subtopics(assign)
    if texts is not None:
        by = ["domain_id", "pos"]
        subs = dv.with_titles(subs, dv.cluster_titles(members, texts, by), by, ["domain_id"])
    subs = cut_lineage(subs)
    done("subtopic")

    assignments = checked_assignments(assign, subs, threshold, assigner)
    done("assignment")

    topics = on.ontology_topics(root, domains, subs)
    links = on.ontology_links(assignments, files, domains, subs)
    if store is not None:
        store.replace_many({"topics": topics, "topic_links": links})
        topics, links = store.read("topics"), store.read("topic_links")
    else:
        topics, links = materialize(topics, "topics"), materialize(links, "topic-links")
    done("persistence")
    timing["total_ms"] = _ms(t_all)

    n_files = files.agg(F.count(F.lit(1)).alias("n"))
    cov = on.coverage(links, n_files).select(F.col("coverage_distinct").alias("coverage"), "links", "files")
    q = on.cluster_quality(assign).select(F.col("avg_similarity").alias("similarity"), "n_pairs")
    nd = domains.agg(on.call_count(F.count(F.lit(1))).alias("calls"), F.count(F.lit(1)).alias("n_domains"))
    tl = spark.createDataFrame([tuple(timing.values())], ", ".join(f"{k} long" for k in timing))
    metrics = cov.unionByName(q, allowMissingColumns=True).unionByName(nd, allowMissingColumns=True) \
        .unionByName(tl, allowMissingColumns=True)
    metrics = metrics.agg(*[F.max(c).alias(c) for c in metrics.columns])
    return {"domains": domains, "subtopics": subs, "assignment": assign, "topics": topics, "links": links,
            "metrics": on.validation(metrics)}


def run_pipeline(spark: SparkSession, files: DataFrame, store: TableStore | None = None,
                 cache: DataFrame | None = None, with_ontology: bool = True, prices: DataFrame | None = None,
                 model: str = "offline", approve: Callable[[float], bool] | None = None) -> DataFrame:
    """Cost -> summarise (cache-first) -> tree -> embeddings -> ontology.

    ``files`` (file_id, path, text, size).  With ``prices`` the summaries still
    to be made are priced first; a total above the limit of self-approval goes
    on only if ``approve(total)`` is true.  Returns the stage status table.
    """
    store = store or TableStore.for_session(spark)
    status = []

    def stage(name, fn, optional=False):
        t0 = time.time()
        try:
            n = fn()
            status.append((name, "ok", n, _ms(t0), None))
        except Exception as e:  # noqa: BLE001
            if not optional:
                raise
            status.append((name, "failed", None, _ms(t0), str(e)))

    def todo():
        keyed = files.select("file_id", "path", "text", content_hash("text").alias("hash"))
        known = cache if cache is not None else store.read("summaries") if store.exists("summaries") else None
        if known is not None and "status" in known.columns:
            known = known.where("status = 'ok'")
        return keyed if known is None else keyed.join(known.select("hash").distinct(), "hash", "left_anti")

    def cost():
        work = todo().select("hash").distinct()
        total = co.price(co.stage_items(work, "summarization", model, co.FILE_INPUT_TOKENS, co.FILE_OUTPUT_TOKENS),
                         prices).where("stage = 'total'").first()
        if not total["approved"] and not (approve and approve(total["cost"])):
            raise PermissionError(f"estimated cost of {total['cost']:.2f} was not approved")
        return total["items"]

    def summarise():
        store.put_summaries("summaries", summarise_files(todo().drop("hash")))
        return store.read("summaries").count()

    def directories():
        store.replace("directories", tree.build_directories(files))
        return store.read("directories").count()

    def embeddings():
        summ = store.read("summaries")
        texts = vo.embedding_texts(summ)
        existing = store.read("embeddings").select("id") if store.exists("embeddings") else texts.limit(0).select("id")
        todo = texts.join(existing, "id", "left_anti")
        emb = vo.embed_texts(todo).select("id", "model", "dim", "vector", F.lit(int(time.time())).cast("long").alias("batch"))
        store.upsert("embeddings", emb)
        return store.read("embeddings").count()

    def ontology():
        emb = store.read("embeddings").select(F.col("id").alias("hash"), "vector")
        summ = store.read("summaries").select("hash", F.col("summary.summary").alias("text"))
        own = files.select("file_id", "path", content_hash("text").alias("hash"))   # files of equal content keep their paths
        f = own.join(emb, "hash").join(summ, "hash").select("file_id", "path", "vector", "text")
        res = build_ontology(materialize(f, "ontology-files"), store)
        return res["links"].count()

    if prices is not None:
        stage("cost", cost)
    stage("summaries", summarise)
    stage("directories", directories)
    stage("embeddings", embeddings, optional=True)
    if with_ontology:
        stage("ontology", ontology, optional=True)
    return spark.createDataFrame(status, "stage string, status string, rows long, ms long, error string")
