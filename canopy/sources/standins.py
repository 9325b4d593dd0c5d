"""Stand-in tables built from the driver tables (FIXTURES.md section 3).

Each stand-in is a pure projection / aggregation of a driver table, so its
size grows with the input.  The same definitions are repeated as DuckDB CTEs
in :mod:`canopy.plans.oracle_sql`.  Modulo conditions below only decide which
rows play the "already cached" / "changed" role in a simulated earlier run;
every query still reads the whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions.text import content_hash
from canopy.operators.summarise import summarise_files
from canopy.sources.tables import table

# Fixed stand-in parameters.
IGNORE_FILE_LINES = ["src3/", "src1*/de/*", "doc7.ts", "# c", "", "/src5/*", "!src5/en", "**/doc4*", "!doc41*"]
# A rule file for the original's reading of rules: only 'src5' survives the last one.
IGNORE_FILE_LINES_COMPAT = ["src3/", "src5/d**", "doc7.ts", "# c", "", "*.bin", "!src5"]
# invented price per 1M tokens (input, output); "model_x" is deliberately missing.
PRICES = [("model_a", 1.5, 7.0), ("model_b", 4.25, 11.5), ("model_c", 0.35, 0.9)]


def _ext(lang):
    return (F.when(lang == "en", F.lit(".ts")).when(lang == "fr", F.lit(".py"))
            .when(lang == "de", F.lit(".md")).otherwise(F.lit(".bin")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> files(file_id, path, name, text, size, lang)."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), _ext(F.col("lang")))
    return d.select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), name).alias("path"),
        name.alias("name"), "text",
        F.octet_length("text").cast("long").alias("size"), "lang",
    )


# Fixed stand-in sources: lines that line {n} of a document becomes, as a function or, every third one, as a class.
SOURCE_LINES = {
    "typescript": (['export function f{n}(a = "}"): { out: string } {', '  // class No { {line}',
                    '  return `${ {a: 1}.a } { function no() {`;', '}', ''],
                   ['export default class C{n}<T> {', '  /* } */ x = "{";', '  async m{n}(y: T): Promise<string> {',
                    '    return "}" // {line}', '  }', '}', '']),
    "python": (['async def f{n}(a="#("):', '    # class No: {line}', '    return """', 'def no(): (', '"""', ''],
               ['class C{n}:', '    """def no():"""', '    @property', '    def m{n}(self):', '        return [1,', '2]  # {line}', '']),
}


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> source code: every line of a text becomes a function or a class that has it in a comment.

    ``file_id, language, text``; English texts become typescript, the others python.
    """
    f = files(spark, sf_dir)
    language = F.when(F.col("lang") == "en", "typescript").otherwise("python")

    def filled(lines: list[str], line, n):
        # the number and the line fill their places by concatenation, since a line may hold anything
        out = []
        for piece in re.split(r"(\{n\}|\{line\})", "\n".join(lines)):
            out.append({"{n}": n.cast("string"), "{line}": line}.get(piece, F.lit(piece)))
        return F.concat(*out)

    def source(kind: str):
        function, cls = SOURCE_LINES[kind]
        return F.array_join(F.transform(F.split("text", "\n", -1), lambda line, n: F.when(n % 3 == 2, filled(cls, line, n))
                                        .otherwise(filled(function, line, n))), "\n")

    return f.select("file_id", language.alias("language"),
                    F.when(F.col("lang") == "en", source("typescript")).otherwise(source("python")).alias("text"))


def files_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> files with uneven depth: URL without scheme, query, fragment."""
    p = table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        F.col("url"), r"^[a-z]+://", ""), r"[?#].*$", ""), r"/+$", "")
    return p.select(
        F.col("page_id").alias("file_id"), path.alias("path"),
        F.element_at(F.split(path, "/"), -1).alias("name"),
        F.col("html").alias("text"), F.octet_length("html").cast("long").alias("size"),
    )


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extractive summary per distinct content hash of ``files``."""
    return summarise_files(files(spark, sf_dir))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes a simulated earlier run stored: contents of files with doc_id % 3 = 0."""
    f = files(spark, sf_dir)
    return f.where(F.col("file_id") % 3 == 0).select(content_hash("text").alias("hash")).distinct()


def node_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("id"),
        F.when(F.col("vec_id") % 5 == 0, F.lit("model_b")).otherwise(F.lit("model_a")).alias("model"),
        F.size("embedding").alias("dim"),
        F.col("embedding").alias("vector"),
        F.col("vec_id"), F.col("label"),
    )


def raw_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Un-normalised vectors: element x (1 + vec_id % 7), zero where vec_id % 97 = 0."""
    e = table(spark, sf_dir, "embeddings")
    scale = (F.col("vec_id") % 7 + 1).cast("float")
    vec = F.when(F.col("vec_id") % 97 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))) \
        .otherwise(F.transform("embedding", lambda x: (x * scale).cast("float")))
    return e.select(F.col("vec_id").cast("string").alias("id"), vec.alias("vector"), "vec_id", "label")


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label the vector of its lowest vec_id (the domain vector)."""
    e = table(spark, sf_dir, "embeddings")
    g = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    return g.select(
        F.col("label").cast("int").alias("domain_id"),
        F.concat(F.lit("domain-"), (F.col("label") + 1).cast("string")).alias("title"),
        F.concat(F.lit("Topic area "), F.col("label").cast("string")).alias("description"),
        "vector",
    )


def subtopics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domains x {0,1,2}: titles ``sub-j`` repeat in every domain (Q7)."""
    d = domains(spark, sf_dir).select("domain_id")
    return d.select("domain_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pos")) \
        .select("domain_id", "pos",
                F.concat(F.lit("sub-"), F.col("pos").cast("string")).alias("title"),
                F.concat(F.lit("Subtopic "), F.col("pos").cast("string"), F.lit(" of domain "),
                         F.col("domain_id").cast("string")).alias("description"))


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_price double, output_price double")


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two manifests (path, hash) of an earlier and a later run."""
    f = files(spark, sf_dir)
    old = f.where(F.col("file_id") % 11 != 0).select("path", content_hash("text").alias("hash"))
    new_text = F.when(F.col("file_id") % 17 == 0, F.concat("text", F.lit("\n// edited"))).otherwise(F.col("text"))
    new = f.where(F.col("file_id") % 13 != 0).select("path", content_hash(new_text).alias("hash"))
    return old, new


# ---------------------------------------------------------------- ontology

ROOT_TOPIC = ("Corpus", "All documents of the corpus")


def ont_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the ontology stand-in: one per embedding, path ``vec/<id>``."""
    e = node_embeddings(spark, sf_dir)
    return e.select(F.col("id").alias("file_id"), F.concat(F.lit("vec/"), F.col("id")).alias("path"),
                    "vector", "vec_id", "label")


def ont_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains with their 0-based position (= domain_id for the stand-in)."""
    return domains(spark, sf_dir).withColumn("pos", F.col("domain_id"))


def domain_assignment(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    from canopy.operators.ontology import assign_domains
    return assign_domains(ont_files(spark, sf_dir), domains(spark, sf_dir), threshold,
                          keep=["path", "vec_id", "vector"])


def subtopic_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[sub-(vec_id % 3)] (+ sub-0 when vec_id % 4 = 0, a duplicate or a second
    topic); a few rows carry a wrong path, an unknown title or no title."""
    a = domain_assignment(spark, sf_dir)
    empty = F.array().cast("array<string>")
    v = F.col("vec_id")
    subs = F.when(v % 60 == 11, empty).otherwise(F.concat(
        F.array(F.concat(F.lit("sub-"), (v % 3).cast("string"))),
        F.when(v % 4 == 0, F.array(F.lit("sub-0"))).otherwise(empty),
        F.when(v % 45 == 2, F.array(F.lit("sub-9"))).otherwise(empty)))
    path = F.when(v % 50 == 7, F.concat(F.lit("vecx/"), F.col("file_id"))).otherwise(F.col("path"))
    return a.select("domain_id", path.alias("path"), subs.alias("subtopics"))


def subtopic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtopic j of domain d: the vector of label d's (j+2)-th lowest vec_id."""
    from pyspark.sql import Window
    e = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    r = e.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") >= 2) & (F.col("_rn") <= 4))
    return r.select(F.col("label").cast("int").alias("domain_id"), (F.col("_rn") - 2).alias("pos"),
                    F.concat(F.lit("sub-"), (F.col("_rn") - 2).cast("string")).alias("title"),
                    F.col("embedding").alias("vector"))
