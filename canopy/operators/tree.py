"""Directory hierarchy and roll-ups.

The recursive tree walk of the reference becomes an *ancestor explode*:
each file emits one row per ancestor directory, and a single aggregation
(partial map-side, then final) gives every directory's cumulative metrics.
No recursion, no driver-side tree, one shuffle whose size is bounded by
(number of directories x partitions) after the map-side combine, so a hot
directory holding a third of the corpus is pre-aggregated per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.text import ancestors, basename, content_hash, dir_id, dirname, line_count, segments
from canopy.operators.changes import manifest_diff
from canopy.session import materialize
from canopy.sources.store import Merge

EMPTY_DIRECTORY = "[empty directory]"
LARGE_LOC = 1000


def _with_loc(files: DataFrame) -> DataFrame:
    return files if "loc" in files.columns else files.withColumn("loc", line_count("text"))


def _dir_cols(path_col: str = "path"):
    p = F.col(path_col)
    return [
        dir_id(p).alias("id"),
        basename(p).alias("name"),
        p.alias("path"),
        F.when(F.instr(p, "/") == 0, F.lit(None).cast("string")).otherwise(dir_id(dirname(p))).alias("parent_id"),
    ]


def directory_tree(files: DataFrame) -> DataFrame:
    """H1: every ancestor directory once, root excluded; parent null under root."""
    d = files.select(F.explode(ancestors("path")).alias("path")).distinct()
    return d.select(*_dir_cols())


def directory_rollup(files: DataFrame) -> DataFrame:
    """A1: cumulative LOC and file count of each directory over all descendants."""
    f = _with_loc(files)
    ex = (f.where(F.size(segments("path")) > 1)
          .select(F.explode(ancestors("path")).alias("path"), F.col("loc").cast("long").alias("loc")))
    g = ex.groupBy("path").agg(F.sum("loc").alias("loc"), F.count(F.lit(1)).alias("file_count"))
    return g.select(*_dir_cols(), "loc", "file_count")


def file_manifest(files: DataFrame) -> DataFrame:
    """``path, hash, loc`` of files (path, text; null: empty): what an incremental roll-up remembers of them."""
    text = F.coalesce("text", F.lit(""))
    return files.select("path", content_hash(text).alias("hash"), line_count(text).cast("long").alias("loc"))


def update_rollup(store, name: str, files: DataFrame) -> DataFrame:
    """A1 kept up to date: bring the stored roll-up ``name`` in line with ``files``.

    ``files`` are all files of now (path, text; a path stands once).  The stored
    manifest ``<name>_files`` is compared with theirs; a file that was added,
    changed or removed gives a signed change of lines and of the file count to
    each directory above it, and these sums are merged into the stored table.
    Directories without a file left go.  Only buckets of changed files and
    directories are written, in one commit with the manifest; a first call
    writes all.  Nothing changed: no commit.  Gives the changes made
    (``path, change, loc, n``: the signed lines and files).
    """
    now = file_manifest(files)
    known = store.read(f"{name}_files") if store.exists(f"{name}_files") else now.limit(0)
    diff = manifest_diff(known, now).where("change <> 'same'")
    old, new = (d.select("path", F.col("hash").alias(f"{w}_hash"), F.col("loc").alias(f"{w}_loc")) for d, w in ((known, "old"), (now, "new")))
    changes = materialize(diff.join(old, "path", "left").join(new, "path", "left").select(
        "path", "change", F.col("new_hash").alias("hash"), F.col("new_loc").alias("new_loc"),
        (F.coalesce("new_loc", F.lit(0)) - F.coalesce("old_loc", F.lit(0))).alias("loc"),
        F.when(F.col("change") == "added", 1).when(F.col("change") == "removed", -1).otherwise(0).cast("long").alias("n")), "file-changes")
    if changes.isEmpty():
        return changes.select("path", "change", "loc", "n")
    sums = (changes.select(F.explode(ancestors("path")).alias("path"), "loc", "n").groupBy("path")
            .agg(F.sum("loc").alias("loc"), F.sum("n").alias("file_count")).where("loc <> 0 or file_count <> 0"))
    moved = materialize(sums.select(*_dir_cols(), "loc", "file_count"), "directory-changes")
    remembered = changes.select("path", "hash", F.col("new_loc").alias("loc"))

    def keep(old, rows):
        return old.join(rows.select("path"), "path", "left_anti").select("path", "hash", "loc").unionByName(rows.where("hash is not null"))

    store.merge_many({f"{name}_files": Merge(remembered, ("path",), keep), name: Merge(moved, ("path",), add_rollups)})
    return changes.select("path", "change", "loc", "n")


def add_rollups(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Roll-ups plus signed changes of them; a directory without files goes."""
    both = old.select("path", "loc", "file_count").unionByName(changes.select("path", "loc", "file_count"))
    total = both.groupBy("path").agg(F.sum("loc").alias("loc"), F.sum("file_count").alias("file_count")).where("file_count <> 0")
    return total.select(*_dir_cols(), "loc", "file_count")


def repo_totals(files: DataFrame) -> DataFrame:
    """A2: the root node's totals."""
    f = _with_loc(files)
    return f.agg(F.coalesce(F.sum(F.col("loc").cast("long")), F.lit(0).cast("long")).alias("loc"),
                 F.count(F.lit(1)).alias("file_count"))


def _children(files: DataFrame, dirs: DataFrame | None = None, label: str = "id") -> DataFrame:
    """All (parent_path, kind, label) child entries: sub-directories then files."""
    dirs = dirs if dirs is not None else directory_tree(files)
    sub = dirs.select(dirname("path").alias("parent"), F.lit(0).alias("kind"),
                      F.concat(F.col("name"), F.lit("/")).alias("label"))
    lab = F.col("file_id").cast("string") if label == "id" else basename("path")
    fil = files.select(dirname("path").alias("parent"), F.lit(1).alias("kind"), lab.alias("label"))
    return sub.unionByName(fil)


def directory_child_counts(files: DataFrame) -> DataFrame:
    """A3: direct children (sub-directories + files) per directory; root = ''."""
    ch = _children(files)
    return ch.groupBy(F.col("parent").alias("path")).agg(
        F.count(F.lit(1)).alias("child_count"),
        F.count(F.when(F.col("kind") == 0, 1)).alias("n_dirs"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("n_files"))


def directory_summary(files: DataFrame, label: str = "id", max_listed: int = 3) -> DataFrame:
    """H4: heuristic text for directories with <= 3 children, flag for larger.

    Listing = sub-directories (``name/``, sorted) then files (ids by default,
    as the reference does; ``label='name'`` lists names), joined by ', '.
    Child lists are only collected for directories proven to have at most
    ``max_listed`` children (count first, then a semi join), so no large
    directory is ever gathered into one row.
    """
    dirs = directory_tree(files)
    ch = _children(files, dirs, label)
    counts = ch.groupBy("parent").agg(F.count(F.lit(1)).alias("child_count"))
    small = counts.where(F.col("child_count") <= max_listed)
    listed = (ch.join(small.select("parent"), "parent", "left_semi")
              .groupBy("parent")
              .agg(F.array_sort(F.collect_list(F.struct("kind", "label"))).alias("items")))
    text = F.concat(F.lit("Contains "), F.array_join(F.transform("items", lambda x: x["label"]), ", "))
    out = (dirs.select("path").join(counts.withColumnRenamed("parent", "path"), "path", "left")
           .join(listed.withColumnRenamed("parent", "path"), "path", "left"))
    n = F.coalesce(F.col("child_count"), F.lit(0).cast("long"))
    return out.select(
        "path", n.alias("child_count"),
        F.when(n == 0, F.lit(EMPTY_DIRECTORY)).when(n <= max_listed, text)
        .otherwise(F.lit(None).cast("string")).alias("summary"),
        (n > max_listed).alias("needs_provider"),
    )


def describe_large_directories(summary: DataFrame, counts: DataFrame) -> DataFrame:
    """Offline default provider for directories above the heuristic limit.

    Deterministic one-sentence text from the child counts (a model-backed
    provider can replace it through the same columns).
    """
    c = counts.select("path", "n_dirs", "n_files")
    j = summary.join(c, "path", "left")
    txt = F.concat(F.lit("Directory '"), F.element_at(F.split("path", "/"), -1), F.lit("' with "),
                   F.col("child_count").cast("string"), F.lit(" items ("),
                   F.coalesce(F.col("n_dirs"), F.lit(0)).cast("string"), F.lit(" sub-directories, "),
                   F.coalesce(F.col("n_files"), F.lit(0)).cast("string"), F.lit(" files)"))
    return j.select("path", "child_count",
                    F.when(F.col("needs_provider"), txt).otherwise(F.col("summary")).alias("summary"),
                    "needs_provider")


def build_directories(files: DataFrame) -> DataFrame:
    """Full directory table (schemas.DIRECTORIES): roll-up + summaries."""
    roll = directory_rollup(files)
    summ = describe_large_directories(directory_summary(files), directory_child_counts(files))
    return roll.join(summ.select("path", "summary"), "path", "left").select(
        "id", "name", "path", "parent_id", F.coalesce("summary", F.lit("")).alias("summary"),
        "loc", "file_count")


def root_directories(dirs: DataFrame) -> DataFrame:
    """H2: top-level directories."""
    return dirs.where(F.col("parent_id").isNull())


def directory_children(dirs: DataFrame, parent_path: str) -> DataFrame:
    """H3: children of one directory (by path -> stable id)."""
    return dirs.where(F.col("parent_id") == dir_id(F.lit(parent_path)))


def files_in_directory(files: DataFrame) -> DataFrame:
    """File -> containing directory id without a join ('root' at top level)."""
    d = dirname("path")
    return files.select("file_id", d.alias("dir_path"),
                        F.when(d == "", F.lit("root")).otherwise(dir_id(d)).alias("dir_id"))


def tree_integrity(files: DataFrame, expected: int | None = None) -> DataFrame:
    """A10: files counted in the tree (top-level dirs + root files) vs expected.

    One union + one global aggregate (no join of the three counts).
    """
    roll = directory_rollup(files)
    zero = F.lit(0).cast("long")
    a = files.select(F.lit(1).cast("long").alias("e"), zero.alias("n"),
                     F.when(F.size(segments("path")) == 1, 1).otherwise(0).cast("long").alias("m"))
    b = roll.where(F.col("parent_id").isNull()).select(zero.alias("e"), F.col("file_count").alias("n"), zero.alias("m"))
    t = a.unionByName(b).agg(F.coalesce(F.sum("e"), zero).alias("e"), F.coalesce(F.sum("n"), zero).alias("n"),
                             F.coalesce(F.sum("m"), zero).alias("m"))
    exp = F.col("e") if expected is None else F.lit(expected).cast("long")
    found = F.col("n") + F.col("m")
    return t.select(exp.alias("expected"), found.alias("found"), (found == exp).alias("passed"))


def large_directories(files: DataFrame, threshold: int = LARGE_LOC) -> DataFrame:
    """Directories whose cumulative LOC reaches ``threshold``."""
    return directory_rollup(files).select("path", "loc", (F.col("loc") >= threshold).alias("is_large"))
