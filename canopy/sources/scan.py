"""File scan and the scan-time filters.

The directory walk of a single process becomes a distributed listing; every
filter below is a narrow, per-row predicate on the listing, so a 100 TB corpus
is filtered without a shuffle and before any file is opened.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions.text import basename, extension, line_count, prefixes, segments

# Fixed values that must equal the reference: accepted extensions and the
# directory names that prune a subtree (matched as substrings).
SUPPORTED_EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".cpp", ".c", ".h", ".hpp",
    ".cs", ".php", ".rb", ".go", ".rs", ".swift", ".kt", ".scala", ".sh",
    ".md", ".txt", ".json", ".yaml", ".yml",
]
IGNORED_DIR_NAMES = [
    "node_modules", ".git", ".next", "dist", "build", ".turbo", "__pycache__",
    ".pytest_cache", "coverage", ".nyc_output",
]
MAX_FILE_BYTES = 1024 * 1024
MAX_FILES = 500


LISTING = "path string, size long, modified timestamp"


def _open_root(root: str):
    """(file system, folder path) of a root given as URI or absolute path."""
    from pyarrow import fs
    root = re.sub(r"^file:/+", "file:///", root.rstrip("/"))
    return fs.FileSystem.from_uri(root)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (relative to ``root``), ``size`` and ``modified`` of every file below a folder.

    Spark's own file index drops names that start with '_' or '.', so the
    folder is listed through its file system: the top level by the driver,
    each folder below it by a task.  No file is opened.
    """
    files, base = _open_root(root)
    from pyarrow import fs
    top = files.get_file_info(fs.FileSelector(base))
    folders = sorted(i.base_name for i in top if i.type == fs.FileType.Directory)
    own = [(i.base_name, i.size, i.mtime) for i in top if i.type == fs.FileType.File]
    dealt = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, len(folders)))

    def walk(batches):
        import pyarrow as pa
        from pyarrow import fs
        files, base = _open_root(root)
        for batch in batches:
            todo = batch.column(0).to_pylist()
            while todo:
                folder = todo.pop()
                found = files.get_file_info(fs.FileSelector(f"{base}/{folder}"))
                todo += [f"{folder}/{i.base_name}" for i in found if i.type == fs.FileType.Directory]
                here = [i for i in found if i.type == fs.FileType.File]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{folder}/{i.base_name}" for i in here], pa.string()),
                     pa.array([i.size for i in here], pa.int64()),
                     pa.array([i.mtime for i in here], pa.timestamp("us", "UTC"))], names=["path", "size", "modified"])

    return dealt.mapInArrow(walk, LISTING).unionByName(spark.createDataFrame(own, LISTING))


def read_texts(listed: DataFrame, root: str) -> DataFrame:
    """``listed`` with ``text``: the content of each file as UTF-8 (bytes that are none become replacement characters).

    Files are dealt over the tasks first, since a listing's rows stand where
    their folder was listed; a task holds one file's text beside its batch.
    """
    columns = listed.columns

    def read(batches):
        import pyarrow as pa
        files, base = _open_root(root)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                with files.open_input_stream(f"{base}/{row.column(columns.index('path'))[0].as_py()}") as f:
                    text = f.read().decode("utf-8", errors="replace")
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([text])], names=[*columns, "text"])

    schema = T.StructType([*listed.schema.fields, T.StructField("text", T.StringType())])
    return listed.repartition("path").mapInArrow(read, schema)


def scan_directory(spark: SparkSession, root: str) -> DataFrame:
    """Listing and texts of every file below a folder."""
    return read_texts(list_files(spark, root), root)


def filter_extension(df: DataFrame, exts=SUPPORTED_EXTENSIONS, path: str = "path") -> DataFrame:
    """Keep files whose lower-cased extension is in the allow-list."""
    return df.where(extension(path).isin(*exts))


def _dir_segments(path: str) -> Column:
    segs = segments(path)
    return F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))


def filter_ignored_dirs(df: DataFrame, names=IGNORED_DIR_NAMES, exact: bool = False,
                        path: str = "path") -> DataFrame:
    """S3: drop files under a directory whose name contains (default) or
    equals (``exact=True``) one of ``names``."""
    if exact:
        hit = F.exists(_dir_segments(path), lambda s: s.isin(*names))
    else:
        hit = F.exists(_dir_segments(path),
                       lambda s: reduce(lambda a, b: a | b, [s.contains(n) for n in names]))
    return df.where(~hit)


def filter_max_size(df: DataFrame, max_bytes: int = MAX_FILE_BYTES, size: str = "size") -> DataFrame:
    """Skip files larger than ``max_bytes``."""
    return df.where(F.col(size) <= max_bytes)


def limit_files(df: DataFrame, n: int = MAX_FILES, order: str = "path") -> DataFrame:
    """Deterministic file cap (plans as TakeOrderedAndProject)."""
    return df.orderBy(order).limit(n)


# ---------------------------------------------------------------- ignore rules

def parse_ignore_rules(lines) -> list[str]:
    """Trim, drop blanks and '#' comments.  Order and trailing '/' count."""
    stripped = ((line or "").strip() for line in lines)
    return [p for p in stripped if p and not p.startswith("#")]


def read_ignore_file(spark: SparkSession, path: str) -> list[str]:
    """Read an ignore file through the session's Hadoop file system (any
    cluster file system; Spark's file listing would skip a hidden name such
    as ``.gitignore``)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    stream = fs.open(p)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return parse_ignore_rules(text.split("\n"))


def glob_to_regex(pattern: str) -> str:
    """Regex, over a path relative to the root, of a rule without '!' and trailing '/'.

    A pattern with a '/' at its start or inside is anchored to the root; any
    other matches the last segment at every depth.  '**/' stands for any
    number of segments, a final '/**' for all below, '*' and '?' stay within
    a segment, '[...]' is a character class ('!' negates), '\\' quotes.
    """
    anchored = "/" in pattern
    p, out, i = pattern.lstrip("/"), [], 0
    while i < len(p):
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif p.startswith("**", i) and i + 2 == len(p) and (i == 0 or p[i - 1] == "/"):
            out.append(".*")
            i += 2
        elif p[i] == "*":
            out.append("[^/]*")
            i += 1
        elif p[i] == "?":
            out.append("[^/]")
            i += 1
        elif p[i] == "[" and "]" in p[i + 2:]:
            end = p.index("]", i + 2)
            body = p[i + 1:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            i = end + 1
        else:
            if p[i] == "\\" and i + 1 < len(p):
                i += 1
            out.append(re.escape(p[i]))
            i += 1
    return ("^" if anchored else "^(?:.*/)?") + "".join(out) + "$"


def _compat_hit(prefix: Column, rule: str) -> Column:
    """Does a rule hit a path as the original reads rules?

    A rule with a star is a pattern of the whole path in which only dots are
    escaped and '**' ends up as one character and a star; any other rule is
    the path itself, a folder above it, or one of its segments.  '!' turns the
    answer round.
    """
    if rule.startswith("!"):
        return ~_compat_hit(prefix, rule[1:])
    if "*" in rule:
        body = rule.replace(".", r"\.").replace("**", ".*").replace("*", "[^/]*")
        return prefix.rlike(f"^{body}$")
    return (prefix == F.lit(rule)) | prefix.startswith(f"{rule}/") | F.array_contains(F.split(prefix, "/"), F.lit(rule))


def ignore_predicate(rules: list[str], path: str = "path", compat: bool = False) -> Column:
    """Boolean column: do the rules ignore the file?

    For the file and each folder above it the last rule that matches decides;
    '!' re-includes.  A file below an ignored folder is ignored whatever later
    rules say of it.  A rule with a trailing '/' matches folders only.

    ``compat``: the original's reading.  The order of rules and a trailing '/'
    mean nothing, a rule that hits the file or a folder above it ignores it, and '!p'
    ignores all that p does not hit.
    """
    if compat:
        bare = [r.removesuffix("/") for r in rules]
        return F.exists(prefixes(path), lambda x: reduce(lambda a, b: a | b, [_compat_hit(x, r) for r in bare], F.lit(False)))

    def verdict(prefix: Column) -> Column:
        out = None
        for rule in reversed(rules):
            back, body = rule.startswith("!"), rule.removeprefix("!")
            hit = prefix.rlike(glob_to_regex(body.rstrip("/")))
            if body.endswith("/"):
                hit = hit & (prefix != F.col(path))
            out = F.when(hit, F.lit(not back)) if out is None else out.when(hit, F.lit(not back))
        return F.lit(False) if out is None else out.otherwise(F.lit(False))

    return F.exists(prefixes(path), verdict)


def filter_ignore_rules(df: DataFrame, rules: list[str], path: str = "path", compat: bool = False) -> DataFrame:
    """Drop files hit by the ignore rules (a narrow filter, no join)."""
    return df.where(~ignore_predicate(rules, path, compat))


def file_records(df: DataFrame, id_col: str = "file_id") -> DataFrame:
    """One record per surviving file: id, path, name, loc, size.

    The id is the caller's stable key (content hash or path hash), never a
    scan position, so no global sort is needed.
    """
    if id_col not in df.columns:
        df = df.withColumn(id_col, F.substring(F.sha2(F.col("path"), 256), 1, 16))
    return df.select(
        F.col(id_col).alias("file_id"), "path", basename("path").alias("name"),
        line_count("text").alias("loc"), F.col("size").cast("long").alias("size"),
    )


def scan_files(spark: SparkSession, root: str, rules: list[str] | None = None,
               max_bytes: int | None = None, max_files: int | None = None) -> DataFrame:
    """S1-S6 composed: listing -> ignore rules -> pruned dirs -> extension -> size -> texts.

    All filters see paths and sizes alone; only files that pass are opened.
    ``rules=None`` reads ``<root>/.gitignore`` when present.  ``max_bytes``
    is off unless given (``skipped_files`` reports what it leaves out).
    """
    if rules is None:
        rules = read_ignore_file(spark, root.rstrip("/") + "/.gitignore")
    df = list_files(spark, root)
    if rules:
        df = filter_ignore_rules(df, rules)
    df = filter_extension(filter_ignored_dirs(df))
    if max_bytes is not None:
        df = filter_max_size(df, max_bytes)
    if max_files is not None:
        df = limit_files(df, max_files)
    return read_texts(df, root)


def skipped_files(listed: DataFrame, max_bytes: int) -> DataFrame:
    """Files that the size guard leaves out."""
    return listed.where(F.col("size") > max_bytes)
