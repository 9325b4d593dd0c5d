"""Domain / subtopic discovery (O1, O2, O4) with offline default providers.

* ``discovery_lines``: the lines of the discovery prompt, all directories of
  the first two levels and all files, in prompt order; a prompt builder pages them.
* ``discover_domains``: default provider = ``pyspark.ml`` KMeans over the
  file vectors (distributed), centres normalised as domain vectors.
* ``discover_subtopics``: spherical k-means inside every domain at once, over
  all its files, by grouped vector sums.
* ``cluster_titles``: the terms that set a cluster apart, as its title.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from canopy.functions.batches import byte_slices, cut_words, list_rows, products, squares
from canopy.functions.text import content_hash, segments
from canopy.functions.vector import norm_sq
from canopy.session import cut_lineage, materialize

MAX_SUBTOPICS = 10   # fixed value: the most a domain is divided into
ROWS_AT_ONCE = 4096  # vectors that a task holds as numbers
COUNTS_AT_ONCE = 1 << 20   # counts of terms in clusters that a task holds as numbers
TERM_CHARS = 3       # fixed value: shorter words are no terms of a title


def top_directories(dirs: DataFrame, max_segments: int = 2) -> DataFrame:
    """T4: directories of at most two path segments, by LOC descending."""
    return dirs.where(F.size(segments("path")) <= max_segments).orderBy(F.col("loc").desc(), "path")


def per_path(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every file's own path with the summary of its content (Q15): files of equal content each keep their row."""
    own = files.select("path", content_hash("text").alias("hash"))
    return own.join(summaries.drop("path"), "hash")


def key_files(summaries: DataFrame) -> DataFrame:
    """T5: files by summary length descending (all of them; ``summaries`` has a row per path, see ``per_path``)."""
    n = F.coalesce(F.length("summary.summary"), F.lit(0))
    return summaries.select("path", "summary.title", n.alias("summary_len")) \
        .orderBy(F.col("summary_len").desc(), "path")


def discovery_lines(summaries: DataFrame, dirs: DataFrame) -> DataFrame:
    """O1: the discovery prompt as rows ``(section, weight, path, line)`` in prompt order.

    Sections: 0 the counts, 1 the directories of at most two path segments by
    LOC, 2 the files by summary length.  ``summaries`` has a row per path (see
    ``per_path``), ``dirs`` the columns path, file_count, loc, summary.  The
    order is a range-partitioned sort, so no task holds all lines.
    """
    counts = summaries.select(F.lit(1).alias("f"), F.lit(0).alias("d")) \
        .unionByName(dirs.select(F.lit(0).alias("f"), F.lit(1).alias("d"))) \
        .agg(F.coalesce(F.sum("f"), F.lit(0)).alias("f"), F.coalesce(F.sum("d"), F.lit(0)).alias("d"))
    head = counts.select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("weight"), F.lit("").alias("path"),
                         F.format_string("Repository contains %d files across %d directories.", "f", "d").alias("line"))
    top = dirs.where(F.size(segments("path")) <= 2).select(
        F.lit(1).alias("section"), F.col("loc").cast("long").alias("weight"), "path",
        F.concat(F.lit("• "), "path", F.lit(" ("), F.col("file_count").cast("string"), F.lit(" files, "),
                 F.col("loc").cast("string"), F.lit(" LOC): "), F.coalesce("summary", F.lit(""))).alias("line"))
    files = summaries.select(
        F.lit(2).alias("section"), F.coalesce(F.length("summary.summary"), F.lit(0)).cast("long").alias("weight"), "path",
        F.concat(F.lit("• "), "path", F.lit(": "), F.coalesce("summary.title", F.lit("")), F.lit(" - "),
                 F.coalesce("summary.summary", F.lit(""))).alias("line"))
    return head.unionByName(top).unionByName(files).orderBy("section", F.col("weight").desc(), "path")


def discover_domains(files: DataFrame, k: int = 10, seed: int = 1, vec: str = "vector") -> DataFrame:
    """O2 default provider: KMeans centres (k in 2..10) as domains."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    k = max(2, min(10, k))
    data = files.select(array_to_vector(vec).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(data)
    sizes = model.summary.clusterSizes
    centers = model.clusterCenters()
    rows = []
    for i, c in enumerate(centers):
        c = np.asarray(c, dtype=np.float64)
        nrm = float(np.sqrt(c @ c))
        v = (c / nrm if nrm > 0 else c).astype(np.float32).tolist()
        rows.append((i, i, f"domain-{i + 1}", f"Cluster of {sizes[i]} files", v))
    return files.sparkSession.createDataFrame(
        rows, "domain_id int, pos int, title string, description string, vector array<float>")


class _Centres:
    """Centres of every domain (a few each), which tasks hold as numbers.

    A vector's place is the position of its domain's centre with the largest product, the first of equal
    ones.  Products are summed component by component, as :func:`canopy.functions.vector.dot` does, so they
    are the same numbers; a centre of another length has none.
    """

    def __init__(self, rows: list, kind):
        import pyarrow as pa
        own: dict = {}
        for d, pos, c in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
            own.setdefault(d, []).append((pos, c))
        self.domains = pa.array(list(own), kind)
        self.own = [([p for p, _ in of], [list(c) for _, c in of]) for of in own.values()]

    def places(self, batches):
        """(part of a batch, its rows that a domain with centres has, the domain's number, their vectors by length, their places or -1)."""
        import pyarrow.compute as pc
        for rb in batches:
            for start in range(0, rb.num_rows, ROWS_AT_ONCE):
                part = rb.slice(start, ROWS_AT_ONCE)
                number = pc.index_in(part.column(0).flatten(), value_set=self.domains).fill_null(-1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(part.column(0).offsets, np.int64)))
                starts, sizes, flat = list_rows(part.column(2))
                for d, (numbers, centres) in enumerate(self.own):
                    mine = row[number == d]
                    for width in np.unique(sizes[mine]):
                        rows = mine[sizes[mine] == width]
                        x = flat[starts[rows][:, None] + np.arange(width)]
                        score = np.full((len(centres), len(rows)), -np.inf)
                        same = [i for i, c in enumerate(centres) if len(c) == width]
                        if same:
                            score[same] = products([centres[i] for i in same], x)
                        place = np.where(score.max(0) > -np.inf, np.array(numbers)[score.argmax(0)], -1)
                        yield part, rows, d, x, place


def _units(names: list[str]):
    """Arrow batches of (domain_id, key, vector) -> (domains, key, u): vectors of length 1; those without a direction go.

    Neighbouring rows of equal key and vector, which a file has in each of its domains, become one row of several domains.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for rb in batches:
            for start in range(0, rb.num_rows, ROWS_AT_ONCE):
                part = rb.slice(start, ROWS_AT_ONCE)
                known = np.asarray(part.column(2).is_valid())
                starts, sizes, flat = list_rows(part.column(2))
                for width in np.unique(sizes[known]):
                    rows = np.flatnonzero(known & (sizes == width))
                    x = flat[starts[rows][:, None] + np.arange(width)]
                    length = np.sqrt(squares(x))
                    some = (length > 0) & (length < np.inf)
                    if some.any():
                        yield units(part, rows[some], x[some], length[some])

    def units(part, rows, x, length):
        keys = part.column(1).take(pa.array(rows))
        new = np.ones(len(rows), bool)
        new[1:] = ~np.asarray(pc.equal(keys.slice(1), keys.slice(0, len(rows) - 1)).fill_null(False), bool) | (x[1:] != x[:-1]).any(1)
        first = np.flatnonzero(new)
        u = x[first] / length[first][:, None]
        return pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(np.append(first, len(rows)).astype(np.int32), part.column(0).take(pa.array(rows))),
            keys.take(pa.array(first)),
            pa.ListArray.from_arrays(np.arange(len(u) + 1, dtype=np.int32) * np.int32(x.shape[1]), pa.array(u.ravel()))], names=names)

    return run


def _members(centres: _Centres, key: str):
    """Arrow batches of (domains, key, u) -> (domain_id, pos, key)."""
    import pyarrow as pa

    def run(batches):
        for part, rows, d, _, place in centres.places(batches):
            yield pa.RecordBatch.from_arrays([centres.domains.take(pa.array(np.full(len(rows), d))), pa.array(place.astype(np.int32), mask=place < 0),
                                              part.column(1).take(pa.array(rows))], names=["domain_id", "pos", key])

    return run


def _partial_sums(centres: _Centres):
    """Arrow batches of (domains, key, u) -> (domain_id, pos, n, u): a task's vectors of a place, added up."""
    import pyarrow as pa

    def run(batches):
        sums: dict = {}
        for _, _, d, x, place in centres.places(batches):
            for pos in np.unique(place).tolist():
                held = sums.setdefault((d, pos, x.shape[1]), [0, np.zeros(x.shape[1])])
                held[0] += int((place == pos).sum())
                held[1] += x[place == pos].sum(0)
        if sums:
            yield pa.RecordBatch.from_arrays([
                centres.domains.take(pa.array([d for d, _, _ in sums])), pa.array([None if p < 0 else p for _, p, _ in sums], pa.int32()),
                pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([list(v) for _, v in sums.values()], pa.list_(pa.float64()))],
                names=["domain_id", "pos", "n", "u"])

    return run


def _unit_sum(by: list[str], sums: DataFrame) -> DataFrame:
    """Per group the normalised sum of the tasks' sums ``u`` and the number of vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    g = sums.groupBy(*by).agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("u")).alias("s")) \
        .select(*by, "n", vector_to_array("s").alias("s")).withColumn("l", F.sqrt(norm_sq("s")))
    return g.select(*by, "n", F.when(F.col("l") == 0, F.col("s"))
                    .otherwise(F.transform("s", lambda x: x / F.col("l"))).alias("c"))


def _first_files(unit: DataFrame, n: int, key: str) -> DataFrame:
    """The ``n`` files of each domain with the least hash of their key, ``pos`` from 0.

    The limit stands on the row number itself, so that each task keeps ``n`` rows of a domain before the exchange.
    """
    w = Window.partitionBy("domain_id").orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key))
    return unit.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n).withColumn("pos", F.col("pos") - 1)


def discover_subtopics(assigned: DataFrame, max_sub: int = MAX_SUBTOPICS, iters: int = 8, key: str = "file_id",
                       vec: str = "vector") -> tuple[DataFrame, DataFrame]:
    """O4 default provider: k-means by cosine inside every domain, over all its files.

    ``assigned``: (domain_id, key, vector).  A domain of n files is divided into
    floor(log2(n)) parts, at least 2 and at most ``max_sub``, fewer if files or
    distinct vectors run out.  Centres start at files chosen by a hash of the key; each
    iteration is one pass over the stored unit vectors in which every task adds up
    its vectors of each centre, so a domain with a third of all files is summed like any other.  Null, NaN and zero
    vectors have no direction and take no part.

    Returns the subtopics (domain_id, pos, title, description, vector), with
    positions from 0 and titles ``sub-<pos>``, and each file's (domain_id, pos, key).
    """
    rows = assigned.select("domain_id", key, vec)
    domain, name = rows.schema["domain_id"], rows.schema[key]
    unit = materialize(rows.mapInArrow(_units(["domains", key, "u"]), T.StructType(
        [T.StructField("domains", T.ArrayType(domain.dataType)), name, T.StructField("u", T.ArrayType(T.DoubleType()))])), "subtopic-vectors")
    start = _first_files(unit.select(F.explode("domains").alias("domain_id"), key, "u"), max_sub, key)
    parts = unit.select(F.explode("domains").alias("domain_id")).groupBy("domain_id").agg(F.greatest(F.lit(2), F.least(
        F.lit(max_sub), F.floor(F.log2(F.count(F.lit(1)))))).alias("k"))
    centres = start.join(parts, "domain_id").where(F.col("pos") < F.col("k")).select("domain_id", "pos", F.col("u").alias("c"))
    pos = T.StructField("pos", T.IntegerType())

    def held(centres: DataFrame) -> _Centres:
        return _Centres(centres.collect(), to_arrow_type(domain.dataType))  # max_sub rows a domain at most

    def sums(at: _Centres) -> DataFrame:
        schema = T.StructType([domain, pos, T.StructField("n", T.LongType()), T.StructField("u", T.ArrayType(T.DoubleType()))])
        return _unit_sum(["domain_id", "pos"], unit.mapInArrow(_partial_sums(at), schema))

    at = held(centres)
    for _ in range(iters):
        at = held(sums(at).select("domain_id", "pos", "c"))
    members = unit.mapInArrow(_members(at, key), T.StructType([domain, pos, name]))
    wd = Window.partitionBy("domain_id").orderBy("pos")   # at most max_sub rows
    subs = cut_lineage(sums(at).withColumn("new", F.row_number().over(wd) - 1))
    members = materialize(members, "subtopic-members").join(subs.select("domain_id", "pos", "new"), ["domain_id", "pos"]) \
        .select("domain_id", F.col("new").alias("pos"), key)
    return subs.select(
        "domain_id", F.col("new").alias("pos"), F.concat(F.lit("sub-"), F.col("new").cast("string")).alias("title"),
        F.format_string("Subtopic %d of domain %d (%d files)", "new", "domain_id", "n").alias("description"),
        F.transform("c", lambda x: x.cast("float")).alias("vector")), members


def _term_counts(n_clusters: int):
    """Arrow batches of (text, list of (cluster, times)) -> (term, counts): the files of a slice that have a term, by cluster.

    ``counts`` are numbers of 8 bytes, ``files * n_clusters + cluster``: a list in the JVM would cost a step an element.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 0):
                yield from count(part)

    def count(part):
        words, rows = cut_words(part.column(0))
        words = words.dictionary_encode()
        long = np.asarray(pc.greater_equal(pc.utf8_length(words.dictionary), TERM_CHARS), bool)
        codes = np.asarray(words.indices, np.int64)
        kept = long[codes]
        code, row = np.divmod(np.unique(codes[kept] * part.num_rows + rows[kept]), part.num_rows)   # a file's distinct terms
        col = part.column(1)
        ends, held = np.asarray(col.offsets, np.int64), col.values
        cluster, times = (np.asarray(held.field(i), np.int64) for i in range(2))
        step = max(1, COUNTS_AT_ONCE // n_clusters)
        for start in range(0, len(words.dictionary), step):
            lo, hi = np.searchsorted(code, [start, start + step])
            sizes = (ends[1:] - ends[:-1])[row[lo:hi]]
            for some in _parts(sizes, COUNTS_AT_ONCE):
                some = slice(lo + some.start, lo + some.stop)
                size = (ends[1:] - ends[:-1])[row[some]]
                at = np.repeat(ends[:-1][row[some]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                spot = (np.repeat(code[some], size) - start) * n_clusters + cluster[at]
                n = np.bincount(spot, weights=times[at], minlength=min(step, len(words.dictionary) - start) * n_clusters)
                yield sparse(words.dictionary, start, n.reshape(-1, n_clusters).astype(np.int64))

    def sparse(terms, start, n):
        term, cluster = np.nonzero(n)
        has, sizes = np.unique(term, return_counts=True)
        ends = np.concatenate([[0], 8 * np.cumsum(sizes)]).astype(np.int32)
        counts = pa.py_buffer(n[term, cluster] * n_clusters + cluster)
        return pa.RecordBatch.from_arrays([terms.take(pa.array(has + start)), pa.Array.from_buffers(
            pa.binary(), len(has), [None, pa.py_buffer(ends), counts])], names=["term", "counts"])

    return run


def _parts(sizes, most: int):
    """Slices of rows whose ``sizes`` add up to ``most``, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield slice(at, stop)
        at = stop


def _best_terms(n_clusters: int, factor: list[float], n_terms: int):
    """Arrow batches of (term, counts), all rows of a term in one task and terms ascending
    -> (cluster, term, weight): the task's best terms of each cluster.

    ``factor[s]`` is the factor of a term that ``s`` clusters have.  A term only comes in where its rounded weight
    is above the last best one's, since of equal ones the first term stays.
    """
    from decimal import ROUND_HALF_UP, Decimal

    import pyarrow as pa
    import pyarrow.compute as pc
    factor = np.asarray(factor)

    def rounded(weights):
        distinct, at = np.unique(weights, return_inverse=True)
        return np.array([float(Decimal(repr(w)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for w in distinct.tolist()])[at]

    def run(batches):
        best: list = [[] for _ in range(n_clusters)]   # (rounded weight, weight, term) of each cluster, best first
        last, sums = None, np.zeros(n_clusters, np.int64)   # the term that the next rows may go on with
        for rb in batches:
            for start in range(0, rb.num_rows, max(1, COUNTS_AT_ONCE // n_clusters)):
                part = rb.slice(start, max(1, COUNTS_AT_ONCE // n_clusters))
                terms = part.column(0).dictionary_encode()
                names, code = terms.dictionary, np.asarray(terms.indices, np.int64)
                sizes = np.asarray(pc.binary_length(part.column(1)), np.int64) // 8
                files, cluster = np.divmod(np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64), n_clusters)
                n = np.bincount(np.repeat(code, sizes) * n_clusters + cluster, weights=files, minlength=len(names) * n_clusters)
                n = n.reshape(-1, n_clusters)
                if names[0].as_py() == last:
                    n[0] += sums
                elif last is not None:
                    take(best, pa.array([last]), sums[None, :])
                last, sums = names[len(names) - 1].as_py(), n[-1]
                take(best, names, n[:-1])
        if last is not None:
            take(best, pa.array([last]), sums[None, :])
        rows = [(c, term, weight) for c, of in enumerate(best) for _, weight, term in of]
        if rows:
            cluster, term, weight = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(term), pa.array(weight)], names=["cluster", "term", "weight"])

    def take(best, names, n):
        """Puts the best of some terms, which come after all before, among the ``best``; ``n``: their counts by cluster."""
        if not len(n):
            return
        weight = n * factor[(n > 0).sum(1)][:, None]
        least = np.array([of[-1][0] if len(of) == n_terms else -np.inf for of in best])
        term, cluster = np.nonzero((n > 0) & (weight > least - 1e-8))
        if not len(term):
            return
        weight = weight[term, cluster]
        near = rounded(weight)
        order = np.lexsort((term, -near, cluster))
        order = order[np.arange(len(order)) - np.searchsorted(cluster[order], cluster[order]) < n_terms]
        for i in order.tolist():
            of = best[cluster[i]]
            if len(of) == n_terms and near[i] <= of[-1][0]:
                continue
            of.append((near[i], weight[i], names[int(term[i])].as_py()))
            of.sort(key=lambda t: -t[0])   # of equal ones the first stays before
            del of[n_terms:]

    return run


def cluster_titles(members: DataFrame, texts: DataFrame, by: list[str], key: str = "file_id",
                   n_terms: int = 3) -> DataFrame:
    """Titles from content: per cluster its ``n_terms`` terms of the highest weight, ties by term.

    ``members``: (by..., key); ``texts``: (key, text).  A term (letters and digits,
    three characters or more) weighs the number of the cluster's files that have it times
    log(1 + clusters / clusters that have it).  Clusters without a term have no row.

    A text is cut into words once for all clusters of its file, and a term's counts in all clusters stand in one
    row, so what is sent grows with the distinct terms and not with the files of every cluster.  The clusters,
    which are topics (ten domains of ten subtopics at most), are numbered on the driver.
    """
    spark = members.sparkSession
    clusters = members.select(*by).distinct().collect()
    schema = T.StructType([*members.select(*by).schema.fields, T.StructField("cluster", T.IntegerType())])
    if not clusters:
        return members.select(*by, F.lit(None).cast("string").alias("title")).limit(0)
    numbers = spark.createDataFrame([(*r, i) for i, r in enumerate(clusters)], schema)
    total = len(clusters)
    factor = [0.0] + [r[0] for r in spark.range(1, total + 1).select(F.log1p(F.lit(float(total)) / F.col("id"))).collect()]
    own, of = members.select(*by, F.col(key).alias("_key")).alias("m"), F.broadcast(numbers).alias("c")
    of_file = own.join(of, [F.col(f"m.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by]).where(F.col("_key").isNotNull()) \
        .groupBy("_key", "cluster").agg(F.count(F.lit(1)).alias("times")) \
        .groupBy("_key").agg(F.collect_list(F.struct("cluster", "times")).alias("of"))   # a row a cluster at most
    words = texts.select(F.col(key).alias("_key"), F.lower("text").alias("text")).join(of_file, "_key").select("text", "of")
    counts = words.mapInArrow(_term_counts(total), "term string, counts binary") \
        .repartition("term").sortWithinPartitions("term")
    best = counts.mapInArrow(_best_terms(total, factor, n_terms), "cluster int, term string, weight double")
    w = Window.partitionBy("cluster").orderBy(F.round("weight", 9).desc(), "term")   # n_terms rows a task and cluster
    best = best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n_terms)
    titles = best.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))),
                                                                  lambda t: t["term"]), ", ").alias("title"))
    return titles.join(F.broadcast(numbers), "cluster").select(*by, "title")


def with_titles(topics: DataFrame, titles: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """``topics`` with the titles found; where two inside one ``within`` group are equal, the later ones get a number."""
    t = topics.join(titles.select(*by, F.col("title").alias("_t")), by, "left") \
        .withColumn("title", F.coalesce("_t", "title")).drop("_t")
    w = Window.partitionBy(*within, "title").orderBy("pos")
    n = F.row_number().over(w)
    return t.withColumn("title", F.when(n > 1, F.concat("title", F.lit(" ("), n.cast("string"), F.lit(")")))
                        .otherwise(F.col("title")))
