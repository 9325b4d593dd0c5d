"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights, floor(scale * x), zeros left
out.  Queries and candidates are dealt into blocks; a task holds one block of
each.  It keeps the candidates' postings (for every term the candidates that
have it, with weights), built once, and goes through the terms: every query
row with the term scatters its weight times the postings into its dense array
of scores.  ``argpartition`` then selects each query's k best of the block, and
the blocks' selections are merged by a limited window.

Scores are 32-bit or 64-bit integers, whichever their bound allows.  Rows with
a weight beyond ``NARROW`` are kept apart and scored in Python integers, so no
size of component changes a score.

Each pair of blocks meets under a key of its own, so the work is dealt evenly
whatever the ids are, and a candidate row is sent once per query block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.shared import cut, integer_vectors

NARROW = 2 ** 26        # rows within it have scores of 64 bits, up to 2**11 terms
TOP, BOTTOM = 2 ** 63 - 1, -2 ** 63


def postings(weights: np.ndarray) -> list[tuple]:
    """(term, candidates that have it or None for all, their weights) of integer rows."""
    out = []
    for term in range(weights.shape[1]):
        column = np.ascontiguousarray(weights[:, term])
        at = np.flatnonzero(column)
        if len(at):
            out.append((term, None, column) if len(at) == len(column) else (term, at, column[at]))
    return out


def accumulate(query: np.ndarray, posted: list[tuple], size: int) -> np.ndarray:
    """Scores of ``size`` candidates for one query row, term after term."""
    kind = posted[0][2].dtype if posted else np.int64
    scores, room = np.zeros(size, kind), np.empty(size, kind)
    for term, at, w in posted:
        q = query[term] if term < len(query) else 0
        if q == 0:
            continue
        part = np.multiply(w, q, out=room[:len(w)])
        if at is None:
            scores += part
        else:
            scores[at] += part
    return scores


def select(scores: np.ndarray, k: int, own: int | None = None) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller position; ``own`` is left out."""
    able = np.arange(len(scores))
    if own is not None:
        able = np.delete(able, own)
    s = scores[able]
    if len(s) > k:
        bound = np.partition(s, len(s) - k)[len(s) - k]
        above = np.flatnonzero(s > bound)
        able = able[np.concatenate([above, np.flatnonzero(s == bound)[:k - len(above)]])]
    return able


class _Block:
    """Rows of a block by (vec_id, row): narrow ones as a matrix, the others as lists of integers."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("vec_id", "ascending"), ("row_no", "ascending")])
        self.ids, self.keys = rows.column("vec_id").to_numpy(), rows.column("row_no").to_numpy()
        w, wide = _whole(rows.column("w")), _whole(rows.column("wide"))
        sizes = np.diff(w.offsets.to_numpy())
        values = w.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(w)), sizes)
        far = wide.is_valid().to_numpy(zero_copy_only=False)
        far[owner[np.abs(values) > NARROW]] = True
        self.narrow, self.far = np.flatnonzero(~far), np.flatnonzero(far)
        dense = np.zeros((len(w), int(sizes.max(initial=0))), np.int64)
        dense[np.arange(dense.shape[1])[None, :] < sizes[:, None]] = values
        self.dense = dense[self.narrow]
        self.lists = [[int(c) for c in (wide[i].as_py() if wide[i].is_valid else w[i].as_py())] for i in self.far.tolist()]
        self.largest = int(np.abs(self.dense).max(initial=0))


def _whole(column) -> pa.ListArray:
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], whole.type)
    return whole


def _exact(query: list[int], block: _Block) -> list[int]:
    """Scores of all rows of a block, in Python integers."""
    out = [0] * len(block.ids)
    for i, row in zip(block.narrow.tolist(), block.dense.tolist()):
        out[i] = sum(a * b for a, b in zip(query, row))
    for i, row in zip(block.far.tolist(), block.lists):
        out[i] = sum(a * b for a, b in zip(query, row))
    return out


def best_of_block(queries: _Block, candidates: _Block, k: int):
    """(query row, [(score, candidate)]) of each query, its k best of the block."""
    most = queries.largest * candidates.largest * max(1, min(queries.dense.shape[1], candidates.dense.shape[1]))
    kind = np.int32 if most < 2 ** 31 else np.int64
    posted = postings(candidates.dense.astype(kind))
    place = {key: i for i, key in enumerate(candidates.keys.tolist())}
    slot = {i: n for n, i in enumerate(candidates.narrow.tolist())}

    def cut_to(scored: list[tuple[int, int]]):
        return sorted(scored, key=lambda x: (-x[0], x[1]))[:k]

    for i, query in zip(queries.narrow.tolist(), queries.dense.astype(kind)):
        own = place.get(queries.keys[i].item())
        scores = accumulate(query, posted, len(candidates.narrow))
        best = select(scores, k, slot.get(own))
        scored = list(zip(scores[best].tolist(), candidates.narrow[best].tolist()))
        if len(candidates.far):
            row = query.tolist()
            scored += [(sum(a * b for a, b in zip(row, c)), j) for j, c in zip(candidates.far.tolist(), candidates.lists) if j != own]
        yield i, cut_to(scored)
    for i, query in zip(queries.far.tolist(), queries.lists):
        own = place.get(queries.keys[i].item())
        yield i, cut_to([(s, j) for j, s in enumerate(_exact(query, candidates)) if j != own])


def _beyond(score: int) -> tuple[int, str | None]:
    """(1 above a long, 0 a long, -1 below it; text that ascends with such a score)."""
    if BOTTOM <= score <= TOP:
        return 0, None
    digits = str(abs(score))
    if score > 0:
        return 1, f"{len(digits):06d}{digits}"
    return -1, f"{999_999 - len(digits):06d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def search(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, query_block: int = 2048,
           candidate_block: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's k best other rows.

    ``is_query``: a condition on ``vec_id``.  Score: integer inner product of
    floor(scale * x) over the components that both have, exact for any size of
    component; rows are ranked by it, and one beyond a long is shown as null.
    Rows whose id or vector is null, or whose vector holds a null or non-finite
    component, take no part.  Rows that repeat an id are queries and candidates
    of their own (a query's own row alone is left out).  Fewer than k others:
    all of them.  Ties: the smaller vec_id.  Other columns are not read.
    """
    whole = cut(integer_vectors(vectors, scale, id_col, vector_col).where("vec_id is not null")
                .withColumn("row_no", F.monotonically_increasing_id()), "weights")
    sizes = whole.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    n_query = max(1, -(-sizes["q"] // query_block))
    n_candidate = max(1, -(-sizes["n"] // candidate_block))

    def blocks(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return rows.select(F.pmod(F.xxhash64("row_no"), F.lit(n_own)).cast("int").alias(own),
                           F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other), "row_no", "vec_id", "w", "wide")

    columns = ["qb", "cb", "row_no", "vec_id", "w", "wide"]
    q = blocks(whole.where(is_query), "qb", n_query, "cb", n_candidate).select(columns)
    c = blocks(whole, "cb", n_candidate, "qb", n_query).select(columns)
    schema = "query_row long, query_id long, vec_id long, row_no long, score long, beyond int, wide string"
    names = [part.split()[0] for part in schema.split(", ")]

    def one(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        if left.num_rows and right.num_rows:
            queries, candidates = _Block(left), _Block(right)
            ids, keys = candidates.ids.tolist(), candidates.keys.tolist()
            for i, best in best_of_block(queries, candidates, k):
                query = (queries.keys[i].item(), queries.ids[i].item())
                for score, j in best:
                    beyond, text = _beyond(score)
                    for column, v in zip(out, (*query, ids[j], keys[j], score if not beyond else None, beyond, text)):
                        column.append(v)
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.string()]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(names, out, kinds)})

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(one, schema)
    order = [F.desc("beyond"), F.desc("wide"), F.desc("score"), F.col("vec_id"), F.col("row_no")]
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
