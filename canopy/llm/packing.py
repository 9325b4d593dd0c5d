"""Packing token sequences: order-preserving dynamic programming over cut positions.

Documents, in id order, form one stream of tokens (each document's ids, then
an end id).  Windows of at most ``length`` tokens are cut from it at document
ends, sentence ends, or at every ``grid``-th token, where a cut most likely
falls inside a sentence.  The cuts minimise

    padding + window_cost per window + sentence_cut per cut inside a document
    at a sentence end + forced_cut per cut inside a sentence

where a window is padded to ``length`` unless its size is a power of two.
With positions p and best costs c, the padded transition into j is
``min(c[i] + p[i]) + length - p[j]`` over the candidates of the last
``length`` tokens: the minimum of a sliding window, which a monotone queue
keeps in constant time; windows of a power of two add at most one earlier
candidate for each power.

Spark range-partitions the documents by id; a task streams its sorted rows
and solves blocks of ``block_tokens`` tokens (whole documents, at least one),
so memory is bounded by a block and the longest document.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.byte_bpe import encode, sentence_enders
from canopy.llm.shared import by_id, slices

TEXTS_AT_ONCE = 256


def choose_cuts(positions: np.ndarray, penalties: np.ndarray, length: int, window_cost: float) -> list[int]:
    """Indices into ``positions`` (ascending, first and last are cuts) of the best cuts.

    Neighbouring positions are at most ``length`` apart.  Ties: the padded
    transition from the earliest candidate first, then the largest power.
    """
    p = positions.tolist()
    pairs = []
    for k in range(length.bit_length() - 1, -1, -1):
        i = np.searchsorted(positions, positions - (1 << k))
        hit = np.flatnonzero((positions[i] == positions - (1 << k)) & (positions >= (1 << k)))
        pairs.append(np.stack([hit, i[hit]]))
    exact = np.concatenate(pairs, axis=1)
    exact = exact[:, np.argsort(exact[0], kind="stable")]
    first = np.searchsorted(exact[0], np.arange(len(p) + 1)).tolist()
    earlier, penalty = exact[1].tolist(), penalties.tolist()
    cost, back, queue = [0.0] * len(p), [0] * len(p), deque([(float(p[0]), 0)])  # (c + p, index), c + p ascending
    for j in range(1, len(p)):
        at = p[j]
        while p[queue[0][1]] < at - length:
            queue.popleft()
        best, b = queue[0]
        best += length - at
        for i in earlier[first[j]:first[j + 1]]:
            if cost[i] < best:
                best, b = cost[i], i
        cost[j] = best = best + window_cost + penalty[j]
        back[j] = b
        best += at
        while queue and queue[-1][0] > best:
            queue.pop()
        queue.append((best, j))
    cuts = [len(p) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, enders: np.ndarray, grid: int,
               sentence_cut: float, forced_cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of a block (0 and its end included) and the penalty of a cut there."""
    penalty = np.full(len(ids) + 1, np.inf)
    penalty[::grid] = forced_cut
    penalty[1:][enders[ids]] = sentence_cut
    penalty[doc_ends] = penalty[0] = 0.0
    positions = np.flatnonzero(np.isfinite(penalty))
    return positions, penalty[positions]


def pack_block(docs: list[tuple], enders: np.ndarray, length: int, grid: int, window_cost: float,
               sentence_cut: float, forced_cut: float) -> dict[str, np.ndarray]:
    """Pieces of one block; ``docs``: (doc_id, ids with the end id).  Sequences count from 0."""
    sizes = np.fromiter((len(x) for _, x in docs), np.int64, len(docs))
    doc_ends = np.cumsum(sizes)
    doc_starts = doc_ends - sizes
    ids = np.concatenate([x for _, x in docs]).astype("<u4")
    positions, penalties = candidates(ids, doc_ends, enders, grid, sentence_cut, forced_cut)
    cuts = positions[choose_cuts(positions, penalties, length, window_cost)]
    bounds = np.union1d(cuts, doc_ends)
    a, b = bounds[:-1], bounds[1:]
    doc, seq = np.searchsorted(doc_ends, a, side="right"), np.searchsorted(cuts, a, side="right") - 1
    raw = memoryview(ids.tobytes())
    return {"doc": doc, "start": a - doc_starts[doc], "length": b - a,
            "ids_crc32": np.fromiter((zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(a.tolist(), b.tolist())),
                                     np.int64, len(a)),
            "doc_tokens": sizes[doc], "sequence": seq, "offset": a - cuts[seq], "ids": (ids, a, b)}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, grid: int = 128, window_cost: float = 1.0,
         sentence_cut: float = 1.0, forced_cut: float = 6.0, block_tokens: int = 1 << 20,
         with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` and, with ``with_ids``, the piece's ``ids``.

    Null or empty text: the end id alone.  Null document ids come first and
    rows with equal ids are packed each for itself, ordered by the first 64
    characters, then a hash of the text; any number of them is dealt over tasks.  A text
    longer than a block is a block of its own.  Empty input: no rows.
    ``sequence_id`` is the partition's number times 2**33 plus a count, so it
    is unique and ascends with document order.  Only the two columns are read.
    """
    ordered = by_id(docs, id_col, text_col).select("doc_id", "text")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def solve(batches):
        enders = sentence_enders(tokenizer)
        sequence = TaskContext.get().partitionId() << 33
        end, block, tokens = np.array([end_id], np.uint32), [], 0

        def flush():
            nonlocal sequence
            x = pack_block(block, enders, length, grid, window_cost, sentence_cut, forced_cut)
            ids, a, b = x["ids"]
            names = pa.array([d for d, _ in block], pa.int64()).take(pa.array(x["doc"]))
            columns = [names, *(pa.array(x[k], pa.int64()) for k in ("start", "length", "ids_crc32", "doc_tokens")),
                       pa.array(x["sequence"] + sequence, pa.int64()), pa.array(x["offset"], pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(a, b[-1]), pa.int32()),
                                                        pa.array(ids.astype(np.int32))))
            sequence += int(x["sequence"][-1]) + 1
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for part in slices(batch, TEXTS_AT_ONCE):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    block.append((doc_id, np.concatenate([encode(tokenizer, text), end])))
                    tokens += len(block[-1][1])
                    if tokens >= block_tokens:
                        yield flush()
                        block, tokens = [], 0
        if block:
            yield flush()

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ordered.mapInArrow(solve, out + ", ids array<int>" * with_ids)
