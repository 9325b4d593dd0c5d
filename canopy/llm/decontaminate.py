"""Benchmark decontamination by one Aho-Corasick automaton over words.

Texts are normalised to words: A-Z become a-z, and runs of ASCII letters,
digits and characters beyond ASCII are words.  A test item (question, answer)
gives windows: every ``window`` consecutive words of it, or all its words if
it has fewer.  All windows are patterns of one automaton over words, so a text
is scanned once, every occurrence of every window is found, and only where
something was found are places mapped back to characters of the original.  A
word goes in as a fixed number of letters, the digits of its number, each place
with letters of its own (so nothing matches across words); a node then has at
most ``BASE`` children, where it would have thousands if words were letters.

The items never pass through the driver: normalised, cut into segments of a
bounded number of words (neighbours share ``window - 1`` words), they are a table in
the shared folder, from which each worker builds its automaton.  A benchmark
with more segments than one automaton should hold is dealt into several
blocks; every text is then scanned once for each block, and what the blocks
find in a text is united.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.shared import cut, filesystem, scratch, slices

SEGMENT = 2000          # words of an item in a row
WINDOWS_A_BLOCK = 200_000   # of one automaton: 6 to 8 million nodes of 40 bytes
BASE = 32               # digits of a word's number
PIECE = 1 << 20         # bytes of a text that are scanned at once
TEXTS_AT_ONCE = 512
# A-Z to a-z, other ASCII characters that are no word's to blanks
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # the same words in the text as given


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


# -- items -----------------------------------------------------------------------

class Items(NamedTuple):
    folder: str     # of Parquet tables block=N (item, segment)
    blocks: int
    window: int


def write_items(benchmark: DataFrame, window: int = 10, windows_a_block: int = WINDOWS_A_BLOCK, id_col: str = "item_id",
                text_col: str = "text") -> Items:
    """The items' segments in a new shared folder; null texts have none, a null id counts as an empty one."""
    def segments(batches):
        for batch in batches:
            items, made = [], []
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1), SEGMENT):
                    if words:
                        items.append(item or "")
                        made.append(b" ".join(words[at:at + SEGMENT + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(made, pa.string())], names=["item", "segment"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    cut_up = cut(rows.mapInArrow(segments, "item string, segment string").distinct(), "benchmark-segments")
    size = cut_up.agg(F.sum(F.size(F.split("segment", " "))).alias("words")).first()["words"] or 0
    blocks = max(1, -(-size // windows_a_block))
    folder = scratch(benchmark.sparkSession, "benchmark-blocks")
    cut_up.withColumn("block", F.pmod(F.xxhash64("item", "segment"), F.lit(blocks)).cast("int")) \
        .repartition(blocks, "block").write.partitionBy("block").parquet(folder)
    return Items(folder, blocks, window)


# -- automaton -------------------------------------------------------------------

class Automaton:
    """All windows of a block: ``scan`` finds their occurrences in a list of words."""

    def __init__(self, items: Items, block: int):
        import ahocorasick
        self.window, self.owners = items.window, []
        number: dict[bytes, int] = {}
        windows: dict[tuple, dict] = {}
        for item, segment in _block_rows(items, block):
            ids = [number.setdefault(w, len(number)) for w in segment.encode().split()]
            for at in range(max(1, len(ids) - self.window + 1)):
                windows.setdefault(tuple(ids[at:at + self.window]), {})[item] = None
        self.width = 1
        while BASE ** self.width < len(number):
            self.width += 1
        codes = ["".join(chr(33 + place * BASE + n // BASE ** place % BASE) for place in range(self.width)) for n in range(len(number))]
        self.codes = dict(zip(number, codes))
        self.unknown = " " * self.width
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        shared: dict[tuple, int] = {}   # windows of the same items share a list
        window_owner = []
        for n, (key, owners) in enumerate(windows.items()):
            self.machine.add_word("".join(codes[w] for w in key), n)
            owners = tuple(owners)
            window_owner.append(shared.setdefault(owners, len(shared)))
            if len(shared) > len(self.owners):
                self.owners.append(owners)
        self.lengths = np.fromiter(map(len, windows), np.int64, len(windows))
        self.window_owner = np.array(window_owner, np.int64)
        if windows:
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """(words of the text, last word of each occurrence, its window), by pieces of bounded size."""
        if not text:
            return 0, _NONE, _NONE
        data = text.encode().translate(NORMAL)
        total, carry, ends, found = 0, [], [], []
        get, at, width, unknown = self.codes.get, 0, self.width, self.unknown
        while at < len(data):
            stop = len(data)
            if stop - at > PIECE:
                stop = data.rfind(b" ", at, at + PIECE) + 1 or data.find(b" ", at) + 1 or len(data)
            codes = [get(w, unknown) for w in data[at:stop].split()]
            if self.codes:
                start = total - len(carry)
                for end, n in self.machine.iter("".join([*carry, *codes])):
                    last = start + end // width
                    if last >= total:  # those that end in the carried words were found before
                        ends.append(last)
                        found.append(n)
            total += len(codes)
            carry = (carry + codes)[-(self.window - 1):] if self.window > 1 else []
            at = stop
        return total, np.array(ends, np.int64), np.array(found, np.int64)

    def items_of(self, found: np.ndarray) -> list[str]:
        """The items that have one of the windows."""
        return sorted(set().union(*(self.owners[i] for i in np.unique(self.window_owner[found]).tolist())))


_NONE = np.zeros(0, np.int64)


def _block_rows(items: Items, block: int):
    files, root = filesystem(items.folder)
    from pyarrow import fs
    folder = f"{root}/block={block}"
    if files.get_file_info(folder).type != fs.FileType.Directory:
        return
    for info in sorted(files.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=["item", "segment"]):
                    yield from zip(*(c.to_pylist() for c in batch.columns))


@lru_cache(1)
def automaton(items: Items, block: int) -> Automaton:
    """The worker's automaton of a block (one is held at a time)."""
    return Automaton(items, block)


def spans(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Union of closed ranges of words, as (first, last), ascending."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.r_[True, first[1:] > last[:-1] + 1]) if len(first) else _NONE
    ends = [*(new[1:] - 1).tolist(), len(first) - 1] if len(new) else []
    return list(zip(first[new].tolist(), last[ends].tolist() if ends else []))


def _characters(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """The ranges of words as code points (end exclusive) of the text as given."""
    out, at = [], 0
    for n, m in enumerate(WORD.finditer(text)):
        if n == runs[at][0]:
            out.append({"start": m.start(), "end": 0})
        if n == runs[at][1]:
            out[-1]["end"] = m.end()
            at += 1
            if at == len(runs):
                break
    return out


# -- Spark jobs ------------------------------------------------------------------

_RUNS = "array<struct<first:long,last:long>>"
_RUN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanned(rows: DataFrame, items: Items, block: int, key: str) -> DataFrame:
    """``key, n_words, runs, items`` of the texts in which the block's windows occur; of all texts for block 0."""
    def scan(batches):
        machine = automaton(items, block)
        for batch in (part for b in batches for part in slices(b, TEXTS_AT_ONCE)):
            kept, words, runs, owners = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                n, ends, found = machine.scan(text)
                if block == 0 or len(found):
                    kept.append(i)
                    words.append(n)
                    runs.append([{"first": a, "last": b} for a, b in spans(ends - machine.lengths[found] + 1, ends)] if len(found) else [])
                    owners.append(machine.items_of(found) if len(found) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(words, pa.int64()),
                                              pa.array(runs, _RUN_TYPE), pa.array(owners, pa.list_(pa.string()))],
                                             names=[key, "n_words", "runs", "items"])

    return rows.select(key, "text").mapInArrow(scan, f"{key} long, n_words long, runs {_RUNS}, items array<string>")


def _columns(n_words, runs, owners, texts, with_spans: bool) -> list[pa.Array]:
    hits, names, counts, digests, places = [], [], [], [], []
    for run, own, text in zip(runs, owners, texts):
        first, last = (np.array([r[k] for r in run], np.int64) for k in ("first", "last"))
        union = spans(first, last)
        hits.append(sum(b - a + 1 for a, b in union))
        own = sorted(set(own))
        names.append(own)
        counts.append(len(own))
        digests.append(hashlib.sha256(",".join(own).encode()).hexdigest())
        places.append(_characters(text, union) if with_spans and union else [])
    out = [pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
           pa.array([h > 0 for h in hits], pa.bool_())]
    return [*out, pa.array(places, _SPAN_TYPE), pa.array(names, pa.list_(pa.string()))] if with_spans else out


_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_MORE = ", spans array<struct<start:long,end:long>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, windows_a_block: int = WINDOWS_A_BLOCK,
                  with_spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of each document.

    ``n_hit``: words inside any occurrence of a window of any item; ``n_items``:
    items with occurring windows; ``items_sha256``: of their ids, sorted as
    strings, comma-joined.  ``with_spans`` adds ``spans`` (code points of the
    original text, end exclusive, each a run of hit words) and ``items`` (the ids).

    Null text: no words.  Rows that repeat an id are documents of their own;
    items that share an id are one item; a null item_id is an empty one.  No
    item (or only wordless ones): nothing is contaminated.  An empty table
    gives no row.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = write_items(benchmark, window, windows_a_block)
    schema = _OUT + (_MORE if with_spans else "")
    names = [p.split()[0] for p in schema.split(", ")]

    if items.blocks == 1:
        def once(batches):
            machine = automaton(items, 0)
            for batch in (part for b in batches for part in slices(b, TEXTS_AT_ONCE)):
                texts, words, runs, owners = batch.column(1).to_pylist(), [], [], []
                for text in texts:
                    n, ends, found = machine.scan(text)
                    words.append(n)
                    runs.append([{"first": a, "last": b} for a, b in spans(ends - machine.lengths[found] + 1, ends)] if len(found) else [])
                    owners.append(machine.items_of(found) if len(found) else [])
                yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(words, runs, owners, texts, with_spans)], names=names)

        return rows.mapInArrow(once, schema)

    # Several blocks: a scan each over texts with a row number, then the few rows with finds come together.
    numbered = cut(rows.withColumn("row_no", F.monotonically_increasing_id()), "decontaminate-texts")
    found = _scanned(numbered, items, 0, "row_no")
    for block in range(1, items.blocks):
        found = found.unionByName(_scanned(numbered, items, block, "row_no"))
    united = (cut(found, "decontaminate-found").groupBy("row_no")
              .agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"),
                   F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))

    def unite(batches):
        for batch in batches:
            texts = batch.column(4).to_pylist() if with_spans else [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(*(batch.column(i).to_pylist() for i in (1, 2, 3)), texts, with_spans)],
                                             names=names)

    text = F.col("text") if with_spans else F.lit(None).cast("string").alias("text")
    return (numbered.select("row_no", "doc_id", text).join(united, "row_no")
            .select("doc_id", "n_words", "runs", "items", "text").mapInArrow(unite, schema))
