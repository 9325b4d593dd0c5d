"""Edit-aware token counts: a segment tree over each document's pre-tokens.

``build_trees`` cuts every text into pre-tokens and keeps, per document, the
leaves of a segment tree: runs of pre-tokens with their characters and token
counts.  ``apply_edits`` takes documents with their trees and edits and
re-encodes only what an edit can have changed:

* descending by character sums finds the leaves an edit touches;
* one non-empty leaf before them is taken as context: the cut between two
  pre-tokens depends on one character after it at most, so the cut in front
  of that leaf stays;
* the edited stretch is cut into pre-tokens again together with the leaf after
  it.  If a cut falls where the old leaf ended, everything behind is as it was
  (cutting goes left to right); else the stretch grows by a leaf;
* its new pre-tokens are dealt over the same leaves, and the sums on their
  paths to the root are updated.  The root holds the document's token count.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.byte_bpe import PATTERN, engine
from canopy.llm.shared import slices

LEAF = 64              # pre-tokens of a new leaf
LONG_WORD = 48         # longer pre-tokens are counted each time and not kept
MAX_WORDS = 300_000    # kept pre-tokens per Python worker; the cache restarts when full
TEXTS_AT_ONCE = 256
EDITS = "array<struct<pos:int,len:int,insert:string>>"


@lru_cache(1)
def _pattern():
    import regex
    return regex.compile(PATTERN)


class Counter:
    """Token counts of pre-tokens, those of frequent ones kept."""

    def __init__(self, tokenizer: str):
        self.encode = engine(tokenizer).encode_ordinary
        self.known: dict[str, int] = {}

    def of(self, pretokens: list[str]) -> int:
        known, total = self.known, 0
        for p in pretokens:
            n = known.get(p)
            if n is None:
                n = len(self.encode(p))
                if len(p) <= LONG_WORD:
                    if len(known) >= MAX_WORDS:
                        known.clear()
                    known[p] = n
            total += n
        return total


@lru_cache(2)
def _counter(tokenizer: str) -> Counter:
    return Counter(tokenizer)


def split(text: str) -> list[str]:
    return _pattern().findall(text)


def new_leaves(text: str, counter: Counter) -> tuple[list[int], list[int]]:
    """(characters, tokens) of the leaves of a text."""
    pretokens = split(text)
    runs = [pretokens[i:i + LEAF] for i in range(0, len(pretokens), LEAF)]
    return [sum(map(len, r)) for r in runs], [counter.of(r) for r in runs]


class SegmentTree:
    """Sums of characters and tokens over a document's leaves; leaf texts are slices of ``parts``."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], counter: Counter):
        self.counter, self.base = counter, 1
        n = max(1, len(chars))
        while self.base < n:
            self.base *= 2
        self.leaves, at = n, 0
        self.parts = []
        for c in chars or [0]:
            self.parts.append(text[at:at + c])
            at += c
        self.chars = [0] * (2 * self.base)
        self.tokens = [0] * (2 * self.base)
        self.chars[self.base:self.base + len(chars)] = chars
        self.tokens[self.base:self.base + len(tokens)] = tokens
        for i in range(self.base - 1, 0, -1):
            self._sum(i)
        self.reencoded = 0

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, pos: int) -> tuple[int, int]:
        """(leaf, characters before it) of a character; a position at the end is in the last leaf."""
        if pos >= self.chars[1]:
            return self.leaves - 1, self.chars[1] - self.chars[self.base + self.leaves - 1]
        i, before = 1, 0
        while i < self.base:
            i *= 2
            if pos - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.base, before

    def edit(self, pos: int, size: int, insert: str) -> None:
        """Replace ``size`` characters from ``pos`` by ``insert``; what lies outside the text is cut off."""
        pos = min(max(pos, 0), self.chars[1])
        end = min(pos + max(size, 0), self.chars[1])
        lo, before = self.find(pos)
        hi = max(lo, self.find(end)[0])
        while lo > 0:  # one leaf with text as context
            lo -= 1
            before -= len(self.parts[lo])
            if self.parts[lo]:
                break
        while True:
            stretch = "".join(self.parts[lo:hi + 1])
            edited = stretch[:pos - before] + insert + stretch[end - before:]
            after = hi + 1
            while after < self.leaves and not self.parts[after]:
                after += 1
            follows = self.parts[after] if after < self.leaves else ""
            cut, done, own = [], 0, len(edited)
            for p in split(edited + follows):
                if done >= own:
                    break
                cut.append(p)
                done += len(p)
            self.reencoded += own
            if done == own:
                break
            hi = after
        each = -(-len(cut) // (hi - lo + 1))
        for n, leaf in enumerate(range(lo, hi + 1)):
            run = cut[n * each:(n + 1) * each]
            self.parts[leaf] = "".join(run)
            self.chars[self.base + leaf] = len(self.parts[leaf])
            self.tokens[self.base + leaf] = self.counter.of(run)
        touched = {(self.base + leaf) // 2 for leaf in range(lo, hi + 1)} - {0}
        while touched:
            for i in touched:
                self._sum(i)
            touched = {i // 2 for i in touched} - {0}

    def state(self) -> tuple[str, list[int], list[int]]:
        b = self.base
        return "".join(self.parts), self.chars[b:b + self.leaves], self.tokens[b:b + self.leaves]


def build_trees(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                edits_col: str | None = None) -> DataFrame:
    """``doc_id, text, leaf_chars, leaf_tokens, n_tokens`` (and ``edits``) of every row.

    Null text: as the empty text, which has no leaves and no tokens.
    """
    edits = F.col(edits_col) if edits_col else F.lit(None)

    def run(batches):
        counter = _counter(tokenizer)
        for batch in batches:
            for part in slices(batch, TEXTS_AT_ONCE):
                texts = [t or "" for t in part.column(1).to_pylist()]
                leaves = [new_leaves(t, counter) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array([c for c, _ in leaves], pa.list_(pa.int32())),
                     pa.array([t for _, t in leaves], pa.list_(pa.int32())),
                     pa.array([sum(t) for _, t in leaves], pa.int64()), part.column(2)],
                    names=["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "edits"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        edits.cast(EDITS).alias("edits"))
            .mapInArrow(run, "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, "
                             f"n_tokens long, edits {EDITS}"))


def apply_edits(trees: DataFrame, tokenizer: str, with_trees: bool = True) -> DataFrame:
    """Apply each row's ``edits`` in order, positions counted in the text as it then is.

    ``trees``: rows of ``build_trees``, or of an earlier call here with new
    edits.  Returns ``doc_id, n_tokens_before, n_edits, n_tokens, n_chars,
    n_chars_reencoded`` and, with ``with_trees``, the edited ``text,
    leaf_chars, leaf_tokens``.  Null edits, null entries: nothing to do; null
    numbers count as 0 and a null insertion as empty.
    """
    kept = [("text", pa.string()), ("leaf_chars", pa.list_(pa.int32())), ("leaf_tokens", pa.list_(pa.int32()))]
    fields = [(n, pa.int64()) for n in ("doc_id", "n_tokens_before", "n_edits", "n_tokens", "n_chars",
                                        "n_chars_reencoded")] + kept * with_trees
    schema = pa.schema(fields)

    def run(batches):
        counter = _counter(tokenizer)
        for batch in batches:
            for part in slices(batch, TEXTS_AT_ONCE):
                rows = []
                for r in part.to_pylist():
                    tree = SegmentTree(r["text"] or "", r["leaf_chars"] or [], r["leaf_tokens"] or [], counter)
                    edits = [e for e in r["edits"] or [] if e]
                    before = tree.tokens[1]
                    for e in edits:
                        tree.edit(e["pos"] or 0, e["len"] or 0, e["insert"] or "")
                    row = (r["doc_id"], before, len(edits), tree.tokens[1], tree.chars[1], tree.reencoded)
                    rows.append(row + tree.state() if with_trees else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    names = {"string": "string", "int64": "long"}
    return (trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits")
            .mapInArrow(run, ", ".join(f"{f.name} {names.get(str(f.type), 'array<int>')}" for f in schema)))


def edited_counts(docs: DataFrame, tokenizer: str, edits_col: str = "edits", id_col: str = "doc_id",
                  text_col: str = "text", with_trees: bool = False) -> DataFrame:
    """Build the trees and apply the edits.  One row per input row, no shuffle;
    columns other than id, text and edits are not read.  Empty table: no rows."""
    return apply_edits(build_trees(docs, tokenizer, id_col, text_col, edits_col), tokenizer, with_trees)


def planned_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, edits``: three edits for every document at places that
    follow from its id: an insertion, a deletion and a replacement."""
    size = F.coalesce(F.length(text_col), F.lit(0))

    def place(k: int):
        return F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(k)), size + 1).cast("int")

    def one(k: int, n: int, insert: str):
        return F.struct(place(k).alias("pos"), F.lit(n).alias("len"), F.lit(insert).alias("insert"))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.array(one(0, 0, " newly added words"), one(1, 7, ""), one(2, 5, "it's 42")).alias("edits"))
