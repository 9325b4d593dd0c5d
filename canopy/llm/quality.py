"""Quality rules, line first: rules judge each line, failing lines go, and a
document that loses too much of its text with them is rejected.

Lines are the parts of a text between newlines; lines without a word pass and
count for nothing.  A line fails by the first rule that holds:

* ``boilerplate``: it has a phrase of legal, consent or licence text for every
  ``PHRASE_SPAN`` words or fewer;
* ``navigation``: three or more menu separators, one for every
  ``SEPARATOR_SPAN`` words or fewer, or few words that begin with a menu word;
* ``punctuation``: more than ``max_symbols`` symbol characters a word, or
  ``min_line_words`` words or more without a sentence sign at the end, unless
  the line is long (over ``LONG_LINE`` words) and has ends of sentences inside:
  a different word that ends one for every ``SENTENCE_SPAN`` words or fewer.

A document is kept if the base measures pass, at least ``min_kept`` of its
words stand in lines that pass, and these lines have ``min_words`` words.
Base: fewer than ``min_words`` words, or over ``max_repeat`` percent of the
words in 8-word windows that occur twice or more, fails.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.shared import slices

SYMBOLS = b"#*$%&|<>"           # fixed value
WHITE = b" \t\n\v\f\r"          # fixed value: characters between words
WINDOW = 8                      # words
TEXTS_AT_ONCE = 256
PHRASE_SPAN = 24                # words
SEPARATOR_SPAN = 8              # words
SENTENCE_SPAN = 30              # words
LONG_LINE = 12                  # words

SEPARATORS = re.compile(rb"[|>]|\xc2\xbb|\xe2\x80\xba|\xc2\xb7|\xe2\x80\xa2")
MENU = re.compile(rb"(?:home|menu|log ?in|log ?out|sign ?(?:in|up)|register|next|previous|back to top|skip to|share|"
                  rb"search|contact us|about us|site ?map|read more|follow us)\b")
PHRASES = re.compile(rb"cookie(?:s| policy)|privacy policy|terms of (?:use|service)|all rights reserved|\bcopyright\b|"
                     rb"licensed under|spdx-license|permission is hereby granted|subscribe to our|enable javascript|"
                     rb"lorem ipsum|click here")
SENTENCE_SIGNS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", b"]", "…".encode(), "”".encode(), "’".encode(),
                  "»".encode(), "。".encode(), "！".encode(), "？".encode())
SENTENCE_END = re.compile("(?:[.!?…][\"')\\]”’»]*$)|[。！？]")


def ends_of_sentences(line: bytes) -> int:
    """Different words of a line with which a sentence ends."""
    return sum(SENTENCE_END.search(w.decode()) is not None for w in set(line.split()))


def repeat_words(words: list[bytes]) -> int:
    """Words in 8-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    mixed = (ids + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        total = total * np.uint64(0xBF58476D1CE4E5B9) + mixed[k:k + n]
    if len(np.unique(total)) == n:  # all sums differ, so all windows do
        return 0
    rank = ids  # exact: ranks of 2-, 4- and 8-word windows
    for step in (1, 2, 4):
        rank = np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]
    twice = np.bincount(rank)[rank] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def line_fault(line: bytes, words: int, max_symbols: float, min_line_words: int) -> str | None:
    low = line.lower()
    if PHRASES.search(low) and PHRASE_SPAN * len(PHRASES.findall(low)) >= words:
        return "boilerplate"
    separators = len(SEPARATORS.findall(low))
    if separators >= 3 and SEPARATOR_SPAN * separators >= words or words <= 6 and MENU.match(low.lstrip()):
        return "navigation"
    if len(line) - len(line.translate(None, SYMBOLS)) > max_symbols * words:
        return "punctuation"
    if words >= min_line_words and not line.rstrip().endswith(SENTENCE_SIGNS) \
            and (words <= LONG_LINE or SENTENCE_SPAN * ends_of_sentences(line) < words):
        return "punctuation"
    return None


def judge(text: str | None, min_words: int, max_repeat: float, min_kept: float, max_symbols: float,
          min_line_words: int) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    lines = raw.split(b"\n")
    seen, dup, kept_words, failed = set(), 0, 0, 0
    kept: list[bytes] = []
    for line in lines:
        n = len(line.split())
        if n:
            dup += line in seen
            seen.add(line)
            if line_fault(line, n, max_symbols, min_line_words):
                failed += 1
                continue
            kept_words += n
        kept.append(line)
    repeated = repeat_words(words)
    base_failed = len(words) < min_words or 100 * repeated > max_repeat * len(words)
    verdict = not base_failed and kept_words >= max(min_words, min_kept * len(words))
    white = len(raw) - len(raw.translate(None, WHITE))
    return (len(words), len(text or "") - white, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeated,
            base_failed, verdict, failed, kept_words, b"\n".join(kept).decode())


def clean_lines(docs: DataFrame, min_words: int = 20, max_repeat: float = 30, min_kept: float = 0.5,
                max_symbols: float = 0.2, min_line_words: int = 4, with_text: bool = True, keep: list[str] = (),
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_failed_lines, kept_words`` and, with ``with_text``, ``clean_text`` of every row,
    then the columns named in ``keep`` (no names of those before).

    Null or empty text: no words, so ``base_failed``; its clean text is empty.
    One output row per input row, repeated rows and null ids included; only
    the named columns are read.  No shuffle.
    """
    kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
             ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
             ("kept", pa.bool_()), ("n_failed_lines", pa.int64()), ("kept_words", pa.int64())]
    kinds += [("clean_text", pa.string())] * with_text
    schema = pa.schema(kinds)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      *(F.col(c) for c in keep))
    passed = own.select(*keep).schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, TEXTS_AT_ONCE):
                made = [judge(t, min_words, max_repeat, min_kept, max_symbols, min_line_words)
                        for t in part.column(1).to_pylist()]
                columns = list(zip(*made))[:len(kinds) - 1]
                arrays = [part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))]
                yield pa.RecordBatch.from_arrays([*arrays, *part.columns[2:]], names=[*schema.names, *keep])

    ddl = {"int64": "long", "bool": "boolean", "string": "string"}
    made = T._parse_datatype_string(", ".join(f"{f.name} {ddl[str(f.type)]}" for f in schema))
    return own.mapInArrow(run, T.StructType([*made.fields, *passed.fields]))
