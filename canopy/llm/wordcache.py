"""Exact ids of whole texts by a tokenizer that drops white space.

Such a tokenizer (lower-casing, pre-tokens of letters, single digits or other
signs, an end-of-word mark on the last symbol of each pre-token) never joins
anything across white space, so a text's ids are those of its white-space
delimited words in order.  The ids of known words are kept, and within a batch
each distinct word is looked up once.

A new word of ASCII and Latin-1 letters is cut into pre-tokens here and each
goes through the tiktoken engine, whose ids equal those of the tokenizers
library (tests compare both) at several times the speed: the vocabulary lists
every token in the order in which merges made it, and the end-of-word mark is
one more byte, which joins the byte before it ahead of all other merges.  Any
other word goes through the tokenizers library; special-token strings in a text are
ordinary text.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from canopy.llm.byte_bpe import byte_of_char
from canopy.llm.shared import quiet_threads

LONG_WORD = 48          # bytes; longer words are encoded each time and not kept
MAX_WORDS = 300_000     # a Python worker keeps twice as many words at most; the longest unused half goes
END = b"\xff"           # the end-of-word mark; no UTF-8 text has this byte
# Words whose pre-tokens are found without Unicode tables: printable ASCII and Latin-1 letters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_ENCODERS: dict[str, "WordEncoder"] = {}


def encoder(path: str) -> "WordEncoder":
    """The worker's encoder for a tokenizer file (built once per Python worker)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder(dict):
    """Ids of words (UTF-8), as little-endian uint32 bytes; a word that is asked for is learnt."""

    def __init__(self, path: str):
        super().__init__()
        self.before: dict[bytes, bytes] = {}
        quiet_threads()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.engine = _engine(json.loads(self.tokenizer.to_str())["model"])

    def __missing__(self, word: bytes) -> bytes:
        out = self.before.get(word)
        if out is not None:
            self[word] = out
            return out
        if self.engine and word.isalpha():  # ASCII letters: one pre-token
            low = word.lower()
            ids = self.engine.encode_single_piece(low + END) if low == word else None
            out = self[low] if ids is None else struct.pack(f"<{len(ids)}I", *ids)
        elif self.engine and word[:-1].isalpha() and b"!" <= word[-1:] <= b"~":  # letters and a sign: two
            out = self[word[:-1]] + self[word[-1:]]
        else:
            text = word.decode()
            if self.engine and _PLAIN.fullmatch(text):
                single = self.engine.encode_single_piece
                ids = [i for p in _PRETOKEN.findall(text.lower()) for i in single(p.encode() + END)]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONG_WORD:
            self[word] = out
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null: no ids.  Arrow cuts the words and numbers the
        distinct ones, so a word is looked up once however often it stands there."""
        if len(self) > MAX_WORDS:
            self.before = dict(self)
            self.clear()
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        ids = [self[w] for w in words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        flat = found.take(words.indices).flatten().to_numpy()
        ends = np.r_[0, np.cumsum(sizes[words.indices.to_numpy()])][split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _engine(model: dict):
    """The tiktoken engine of a tokenizers BPE model whose ids ascend in the order
    of its merges, after the single bytes; None for any other model."""
    import tiktoken
    mark, vocab, byte = model.get("end_of_word_suffix"), model.get("vocab", {}), byte_of_char()
    merges = [m if isinstance(m, str) else "".join(m) for m in model.get("merges", [])]
    made = [vocab.get(m.replace(" ", "")) for m in merges]
    if model.get("type") != "BPE" or not mark or model.get("dropout") or made != sorted(vocab.values())[-len(made):]:
        return None
    ranks = {}
    for piece, i in vocab.items():
        body = piece.removesuffix(mark)
        ranks[bytes(byte[c] for c in body) + END * (body != piece)] = i
    if len(ranks) != len(vocab) or any(bytes([b]) not in ranks or bytes([b]) + END not in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("word-bpe", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
