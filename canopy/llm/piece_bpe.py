"""SentencePiece merge-type encoding by backtracking, and decoding.

The model file gives pieces with scores: the encoding is what repeated merging
makes of a text, the neighbouring pair whose joined piece scores best first,
the leftmost among equals.  It is found without merging the text:

* an Aho-Corasick automaton over the pieces gives, at every character, the
  pieces that start there, longest first;
* the longest is tried first.  It may follow the piece before it only if the
  two are compatible: merging their joined characters again gives just those
  two pieces (answers are kept per pair);
* a shorter piece is tried where the longest does not fit; where none fits,
  the position is marked in a bitfield of failed positions, the last piece is
  taken back, and pieces that end at a failed position are not tried again.
  Each position fails once at most, so the work is linear in the text.

No piece holds a space mark after another character, so a text is encoded
word by word and the ids of frequent words are kept.  Runs of space marks are
the exception to the rule above: the pieces for them share one score, so which
of two overlapping merges comes first depends on what stands around, and a
word with such a run in front is merged directly (``_Model.merge``).
Characters that no piece has become byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.shared import slices

SPACE = "▁"        # fixed value: the mark that stands for a space in pieces
NORMAL, CONTROL, BYTE = 1, 3, 6  # fixed values: piece types of the model format
SHORT_TEXT = 48         # characters up to which merging keeps its scores in a list
LONG_WORD = 64          # longer words are encoded each time and not kept
MAX_WORDS = 400_000     # kept words per Python worker; the cache restarts when full
TEXTS_AT_ONCE = 256
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]*")


@lru_cache(2)
def model(path: str) -> "_Model":
    return _Model(path)


class _Model:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb
        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only merge models that keep the text as it is are supported")
        self.pieces = [p.piece for p in spec.pieces]
        self.types = [p.type for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans words")
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.end_id = next(i for i, p in enumerate(spec.pieces) if p.piece == "</s>")
        self.number = {p: str(i) for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[str, str] = {}  # the longest shorter piece that a piece begins with
        for piece in self.ids:
            if len(piece) > 1:  # a single character is the default
                self.automaton.add_word(piece, len(piece))
                begin = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids), None)
                if begin:
                    self.shorter[piece] = begin
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[str, str]] = {}

    # -- encoding ----------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Pieces of a text by merging, best score and then leftmost first."""
        n = len(text)
        if n <= SHORT_TEXT:
            return self._merge_short(list(text))
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        size, heap = [1] * n, []

        def offer(i: int) -> None:
            j = right[i]
            if j < n:
                score = self.scores.get(text[i:j + size[j]])
                if score is not None:
                    heapq.heappush(heap, (-score, i, size[i], size[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = i + a
            if size[i] != a or j >= n or size[j] != b:  # one of the two has been merged since
                continue
            size[i], size[j], right[i] = a + b, 0, right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [text[i:i + s] for i, s in enumerate(size) if s]

    def _merge_short(self, parts: list[str]) -> list[str]:
        """The same without a heap: the scores of all neighbours in a list."""
        get, none = self.scores.get, float("-inf")
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) != none:
            k = scores.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def compatible(self, a: str, b: str) -> bool:
        if (a, b) not in self.pairs:
            if len(self.pairs) > 4 * MAX_WORDS:
                self.pairs.clear()
            self.pairs[a, b] = self.merge(a + b) == [a, b]
        return self.pairs[a, b]

    def backtrack(self, word: str) -> list[str]:
        """Pieces of a word; a character that no piece has stands alone."""
        if word in self.ids:  # the longest match covers it
            return [word]
        n = len(word)
        longest = [1] * n  # size of the longest piece that starts at each character: ends ascend, so the last stays
        for end, size in self.automaton.iter(word):
            longest[end - size + 1] = size
        failed = None  # bitfield of positions from which no encoding goes on
        pairs, shorter = self.pairs, self.shorter
        out: list[str] = []
        before, at = None, 0
        piece = word[:longest[0]]
        while True:
            end = at + len(piece)
            if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                fits = before is None or pairs.get((before, piece))
                if fits is None:
                    fits = self.compatible(before, piece)
                if fits:
                    out.append(piece)
                    if end == n:
                        return out
                    before, at, piece = piece, end, word[end:end + longest[end]]
                    continue
            piece = shorter.get(piece)
            if piece is None:  # none fits here: mark it and take the last piece back, whose end has now failed
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                failed = failed or bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                before = out[-1] if out else None

    def word_pieces(self, word: str) -> list[str]:
        return self.merge(word) if word.startswith(2 * SPACE) else self.backtrack(word)

    def piece_ids(self, pieces: list[str]) -> list[int]:
        """Ids of pieces; a character that is none has the ids of its bytes."""
        out: list[int] = []
        for piece in pieces:
            if piece in self.ids:
                out.append(self.ids[piece])
            else:
                out += [self.bytes[b] for b in piece.encode()]
        return out

    # -- decoding ----------------------------------------------------------

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids.  ``first``: these ids start the text, so the space put
        in front of every text goes.  Control pieces vanish; bytes that are no
        UTF-8 become replacement characters."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(raw))
                raw.clear()
            if self.types[i] == CONTROL:
                continue
            piece = self.pieces[i] if self.types[i] == NORMAL else " ⁇ "
            if first and not out and piece.startswith(SPACE):
                piece = piece[1:]
            first = False
            out.append(piece.replace(SPACE, " "))
        if raw:
            out.append(_utf8(raw))
        return "".join(out)

    # -- whole texts -------------------------------------------------------

    def words(self, text: str) -> list[str]:
        marked = SPACE + text.replace(" ", SPACE)
        if 2 * SPACE in marked or marked.endswith(SPACE):
            return _WORDS.findall(marked)[:-1]
        return [SPACE + w for w in marked[1:].split(SPACE)]

    def learn(self, words) -> None:
        for w in words:
            pieces = self.word_pieces(w)
            try:
                ids = " ".join([self.number[p] for p in pieces])
                text = "".join(pieces).replace(SPACE, " ")  # the pieces of those ids
            except KeyError:
                numbers = self.piece_ids(pieces)
                ids, text = " ".join(map(str, numbers)), self.decode(numbers, first=False)
            self.known[w] = ids, text

    def encode_decode(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """(ids as decimal numbers joined by spaces, text decoded from those ids) of each text."""
        split = [self.words(t) if t else [] for t in texts]
        if len(self.known) > MAX_WORDS:
            self.known = {}
        new = set().union(*split).difference(self.known)
        self.learn(new)
        out = []
        for words in split:
            both = [self.known[w] for w in words]
            decoded = "".join([d for _, d in both])
            out.append((" ".join([i for i, _ in both]), decoded[1:]))  # the first piece starts with the mark
        for w in new:
            if len(w) > LONG_WORD:
                del self.known[w]
        return out


def _utf8(raw: bytearray) -> str:
    return "".join(_utf8_runs(bytes(raw)))


def _utf8_runs(raw: bytes):
    """Valid characters as they are, every other byte as one replacement character."""
    at = 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                yield raw[at:at + size].decode()
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            yield "�"
            at += 1


def encode_texts(docs: DataFrame, model_path: str, with_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text and, with
    ``with_ids``, ``ids`` and ``decoded`` themselves.

    The end id follows the ids of every text.  Null or empty text: that id
    alone, decoded as the empty text.  One output row per input row, repeated
    rows and null ids included; only the two columns are read.  No shuffle.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
              ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_ids
    schema = pa.schema(fields)

    def run(batches):
        m = model(model_path)
        for batch in batches:
            for part in slices(batch, TEXTS_AT_ONCE):
                made = m.encode_decode(part.column(1).to_pylist())
                ids = [f"{i} {m.end_id}" if i else str(m.end_id) for i, _ in made]
                columns = [part.column(0), pa.array([i.count(" ") + 1 for i in ids], pa.int64()),
                           pa.array([hashlib.sha256(i.encode()).hexdigest() for i in ids]),
                           pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in made])]
                if with_ids:
                    columns += [pa.array([list(map(int, i.split())) for i in ids], pa.list_(pa.int32())),
                                pa.array([d for _, d in made])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, out + ", ids array<int>, decoded string" * with_ids))
