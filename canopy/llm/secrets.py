"""Secret scans, as SQL expressions only: patterns, and sliding-window entropy.

Patterns give the base spans (kinds assign, access, hex).  Beside them, every
long run of token characters is a candidate.  It belongs to the narrowest
character class that has all its characters; the class fixes the window and
the entropy in bits a character from which a window counts as random, set from
the size of its alphabet so that nearly all random windows reach it.  The
window slides over the candidate one character at a time: one count goes down,
one goes up, and the sum of c * log2(c) over the counts (fixed-point integers
from a table, so there is no rounding drift) follows by two differences.
Overlapping random windows join to one span of kind entropy.  Candidates that
the allow-list names are suppressed: UUIDs, paths of words, and placeholders or
sequences that leave no room for a whole window beside or between them.  So are
entropy spans inside a base span.

Positions count code points, ends are exclusive.  Everything is per row: no
shuffle, no Python.  Intermediate arrays pass through ``inline``, which keeps
the optimiser from repeating the scans for every use.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns (letters of the key names in either case).
KEY_NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"({KEY_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
MIN_VALUE = 12
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
DEVIATIONS = 3          # of a random window's entropy, how far below the mean still counts as random


def _bits(size: int, window: int = WINDOW) -> float:
    """Bits a character that nearly every random window over ``size`` letters reaches.

    The window's sum of c * log2(c) over the counts c of its letters has an exact mean
    and deviation: one count is binomial, two together are trinomial.
    """
    f = [c * math.log2(c) if c else 0.0 for c in range(window + 1)]
    p = 1 / size
    one = [math.comb(window, c) * p ** c * (1 - p) ** (window - c) for c in range(window + 1)]
    mean, square = (sum(w * x ** n for w, x in zip(one, f)) for n in (1, 2))
    both = sum(math.comb(window, a) * math.comb(window - a, b) * p ** (a + b) * (1 - 2 * p) ** (window - a - b) * f[a] * f[b]
               for a in range(window + 1) for b in range(window + 1 - a))
    deviation = math.sqrt(size * (square - mean ** 2) + size * (size - 1) * (both - mean ** 2))
    return round(math.log2(window) - (size * mean + DEVIATIONS * deviation) / window, 3)


_DIGITS, _UPPER, _LOWER, _SIGNS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "+/_=-"
# Class: characters, window, bits a character from which a window is random.  Narrowest first.
# Words in one case that signs join (slugs, paths) come near random windows of so many letters: higher limit.
CLASSES = (
    ("0123456789ABCDEFabcdef", WINDOW, 3.0),
    (_DIGITS + _LOWER, WINDOW, _bits(36)),
    (_DIGITS + _UPPER, WINDOW, _bits(32)),      # base32 is the least alphabet of these
    (_DIGITS + _UPPER + _LOWER, WINDOW, _bits(62)),
    (_DIGITS + _LOWER + _SIGNS, WINDOW, 3.9),
    (_DIGITS + _UPPER + _SIGNS, WINDOW, 3.9),
    (_DIGITS + _UPPER + _LOWER + _SIGNS, WINDOW, _bits(64)),
)
# A candidate must mix letters and digits: words of natural text are never random.
MIXED = ("[0-9]", "[A-Za-z]")
# Quantifiers are possessive, so that a match takes linear time and no stack however long the candidate is.
ALLOWED = (
    f"(?i)^(?:.{{0,{WINDOW - 1}}}?(?:example|placeholder|dummy|changeme|your[_-]|xxxx|0123456789|abcdefgh))++.{{0,{WINDOW - 1}}}$|"
    "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|"
    "^/?([a-z]++([_-][a-z]++)*+[_-]?+/)++([a-z]*+[0-9]{0,8}+([_-]|$))*+$|^[a-z]++([_-][a-z]++)*+[_-]?[0-9]{0,4}$"
)
POINT = 1 << 16


def _table(window: int) -> list[int]:
    return [round(c * math.log2(c) * POINT) if c else 0 for c in range(window + 1)]


def _limit(window: int, bits: float) -> int:
    """Largest sum of c * log2(c) with which a window has ``bits`` bits a character."""
    return math.floor(window * (math.log2(window) - bits) * POINT)


_SPAN = "struct<start:int,kind:int,end:int>"


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start,hit>> of the pattern's matches: their lengths and those of the gaps between add up to places."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,hit:string>>)").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        return F.struct((start + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
                        F.when(x["hit"].isNull(), acc["found"]).otherwise(
                            F.concat(acc["found"], F.array(F.struct(start.alias("start"), x["hit"].alias("hit")))))
                        .alias("found"))

    return F.aggregate(parts, empty, step, lambda acc: acc["found"])


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(
        x["start"], F.lit(KINDS.index(kind) + 1).alias("kind"), (x["start"] + F.length(x["hit"])).alias("end")))


def _random_runs(codes: Column, letters: str, window: int, bits: float) -> Column:
    """array<struct<start,end>> (within the candidate) of joined random windows; ``codes``: 1-based letter numbers."""
    table = F.array(*map(F.lit, _table(window)))
    limit = _limit(window, bits)
    start = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(letters)).alias("counts"),
                     F.lit(0).cast("long").alias("sum"),
                     F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("runs"))

    def moved(counts: Column, code: Column, by: int) -> Column:
        return F.transform(counts, lambda c, j: F.when(j == code - 1, c + by).otherwise(c))

    def step(acc: Column, code: Column) -> Column:
        gone = F.get(codes, acc["i"] - window)                      # the letter that leaves, null at first
        old = F.get(acc["counts"], gone - 1)
        less = F.coalesce(F.get(table, old - 1) - F.get(table, old), F.lit(0))
        counts = F.when(gone.isNull(), acc["counts"]).otherwise(moved(acc["counts"], gone, -1))
        have = F.get(acc["counts"], code - 1) - F.when(gone == code, 1).otherwise(0)
        total = acc["sum"] + less + F.get(table, have + 1) - F.get(table, have)
        i = acc["i"] + 1
        last = F.element_at(acc["runs"], -1)
        run = F.struct((i - window).alias("start"), i.alias("end"))
        runs = (F.when((i < window) | (total > limit), acc["runs"])
                .when((F.size(acc["runs"]) > 0) & (i - window <= last["end"]),
                      F.concat(F.slice(acc["runs"], 1, F.size(acc["runs"]) - 1),
                               F.array(F.struct(last["start"].alias("start"), i.alias("end")))))
                .otherwise(F.concat(acc["runs"], F.array(run))))
        return F.struct(i.alias("i"), moved(counts, code, 1).alias("counts"), total.cast("long").alias("sum"),
                        runs.alias("runs"))

    return F.aggregate(codes, start, step, lambda acc: acc["runs"])


def _class_spans(able: Column, n: int) -> Column:
    """Entropy spans of the candidates ``able`` whose narrowest class is the n-th."""
    letters, window, bits = CLASSES[n]

    def coded(x: Column) -> Column:
        codes = F.transform(F.regexp_extract_all(x["hit"], F.lit("."), F.lit(0)),
                            lambda ch: F.instr(F.lit(letters), ch))
        return F.struct(x["start"].alias("start"), codes.alias("codes"))

    def spans(x: Column) -> Column:
        return F.transform(_random_runs(x["codes"], letters, window, bits), lambda r: F.struct(
            (x["start"] + r["start"]).alias("start"), F.lit(KINDS.index("entropy") + 1).alias("kind"),
            (x["start"] + r["end"]).alias("end")))

    return F.flatten(F.transform(F.transform(F.filter(able, lambda x: x["class"] == n), coded), spans))


def _able(found: Column) -> Column:
    """array<struct<start,hit,class>> of the candidates ``found`` that may be random, with the number of their narrowest class."""
    def narrowest(hit: Column) -> Column:
        number = F.lit(len(CLASSES) - 1)
        for n in range(len(CLASSES) - 2, -1, -1):
            number = F.when(hit.rlike(f"^[{CLASSES[n][0]}]*$"), F.lit(n)).otherwise(number)
        return number

    mixed = F.filter(found, lambda x: x["hit"].rlike(MIXED[0]) & x["hit"].rlike(MIXED[1]) & ~x["hit"].rlike(ALLOWED))
    return F.transform(mixed, lambda x: F.struct(x["start"], x["hit"], narrowest(x["hit"]).alias("class")))


def _entropy(able: Column) -> Column:
    """Entropy spans of the candidates ``able``."""
    return F.concat(*(_class_spans(able, n) for n in range(len(CLASSES))))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """``doc_id, base, entropy`` and the columns named in ``keep``: the spans of
    every row, as arrays of (start, kind, end) by start, then kind.

    Null text: as the empty text, no spans.  One output row per input row,
    repeated rows and null ids included.  Empty table: no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hits = F.filter(_found(text, ASSIGN),
                    lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= MIN_VALUE)
    scans = F.struct(_spans(hits, "assign").alias("assign"), _spans(_found(text, ACCESS), "access").alias("access"),
                     _spans(_found(text, HEX), "hex").alias("hex"), _able(_found(text, CANDIDATE)).alias("candidates"))
    kept = [F.col(c) for c in keep]
    scanned = docs.select(F.col(id_col).alias("doc_id"), *kept, F.inline(F.array(scans)))
    spans = F.struct(F.array_sort(F.concat("assign", "access", "hex")).alias("base"), _entropy(F.col("candidates")).alias("found"))
    both = scanned.select("doc_id", *keep, F.inline(F.array(spans)))
    outside = F.filter("found", lambda e: ~F.exists("base", lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"])))
    return both.select("doc_id", *keep, "base", F.array_sort(outside).alias("entropy"))


def span_digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of the rows of ``find_secrets``."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind) + 1)).cast("long")

    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.array_sort(F.concat("base", "entropy"))).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mark``; overlapping spans share one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
                        .otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.array_sort(spans), start, step,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
