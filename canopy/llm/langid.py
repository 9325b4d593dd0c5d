"""Language identification: a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``STEPS`` bytes.  Over each window one
gated recurrent unit runs forwards and one backwards; both states at a byte
give the probabilities of the languages there, so every byte is labelled with
both sides of its window in view.  A document's probability of a language is
the softmax of the mean, over all its letter bytes, of the log-probabilities
(times ``sharpness``); all windows of the whole text count.

Training is backpropagation through time in numpy, on the driver, over a
bounded sample: at most ``docs_per_language`` documents of each language, and
``windows_per_doc`` windows of each.  They are the ones with the least hash of
their id, so the sample is the same at every run.  The weights (a few
thousand numbers) go to the tasks with the function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.shared import slices

STEPS = 48              # bytes of a window
LANES = 8192            # windows that advance together
PAD = 0                 # byte in the unused end of a window
TEXTS_AT_ONCE = 256
_EDGE = np.array([b in b" \t\n\v\f\r.,;:!?0123456789()[]{}<>|*#$%&/\\\"'=_+-" for b in range(256)])


# -- network -------------------------------------------------------------------

def initial(hidden: int, languages: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {}
    for d in ("f", "b"):
        out[f"x{d}"] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)  # input weights, a column a byte, bias included
        out[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)
    out["o"] = rng.normal(0, 0.3, (languages, 2 * hidden)).astype(np.float32)
    out["c"] = np.zeros((languages, 1), np.float32)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_gru(x: np.ndarray, u: np.ndarray, data: np.ndarray, back: bool, trace: list | None = None) -> np.ndarray:
    """States (steps, hidden, lanes) after each byte of ``data`` (steps, lanes).

    update z, reset r = sigmoid(x + u h);  n = tanh(x + r * (u h));  h = n + z (h - n)
    """
    hidden = u.shape[1]
    steps, lanes = data.shape
    out = np.empty((steps, hidden, lanes), np.float32)
    h = np.zeros((hidden, lanes), np.float32)
    for t in (range(steps - 1, -1, -1) if back else range(steps)):
        a = x.take(data[t], axis=1)
        b = u @ h
        gates = _sigmoid(a[:2 * hidden] + b[:2 * hidden])
        z, r = gates[:hidden], gates[hidden:]
        n = np.tanh(a[2 * hidden:] + r * b[2 * hidden:])
        if trace is not None:
            trace.append((t, h, z, r, n, b[2 * hidden:]))
        h = n + z * (h - n)
        out[t] = h
    return out


def log_probabilities(p: dict, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-probabilities (steps, languages, lanes), states of both directions)."""
    states = np.concatenate([run_gru(p["xf"], p["uf"], data, False), run_gru(p["xb"], p["ub"], data, True)], axis=1)
    logits = p["o"] @ states + p["c"]
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits, states


def gradients(p: dict, data: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy of all bytes with weight, and its gradients, by backpropagation through time."""
    hidden = p["uf"].shape[1]
    traces: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([run_gru(p["x" + d], p["u" + d], data, d == "b", traces[d]) for d in "fb"], axis=1)
    logits = p["o"] @ states + p["c"]
    logits -= logits.max(axis=1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=1, keepdims=True)
    total = max(1.0, float(weight.sum()))
    lanes = np.arange(len(labels))
    loss = -float((np.log(prob[:, labels, lanes] + 1e-9) * weight).sum()) / total
    delta = prob
    delta[:, labels, lanes] -= 1
    delta *= weight[:, None, :] / total
    g = {"o": np.einsum("tkl,thl->kh", delta, states), "c": delta.sum(axis=(0, 2))[:, None]}
    down = np.einsum("kh,tkl->thl", p["o"], delta)
    for d, part in (("f", slice(0, hidden)), ("b", slice(hidden, 2 * hidden))):
        u = p["u" + d]
        gx, gu = np.zeros_like(p["x" + d]), np.zeros_like(u)
        dh = np.zeros((hidden, data.shape[1]), np.float32)
        for t, h, z, r, n, bn in reversed(traces[d]):
            dh = dh + down[t, part]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * bn * r * (1 - r)
            da = np.concatenate([dz, dr, dn])
            db = np.concatenate([dz, dr, dn * r])
            np.add.at(gx.T, data[t], da.T)
            gu += db @ h.T
            dh = dh * z + u.T @ db
        g["x" + d], g["u" + d] = gx, gu
    return loss, g


def train(data: np.ndarray, labels: np.ndarray, languages: int, hidden: int, epochs: int, rate: float = 0.01,
          batch: int = 256, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights after ``epochs`` over the windows ``data`` (windows, steps), by Adam."""
    p = initial(hidden, languages, seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    rng = np.random.default_rng(seed)
    step, total = 0, epochs * -(-len(data) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            own = np.ascontiguousarray(data[pick].T)
            _, g = gradients(p, own, labels[pick], (~_EDGE[own] & (own != PAD)).astype(np.float32))
            step += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * (1 - step / (total + 1)) * min(1.0, 1.0 / max(norm, 1e-9))
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - now * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return p


# -- texts ---------------------------------------------------------------------

def windows(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows (n, STEPS), the text each belongs to) of all bytes of all texts."""
    counts = np.fromiter((-(-len(r) // STEPS) for r in raws), np.int64, len(raws))
    out = np.full(int(counts.sum()) * STEPS, PAD, np.uint8)
    at = 0
    for r, n in zip(raws, counts.tolist()):
        out[at:at + len(r)] = np.frombuffer(r, np.uint8)
        at += n * STEPS
    return out.reshape(-1, STEPS), np.repeat(np.arange(len(raws)), counts)


def with_letter(texts: list[str | None]) -> np.ndarray:
    return np.fromiter((any(map(str.isalpha, t or "")) for t in texts), bool, len(texts))


def predict(p: dict, texts: list[str | None], sharpness: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of the likeliest language or -1, its probability) of each text; -1: no letter."""
    raws = [(t or "").encode() for t in texts]
    data, owner = windows(raws)
    languages = len(p["c"])
    sums, sizes = np.zeros((len(texts), languages)), np.zeros(len(texts))
    for at in range(0, len(data), LANES):
        own = np.ascontiguousarray(data[at:at + LANES].T)
        weight = (~_EDGE[own] & (own != PAD)).astype(np.float32)
        logs, _ = log_probabilities(p, own)
        logs *= weight[:, None, :]
        np.add.at(sums, owner[at:at + LANES], logs.sum(axis=0).T)
        np.add.at(sizes, owner[at:at + LANES], weight.sum(axis=0))
    mean = sums / np.maximum(sizes, 1)[:, None] * sharpness
    mean -= mean.max(axis=1, keepdims=True)
    prob = np.exp(mean)
    prob /= prob.sum(axis=1, keepdims=True)
    best = prob.argmax(axis=1)
    letters = with_letter(texts)
    return np.where(letters, best, -1), np.where(letters, prob.max(axis=1), 0.0)


# -- Spark jobs ----------------------------------------------------------------

def held_out(id_col: str = "doc_id"):
    """Rows that training must not see: crc32 of the id as text leaves 2 modulo 4, or the id is null."""
    crc = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(True))


def spread_windows(text: str | None, n: int) -> np.ndarray:
    """At most ``n`` windows of a text, evenly spaced."""
    own, _ = windows([(text or "").encode()])
    return own[np.linspace(0, len(own) - 1, min(len(own), n)).astype(int)]


def sample(docs: DataFrame, docs_per_language: int, windows_per_doc: int, id_col: str, text_col: str, lang_col: str) -> list:
    """(lang, bytes of at most ``windows_per_doc`` windows) of at most ``docs_per_language`` ids of each
    language: those of the least id hash.  Of rows with equal id and lang, the one with the least bytes counts.

    The choice reads distinct ids and languages only: limited windows over the salted
    languages first, so that the last sees a bounded number of rows of each
    language however many there are.  Then the executors cut the windows out of the chosen rows.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                        F.col(text_col).cast("string").alias("text"))
    own = named.select("doc_id", "lang").where(F.col("lang").isNotNull() & ~held_out("doc_id")).distinct()
    chosen = own.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.lit(64)))
    for keys in (["lang", "salt"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        chosen = chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_language)
    pairs = [tuple(r) for r in chosen.select("doc_id", "lang").collect()]
    if not pairs:
        return []

    def run(batches):
        for batch in batches:
            for part in slices(batch, TEXTS_AT_ONCE):
                cuts = [spread_windows(t, windows_per_doc).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cuts, pa.binary())],
                                                 names=["doc_id", "lang", "windows"])

    picked = F.broadcast(docs.sparkSession.createDataFrame(pairs, "doc_id long, lang string"))
    rows = (named.where(F.col("doc_id").isin([i for i, _ in pairs])).join(picked, ["doc_id", "lang"], "left_semi")
            .mapInArrow(run, "doc_id long, lang string, windows binary")
            .groupBy("doc_id", "lang").agg(F.min("windows").alias("windows")).collect())
    return sorted((r["lang"], bytes(r["windows"])) for r in rows)


def fit(docs: DataFrame, docs_per_language: int = 250, windows_per_doc: int = 12, hidden: int = 8, epochs: int = 6,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], dict | None]:
    """(languages, weights).  Nothing to learn from, as no labelled row has a text: no languages, and no weights."""
    rows = sample(docs, docs_per_language, windows_per_doc, id_col, text_col, lang_col)
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return [], None
    data, labels = [], []
    for lang, cuts in rows:
        own = np.frombuffer(cuts, np.uint8).reshape(-1, STEPS)
        data.append(own)
        labels += [languages.index(lang)] * len(own)
    data, labels = np.concatenate(data), np.asarray(labels, np.int64)
    if not len(data):
        return [], None
    counts = np.bincount(labels, minlength=len(languages))
    even = np.concatenate([np.resize(np.flatnonzero(labels == k), counts.max()) for k in range(len(languages)) if counts[k]])
    return languages, train(data[even], labels[even], len(languages), hidden, epochs)


def identify(docs: DataFrame, sharpness: float = 8.0, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", keep: list[str] | None = None, unlearned: str | None = "und", **fitting) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; trains first, at once.
    With ``keep`` the text and the columns named there follow.

    Null text, or text without a letter: ``und`` with score 0.  Nothing learned
    (see ``fit``): texts with a letter get ``unlearned``, with score 0.  One output row
    per input row, repeated rows and null ids included.  Only the named
    columns are read, ``lang`` for training alone.  Empty table: no rows.
    """
    languages, weights = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **fitting)
    names = pa.array([*languages, "und", unlearned], pa.string())

    def run(batches):
        for batch in batches:
            for part in slices(batch, TEXTS_AT_ONCE):
                texts = part.column(2).to_pylist()
                if weights is None:
                    best, score = np.where(with_letter(texts), 1, -1), np.zeros(len(texts))
                else:
                    best, score = predict(weights, texts, sharpness)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), names.take(pa.array(np.where(best < 0, len(languages), best))),
                     pa.array(score, pa.float64()), *(part.columns[2:] if keep is not None else [])], names=out.names)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                      F.col(text_col).cast("string").alias("text"), *(F.col(c) for c in keep or []))
    out = T._parse_datatype_string("doc_id long, held_out boolean, lang_pred string, score double")
    if keep is not None:
        out = T.StructType([*out.fields, *own.schema.fields[2:]])
    return own.mapInArrow(run, out)
