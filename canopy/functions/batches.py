"""Slices of Arrow batches, so that the memory of a task does not follow the length of its texts, their words, and products of vectors."""

from __future__ import annotations

import numpy as np

TEXT_BYTES = 2 << 20   # of texts that a task cuts into words at once

# Bytes of the characters that operators.vectors.TOKEN_SPLIT leaves in words: one byte, or two that begin with LEAD.
LEAD = 0xC3
_ONE, _SECOND = np.zeros(256, bool), np.zeros(256, bool)
_ONE[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_SECOND[[c.encode()[1] for c in "àâçèéêëîïôùûüäößñáíóú"]] = True


def byte_slices(batch, column: int, size: int = TEXT_BYTES):
    """Row slices of an Arrow batch whose texts in ``column`` have ``size`` bytes at most, or one row."""
    import pyarrow.compute as pc
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy())
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def cut_words(texts):
    """(words of all texts in order, row of each word) of a string array in lower case.

    The words are those between the matches of ``TOKEN_SPLIT`` that are not empty, found by the
    bytes of UTF-8; a null has none.
    """
    import pyarrow as pa
    texts = texts.fill_null("") if texts.null_count else texts
    _, ends, held = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8)[ends[0]:ends[-1]] if held is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = _ONE[data]
    two = np.flatnonzero(data[:-1] == LEAD)
    two = two[_SECOND[data[two + 1]]]
    inside[two] = inside[two + 1] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = ends[:-1][ends[:-1] < len(data)]
    first[rows] = inside[rows]      # a text begins with a new word
    starts = np.append(np.flatnonzero(first[inside]), inside.sum()).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data[inside]))
    return words, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(np.flatnonzero(first), ends)))


def list_rows(column):
    """(start of each row's values, their number, values in double) of an Arrow list column."""
    ends = np.asarray(column.offsets, np.int64)
    return ends[:-1], np.diff(ends), np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)


def products(centres, x):
    """(centres x rows) dot products, summed component by component as :func:`canopy.functions.vector.dot` does."""
    out = np.zeros((len(centres), len(x)))
    for c, column in zip(np.asarray(centres, np.float64).T, np.ascontiguousarray(x.T)):
        out += c[:, None] * column
    return out


def squares(x):
    """Squared norm of each row, summed as :func:`canopy.functions.vector.norm_sq` does."""
    out = np.zeros(len(x))
    for column in np.ascontiguousarray(x.T):
        out += column * column
    return out
