"""Token-ID output: length-delimited binary records with an offset index.

A record file is a sequence of frames

    length  uint64 LE | masked CRC-32C of those 8 bytes  uint32 LE
    payload           | masked CRC-32C of the payload    uint32 LE

(the framing of TFRecord files; mask: rotate right by 15, add a constant).
The payload is one serialized sequence: a flag byte (1: the id is given,
2: token ids take four bytes, else two), the document id as int64 and the
token ids, little-endian.  Beside ``part-N.rec`` stands ``part-N.idx``: the
byte offset of every frame and the end of the last, as uint64, so a reader
can fetch any record, or all of them in shuffled order, without a scan.

Spark range-partitions the documents by id, so files in name order and
records in file order ascend by document id.  A task writes one file; both
files get their names when complete, the index last.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm.shared import by_id, byte_slices, complete_file, cut, filesystem, scratch
from canopy.llm.wordcache import encoder

CRC_MASK_DELTA = 0xA282EAD8  # fixed value of the record format
CRC32C_POLY = 0x82F63B78     # fixed value: Castagnoli polynomial, reflected
BLOCK = 256                  # bytes per lane of the vectorised checksum
READ_BYTES = 8 << 20         # bytes fetched at once by a sequential reader
TEXT_BYTES = 8 << 20         # of text encoded at once


# -- checksums -----------------------------------------------------------------

@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(CRC of each byte, the effect of BLOCK zero bytes on each byte of a state)."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(CRC32C_POLY), crc >> 1)
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(BLOCK):
        state = crc[state & 0xFF] ^ (state >> 8)
    return crc, state.reshape(4, 256)


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string, all strings at once.

    Zero bytes in front leave a zero state as it is, so each string is padded
    in front to whole blocks (its first four bytes inverted: the usual start
    value), blocks of all strings advance together, and a table of the effect
    of one block's length joins the blocks of a string.
    """
    crc, shift = _tables()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    out = np.zeros(len(parts), np.uint32)
    for i in np.flatnonzero(sizes < 4):
        state = 0xFFFFFFFF
        for byte in parts[i]:
            state = int(crc[(state ^ byte) & 0xFF]) ^ (state >> 8)
        out[i] = state ^ 0xFFFFFFFF
    long = np.flatnonzero(sizes >= 4)
    if not len(long):
        return out
    blocks = -(-sizes[long] // BLOCK)
    last = np.cumsum(blocks)
    data = np.zeros(int(last[-1]) * BLOCK, np.uint8)
    for i, n, end in zip(long, sizes[long], last * BLOCK):
        data[end - n:end] = np.frombuffer(parts[i], np.uint8)
        data[end - n:end - n + 4] ^= 0xFF
    state = np.zeros(int(last[-1]), np.uint32)
    for column in np.ascontiguousarray(data.reshape(-1, BLOCK).T):
        state = crc[(state ^ column) & 0xFF] ^ (state >> np.uint32(8))
    first, joined = last - blocks, np.zeros(len(long), np.uint32)
    for k in range(int(blocks.max())):
        on = blocks > k
        s = joined[on]
        s = shift[0][s & 0xFF] ^ shift[1][(s >> 8) & 0xFF] ^ shift[2][(s >> 16) & 0xFF] ^ shift[3][s >> 24]
        joined[on] = s ^ state[first[on] + k]
    out[long] = joined ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    wide = crc.astype(np.uint64)
    return ((((wide >> np.uint64(15)) | (wide << np.uint64(17))) + np.uint64(CRC_MASK_DELTA))
            & np.uint64(0xFFFFFFFF)).astype("<u4")


# -- frames --------------------------------------------------------------------

def serialize(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    return struct.pack("<Bq", (doc_id is not None) + 2 * wide, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return doc_id if flags & 1 else None, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    return [b"".join((h, a, p, b)) for h, a, p, b in zip(
        heads, (x.tobytes() for x in masked(crc32c(heads))), payloads, (x.tobytes() for x in masked(crc32c(payloads))))]


def payloads_of(data: bytes, offsets: np.ndarray) -> list[bytes]:
    """Payloads of the frames at ``offsets`` (from the start of ``data``, the end
    included); raises ValueError where a length or checksum is wrong."""
    cuts = offsets.tolist()
    heads = [data[a:a + 8] for a in cuts[:-1]]
    out = [data[a + 12:b - 4] for a, b in zip(cuts, cuts[1:])]
    sums = np.frombuffer(b"".join(data[a + 8:a + 12] + data[b - 4:b] for a, b in zip(cuts, cuts[1:])), "<u4").reshape(-1, 2)
    if heads != [struct.pack("<Q", len(p)) for p in out] or (masked(crc32c(heads)) != sums[:, 0]).any() \
            or (masked(crc32c(out)) != sums[:, 1]).any():
        raise ValueError("a record's length or checksum is wrong")
    return out


def read_records(folder: str, name: str, which: list[int] | None = None):
    """Yield (record number, doc_id, ids) of one file: all records in order, or
    those numbered in ``which`` in that order, each found by the offset index."""
    files, root = filesystem(folder)
    with files.open_input_file(f"{root}/{name}.idx") as f:
        offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
    with files.open_input_file(f"{root}/{name}.rec") as f:
        if which is not None:
            for i in which:
                data = f.read_at(int(offsets[i + 1] - offsets[i]), int(offsets[i]))
                yield i, *parse(payloads_of(data, offsets[i:i + 2] - offsets[i])[0])
            return
        i = 0
        while i < len(offsets) - 1:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + READ_BYTES, side="right")) - 1)
            data = f.read_at(int(offsets[j] - offsets[i]), int(offsets[i]))
            for n, payload in enumerate(payloads_of(data, offsets[i:j + 1] - offsets[i]), i):
                yield n, *parse(payload)
            i = j


# -- Spark jobs ----------------------------------------------------------------

def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write record files below ``folder``.

    Runs at once; returns one row per file: ``file_no, name, n_records, n_ids``.
    Null text: no ids but the end id.  Null document ids come first; rows with
    equal ids stand beside each other, ordered by the first 64 characters, then
    a hash of the text; any number of them is dealt over files.  Empty input:
    no file.  Other columns of ``docs`` are not read.
    """
    ordered = by_id(docs, id_col, text_col).select("doc_id", "text")

    def write(batches):
        files, root = filesystem(folder)
        no = TaskContext.get().partitionId()
        name, offsets, n_ids = f"part-{no:06d}", [0], 0
        words = encoder(tokenizer)
        batches = (b for batch in batches for b in byte_slices(batch, 1, TEXT_BYTES))
        first = next(batches, None)
        if first is None:
            return
        tail = np.array([] if end_id is None else [end_id], "<u4")
        with complete_file(files, f"{root}/{name}.rec") as out:
            while first is not None:
                ids = [np.concatenate([x, tail]) for x in words.encode(first.column(1))]
                made = frames([serialize(d, x) for d, x in zip(first.column(0).to_pylist(), ids)])
                out.write(b"".join(made))
                offsets += (offsets[-1] + np.cumsum([len(f) for f in made])).tolist()
                n_ids += sum(map(len, ids))
                first = next(batches, None)
        with complete_file(files, f"{root}/{name}.idx") as out:
            out.write(np.asarray(offsets, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"file_no": pa.array([no], pa.int32()), "name": [name],
                                          "n_records": [len(offsets) - 1], "n_ids": [n_ids]})

    return cut(ordered.mapInArrow(write, "file_no int, name string, n_records long, n_ids long"), "record-files")


def read_back(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per record, read from the files: ``doc_id, start, n_tokens,
    ids_crc32``; ``start`` counts the ids of all earlier records.

    Only the manifest (one row per file) is summed up in file order.
    """
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    dealt = starts.repartition(max(1, manifest.count()))  # a file a task

    def read(batches):
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for _, doc_id, ids in read_records(folder, name):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)],
                                          names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, tokenizer: str, end_id: int | None = 2, folder: str | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the record files (in a new shared folder unless one is named) and read them back."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "records")
    return read_back(spark, folder, write_records(docs, folder, tokenizer, end_id, id_col, text_col))
