"""Packing along a space-filling curve.

Each document's ids are summed into a few random directions (a hashed document vector), the vector's cell gets
its Hilbert key, documents are dealt by ranges of that key, sorted within them, and laid end to end into
sequences. Documents are cut wherever a sequence is full, so only the last sequence of a range is padded, to the
next power of two. The ranges' bounds come from a sample of SAMPLE documents; they only set how even the ranges
are. A tie-break by id and text lets a large group of copies, which all have one key, spread over many ranges.

Defined cases: a null or empty text is its end id alone; rows that repeat an id or have none are packed as
documents of their own; rows that agree in both stand together in no certain order; a very long text fills as many
sequences as it needs; an empty table gives no piece; other columns are ignored."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qsolake.llm.common import short_batches, tasks, tidied
from qsolake.llm.tokens import default_tokenizer, encoder

SEQUENCE = 2048
DIMENSIONS, BITS, SEED = 4, 8, 20_240_117
SAMPLE = 2_000
#: Ids of one range: small enough to sort in memory, large enough that its padded end doesn't count.
RANGE_IDS = 1_000_000
#: Documents that are encoded at once.
AT_ONCE = 2_000
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"


#: A lane of a packed sum holds this many ids.
LANE = (1 << 16) - 1


@functools.lru_cache(maxsize=2)
def directions(ids: int) -> np.ndarray:
    """For each id which of the random directions it points along, a 16-bit lane each of one unsigned integer."""
    along = np.random.default_rng(SEED).integers(0, 2, (ids, DIMENSIONS)).astype(np.uint64)
    return (along << (np.arange(DIMENSIONS, dtype=np.uint64) * np.uint64(16))).sum(1, dtype=np.uint64)


def document_vector(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean over the ids of +1 or -1 in each direction."""
    lanes = np.zeros(DIMENSIONS)
    for at in range(0, len(ids), LANE):
        packed = table[ids[at : at + LANE]].sum(dtype=np.uint64)
        lanes += np.frombuffer(packed.tobytes(), "<u2")
    return 2 * lanes / max(len(ids), 1) - 1 if len(ids) else lanes


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n, dimensions): Gray-code the axes from the top bit down, then interleave."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(set_, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_key(ids: list[bytes], dtype: np.dtype, vocabulary: int, ties: list[int]) -> np.ndarray:
    """Hilbert key of each document's vector, then 31 bits of its tie-break."""
    table = directions(vocabulary)
    vectors = np.zeros((len(ids), DIMENSIONS))
    for i, x in enumerate(ids):
        vectors[i] = document_vector(np.frombuffer(x, dtype), table)
    cells = np.clip((np.tanh(vectors * 8) + 1) * (1 << BITS - 1), 0, (1 << BITS) - 1)
    return hilbert_key(cells.astype(np.int64)) << 31 | np.array(ties, np.int64)


def encoded(rows: DataFrame, tokenizer: str, bounds: list[int]) -> DataFrame:
    """rows (doc_id, text, tie) to doc_id, range, key, ids."""

    @tidied
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, cuts = encoder(tokenizer), np.array(bounds, np.int64)
        vocabulary = code.tokenizer.get_vocab_size()
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                ids = code.many(batch.column(1).to_pylist())
                keys = document_key(ids, code.dtype, vocabulary, batch.column(2).to_pylist())
                ranges = np.searchsorted(cuts, keys, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ranges), pa.array(keys), pa.array(ids, pa.binary())], ["doc_id", "range", "key", "ids"]
                )

    return rows.mapInArrow(encode, "doc_id long, range int, key long, ids binary")


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    length: int = SEQUENCE,
) -> DataFrame:
    """The pieces of all sequences, with their ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    tie = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 31)).alias("tie")
    rows = short_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), tie)
    size = rows.count()
    share = min(1.0, SAMPLE / max(size, 1))
    width = 2 if encoder(tokenizer).dtype.itemsize == 2 else 4
    seen = (
        encoded(rows if share == 1 else rows.sample(share, SEED), tokenizer, [])
        .select("key", (F.octet_length("ids") / width + 1).alias("n"))
        .collect()
    )
    seen.sort()
    total = np.cumsum([r.n for r in seen])
    ranges = math.ceil(total[-1] / share / RANGE_IDS) if len(seen) else 1
    at = np.searchsorted(total, [total[-1] * k / ranges for k in range(1, ranges)]) if len(seen) else []
    bounds = sorted({seen[i].key for i in at})

    @tidied
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(tokenizer).dtype
        end = np.array([end_id], "<u4")
        done: list[tuple] = []
        open_: list[tuple] = []
        now, sequence, used = None, 0, 0

        def close() -> None:
            full = 1 << max(used - 1, 0).bit_length() if used < length else length
            done.extend((*piece[:6], min(full, length), piece[6]) for piece in open_)
            open_.clear()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(zip(*done))], names
            )
            done.clear()
            return out

        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in batches:
            for doc, part, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if part != now:
                    if open_:
                        close()
                    now, sequence, used = part, 0, 0
                flat = np.concatenate([np.frombuffer(ids.as_buffer(), dtype).astype("<u4"), end])
                start = 0
                while start < len(flat):
                    n = min(length - used, len(flat) - start)
                    open_.append((doc, start, n, len(flat), (part << 32) + sequence, used, flat[start : start + n].tobytes()))
                    start, used = start + n, used + n
                    if used == length:
                        close()
                        sequence, used = sequence + 1, 0
                if len(done) >= 1000:
                    yield flushed()
        if open_:
            close()
        if done:
            yield flushed()

    return (
        encoded(rows, tokenizer, bounds)
        .repartition(tasks(spark), "range")
        .sortWithinPartitions("range", "key", "doc_id")
        .mapInArrow(lay, PIECES)
    )
