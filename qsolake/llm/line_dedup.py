"""Line dedup by probing a sharded minimal perfect hash.

A line's key is 128 bits of hash of the stripped, lower-cased line. All distinct keys of long lines are dealt into
shards. Each shard gets a minimal perfect hash (levels of collision-free bits,
placed by rank) that indexes three compact arrays: fingerprint, document count and the largest document id. A
document's lines are sent as bare hashes to the shard that holds them, and probe its arrays in a stream: a line
goes if its key's count reaches MIN_DOCS and its document isn't the last; only the places of such lines come back. Hot shards are read by several tasks, as many as their known counts ask for.

Defined cases: a null or empty text is one empty line; a null id counts as the smallest; rows that repeat an id
count as documents of their own, and what is kept for the largest id is kept in each of its rows; a very long text
or line counts whole; an empty table gives no row; columns named like a result column are replaced."""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qsolake.llm.common import BLANKS, NO_ID, lower_ascii, short_batches, tasks, tidied, with_let, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of one shard.
SHARD_KEYS = 100_000
GAMMA = 2.0
U = np.uint64


def mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A level's hash of 128-bit keys."""
    with np.errstate(over="ignore"):
        x = a * U(0x9E3779B97F4A7C15) ^ (b + U(level + 1) * U(0xD1B54A32D192ED03))
        x ^= x >> U(33)
        x *= U(0xFF51AFD7ED558CCD)
        x ^= x >> U(33)
        x *= U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: about 3 bits a key."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.cumsum(bits) - bits)
            total += int(bits.sum())

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels = []
        while len(a):
            size = max(2, int(len(a) * GAMMA))
            at = (mixed(a, b, len(levels)) % U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = ~alone[at]
            a, b = a[rest], b[rest]
        return cls(levels)

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each key; of a key that isn't in the set, any place or -1."""
        out = np.full(len(a), -1, np.int64)
        open_ = np.arange(len(a))
        for level, bits in enumerate(self.levels):
            at = (mixed(a[open_], b[open_], level) % U(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out

    def pack(self) -> bytes:
        head = struct.pack(f"<{len(self.levels) + 1}I", len(self.levels), *map(len, self.levels))
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, data: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<I", data)
        sizes, at, levels = struct.unpack_from(f"<{n}I", data, 4), 4 + 4 * n, []
        for size in sizes:
            width = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(levels)


def line_hashes(text_lines: Column, min_chars: int) -> Column:
    """The long lines of a text: array of (place, a, b)."""

    def key(line, place):
        stripped = F.trim(line, F.lit(BLANKS))
        long_ = F.length(stripped) >= min_chars
        low = F.when(long_, lower_ascii(stripped))
        return with_let(
            low, lambda k: F.when(long_, F.struct(place.alias("place"), F.xxhash64(k).alias("a"), F.xxhash64(k, F.lit(1)).alias("b")))
        )

    return F.filter(F.transform(text_lines, key), lambda x: x.isNotNull())


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def build_index(lines: DataFrame) -> tuple[DataFrame, int]:
    """One row for each shard with its packed hash and arrays, and the number of shards."""
    spark = lines.sparkSession
    distinct = lines.select("id", F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))).alias("k"))
    keys = written(distinct.groupBy("k.a", "k.b").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")), "line-keys")
    shards = max(1, -(-keys.count() // SHARD_KEYS))

    def build(shard: pd.DataFrame) -> pd.DataFrame:
        a, b = (shard[c].to_numpy().view(np.uint64) for c in "ab")
        mph = PerfectHash.build(a, b)
        at = mph.index(a, b)
        arrays = [np.zeros(len(a), t) for t in ("<u8", "<u4", "<i8")]
        for out, values in zip(arrays, (b, shard["n"], shard["last"])):
            out[at] = np.minimum(values, np.iinfo(out.dtype).max)
        row = [int(shard["shard"].iloc[0]), mph.pack(), *[x.tobytes() for x in arrays], int(shard["n"].sum())]
        return pd.DataFrame([row], columns=["shard", "mph", "prints", "counts", "lasts", "load"])

    index = keys.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")).repartition(max(1, min(shards, tasks(spark))), "shard")
    made = index.groupBy("shard").applyInPandas(build, "shard int, mph binary, prints binary, counts binary, lasts binary, load long")
    return written(made, "line-index"), shards


def probe(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and slice, a shard's arrays before its probes; gives the places to drop."""
    now = mph = prints = counts = lasts = None
    for batch in batches:
        shard = batch.column("shard").to_numpy() * 4096 + batch.column("slice").to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            part = batch.slice(start, end - start)
            if shard[start] != now:
                now, mph = shard[start], None
            if part.column("mph")[0].is_valid:
                mph = PerfectHash.unpack(part.column("mph")[0].as_py())
                prints = np.frombuffer(part.column("prints")[0].as_py(), "<u8")
                counts = np.frombuffer(part.column("counts")[0].as_py(), "<u4")
                lasts = np.frombuffer(part.column("lasts")[0].as_py(), "<i8")
                part = part.slice(1)
            if mph is None or not part.num_rows or not len(prints):
                continue
            a, b = (part.column(c).to_numpy().view(np.uint64) for c in "ab")
            at = mph.index(a, b)
            drop = (at >= 0) & (prints[at] == b) & (counts[at] >= min_docs) & (lasts[at] != part.column("id").to_numpy())
            if drop.any():
                yield part.filter(pa.array(drop)).select(["id", "hash", "place"])


def dropped_places(lines: DataFrame, min_docs: int) -> DataFrame:
    """id, hash (of the text), places: the lines that go, for each document that loses any."""
    spark = lines.sparkSession
    index, shards = build_index(lines)
    loads = index.select("shard", "load")
    total = loads.agg(F.sum("load")).first()[0] or 0
    most = max(20_000, total // (4 * tasks(spark)))
    # shards above the even load: 4 x tasks of them at most, as their loads add up to the total
    hot = loads.where(F.col("load") > most).select("shard", F.least(F.ceil(F.col("load") / most), F.lit(4096)).cast("int").alias("slices"))
    wide = index.join(F.broadcast(hot), "shard", "left").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))
    )
    probes = (
        lines.select("id", "hash", F.explode("lines").alias("l")).select("id", "hash", "l.*")
        .withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
        .join(F.broadcast(hot), "shard", "left")
        .withColumn("slice", F.pmod(F.xxhash64("id", "hash"), F.coalesce("slices", F.lit(1))).cast("int"))
    )
    arrays = ["mph", "prints", "counts", "lasts"]
    columns = ["shard", "slice", *arrays, "id", "hash", "place", "a", "b"]
    rows = probes.withColumns({c: F.lit(None).cast("binary") for c in arrays}).select(columns).union(
        wide.withColumns({c: F.lit(0).cast("long") for c in ("id", "hash", "a", "b")}).withColumn("place", F.lit(0)).select(columns)
    )
    found = (
        rows.repartition(tasks(spark), "shard", "slice")
        .sortWithinPartitions("shard", "slice", F.col("mph").isNull())
        .mapInArrow(tidied(functools.partial(probe, min_docs=min_docs)), "id long, hash long, place int")
    )
    return found.groupBy("id", "hash").agg(F.collect_set("place").alias("places"))


def line_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """docs with the text's surviving lines, n_lines (before) and n_dropped."""
    text, rid = F.col(text_col), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    whole = F.xxhash64(F.coalesce(text, F.lit("")))
    slim = short_batches(docs).select(
        rid.alias("id"), whole.alias("hash"), with_let(text_lines(text), lambda x: line_hashes(x, min_chars)).alias("lines")
    ).where(F.size("lines") > 0)
    drops = dropped_places(written(slim, "lines"), min_docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, rid.alias("_id"), whole.alias("_hash"), text.alias("_text"))
    joined = keyed.join(
        drops.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), F.col("places").alias("_places")), ["_id", "_hash"], "left"
    )
    n_lines = (F.length(F.coalesce("_text", F.lit(""))) - F.length(F.translate(F.coalesce("_text", F.lit("")), "\n", "")) + 1).cast("long")
    others = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    place = docs.columns.index(text_col)
    new_text = F.when(F.col("_places").isNull(), F.col("_text")).otherwise(
        with_let(
            text_lines(F.col("_text")),
            lambda x: F.array_join(
                F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_places")), lambda i: x[i]), "\n"
            ),
        )
    ).alias(text_col)
    others.insert(place, new_text)
    return joined.select(*others, n_lines.alias("n_lines"), F.when(F.col("_places").isNull(), 0).otherwise(F.size("_places")).cast("long").alias("n_dropped"))
