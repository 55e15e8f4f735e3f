"""SimHash near-dedup by pigeonhole blocks.

A fingerprint's 64 bits are cut into blocks; two fingerprints that differ in at most DISTANCE bits agree on all
but DISTANCE of them, so they meet in a table that is keyed by some choice of equal blocks. How many blocks are
cut follows from the number of distinct fingerprints, so that a key holds few of them. Equal fingerprints are one
class from the start; the distinct ones that share a key are compared in bounded blocks, each of which gives only
a spanning forest of its links, so a dense group costs edges in proportion to its size.

Defined cases: words are lower-cased A-Z only; a text of fewer words than a shingle is one shingle, a null or
empty text has fingerprint zero, linked like any other; rows with a null id are linked too, but never name a
component (null if no row in it has an id); rows that repeat an id share a component if their fingerprints link;
a very long text counts whole; an empty table gives no row."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qsolake.llm.common import NO_ID, blocks, components, dealt, forest, met, short_batches, tidied, written

SHINGLE, DISTANCE, HASH_SEED = 4, 4, 42
#: Distinct fingerprints that a key should hold on average, if bits were even.
PER_KEY = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    hashes = np.fromiter(
        [digest(joined[a:b], HASH_SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())], "<u8", n
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, others: list[str] = ()) -> DataFrame:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
            rest = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64)), *rest], ["doc_id", "fp", *others])

    given = short_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), *others)
    return given.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *others)))


def cut(n: int, distance: int = DISTANCE) -> list[int]:
    """Masks of the keys: bits cut into the fewest blocks whose equal ones tell enough fingerprints apart."""
    for parts in range(distance + 1, 17):
        edges = [64 * i // parts for i in range(parts + 1)]
        masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
        equal = parts - distance
        if n / 2 ** (64 * equal // parts) <= PER_KEY or parts == 16:
            return [sum(c) for c in combinations(masks, equal)]
    raise AssertionError


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp long) that span all links."""
    masks = [m - (1 << 64) if m >> 63 else m for m in cut(distinct.count(), distance)]
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]))
    rows = dealt(met(distinct.select("fp", keys.alias("k")), F.col("k"), F.col("fp")).select("_block", "fp"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_block"):
            fp = np.unique(block.column("fp").to_numpy().view(np.uint64))
            near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
            some = np.flatnonzero(near.sum(1) > 1)
            if len(some):
                a, b = forest(near[np.ix_(some, some)])
                ids = fp[some].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, for each row of docs."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    edges = links(classes.select("fp"), distance)
    parts = components(edges, "fingerprint-links").withColumnRenamed("node", "fp")
    member = classes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = member.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = written(member.join(named, "component").select("fp", "component_id"), "fingerprint-labels")
    return rows.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component: the one with its smallest id (a row with an id before one without), of
    these with the smallest text hash. Of rows that agree in both, copies of each other, any one stays."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rid = F.col(id_col).cast("long")
    keys = [rid.isNull().alias("_none"), F.coalesce(rid, F.lit(NO_ID)).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash")]
    rows = written(fingerprints(docs.select(*keys, F.col(text_col).alias("text")).withColumn("none", F.col("_none").cast("long")), "_id", "text", ["none", "_hash"]), "fingerprint-rows")
    best = F.min(F.struct(F.col("none"), F.col("doc_id").alias("id"), F.col("_hash").alias("hash"))).alias("best")
    classes = written(rows.groupBy("fp").agg(best), "fingerprint-best")
    parts = components(links(classes.select("fp"), distance), "fingerprint-links").withColumnRenamed("node", "fp")
    member = classes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    chosen = member.groupBy("component").agg(F.min("best").alias("best")).select(
        (F.col("best.none") == 1).alias("_none"), F.col("best.id").alias("_id"), F.col("best.hash").alias("_hash")
    )
    # An id and a text have one fingerprint, so they name one component; equal rows are combined before the shuffle.
    names = ["_none", "_id", "_hash"]
    return docs.select(*keys, row).groupBy(*names).agg(F.first("_row").alias("_row")).join(chosen, names).select("_row.*")
