"""Embedding near-dedup by E8 lattice hashing.

Unit vectors are projected at random to 8 dimensions, scaled, and decoded to the nearest point of the E8 lattice,
in TABLES tables of one projection each. A vector is entered in its own cell and in the PROBES neighbouring
cells that lie nearest in the direction of its residual. Vectors of one label that share a cell are compared by
cosine in double precision, in blocks of a bounded size. A linked pair is counted in the first cell that it shares
alone, so the counts need no list of pairs; components get a spanning forest of each block.

Equal vectors are one class: they aren't compared with each other, and each counts the others as links.

Defined cases: a null label, a null or zero vector, or one with null or non-finite parts links with nothing;
vectors of different lengths don't link; rows that repeat an id are vectors of their own, counted by class; null
ids never name a component; an empty table gives no row."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qsolake.llm.common import blocks, components, dealt, forest, met, short_batches, written

COSINE = 0.93
TABLES, PROBES, SCALE, SEED = 8, 4, 3.0, 8
#: Comparisons of shared cells at a time.
PAIRS = 20_000


@functools.lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: 112 with two entries of 1, 128 of halves with an even number of minuses."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = [0.0] * 8
                    v[i], v[j] = a, b
                    out.append(v)
    out += [[-0.5 if m >> k & 1 else 0.5 for k in range(8)] for m in range(256) if bin(m).count("1") % 2 == 0]
    return np.array(out)


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer of the nearest points of D8 and of D8 moved by halves."""

    def even(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(1) % 2 != 0)
        gap = y[odd] - r[odd]
        worst = np.abs(gap).argmax(1)
        r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        return r

    a, b = even(x), even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


@functools.lru_cache(maxsize=4)
def projections(dimension: int) -> np.ndarray:
    """TABLES random projections to 8 dimensions, each of orthonormal rows where the dimension allows it."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(TABLES):
        g = rng.standard_normal((max(dimension, 8), 8))
        out.append(np.linalg.qr(g)[0][:dimension] * np.sqrt(max(dimension, 8) / 8))
    return np.stack(out)


def cells(unit: np.ndarray) -> np.ndarray:
    """(vectors, TABLES * (1 + PROBES)) hashes of the cells that each vector is entered in."""
    out = []
    weights = np.random.default_rng(SEED + 1).integers(1, 1 << 62, 8).astype(np.uint64) | np.uint64(1)
    for t, p in enumerate(projections(unit.shape[1])):
        x = unit @ p * SCALE
        point = decode(x)
        near = np.argsort((x - point) @ -roots().T, axis=1, kind="stable")[:, :PROBES]
        entered = np.concatenate([point[:, None], point[:, None] + roots()[near]], axis=1)
        whole = np.rint(entered * 2).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            h = (whole * weights).sum(2) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t)
            out.append((h ^ (h >> np.uint64(29))).view(np.int64))
    return np.concatenate(out, axis=1)


def usable() -> Column:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine & some, F.lit(False))


def classes_of(rows: DataFrame) -> DataFrame:
    """cls, label, embedding (array of double), n, least: one row for each distinct vector of a label."""
    grouped = rows.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    return grouped.withColumn("cls", F.xxhash64("label", "embedding"))


def links(classes: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(cls, n_links) in other classes, and edges (a, b) of classes that span all links."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("embedding")
            sizes = lists.value_lengths().to_numpy()
            flat, ends = lists.flatten().to_numpy().astype(np.float64), np.cumsum(sizes)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                v = np.stack([flat[ends[i] - size : ends[i]] for i in at])
                v /= np.abs(v).max(1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cls").take(pa.array(at)), batch.column("label").take(pa.array(at)), batch.column("n").take(pa.array(at)),
                     pa.array([x.tobytes() for x in v], pa.binary()), pa.array(list(cells(v)), pa.list_(pa.int64()))],
                    ["cls", "label", "n", "unit", "cells"],
                )

    entered = written(
        classes.select("cls", "label", "n", "embedding").mapInArrow(
            enter, f"cls long, label {dict(classes.dtypes)['label']}, n long, unit binary, cells array<long>"
        ),
        "embedding-cells",
    )
    # most cells hold one vector: only those that share one take their vector along
    keys = entered.select("cls", "label", F.octet_length("unit").alias("size"), F.explode(F.array_distinct("cells")).alias("cell"))
    pairs = met(keys, F.xxhash64("label", "size", "cell"), F.col("cls")).drop("label", "size")
    rows = dealt(pairs.join(entered.select("cls", "n", "unit", "cells"), "cls"))
    rows = rows.select("_block", "_left", "_right", "_chunk", "cls", "n", "unit", "cells", "cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_block"):
            cls, first = np.unique(block.column("cls").to_numpy(), return_index=True)
            block = block.take(pa.array(first)).combine_chunks()
            unit = np.stack([np.frombuffer(x.as_buffer()) for x in block.column("unit")])
            near = unit @ unit.T >= cosine
            np.fill_diagonal(near, False)
            left, right = block.column("_left")[0].as_py(), block.column("_right")[0].as_py()
            if left != right:
                chunk = block.column("_chunk").to_numpy()
                near &= chunk[:, None] != chunk[None, :]
            a, b = np.nonzero(np.triu(near))
            if not len(a):
                continue
            cell = block.column("cell")[0].as_py()
            own = np.stack([np.array(x.as_py(), np.int64) for x in block.column("cells")])
            alone = np.zeros(len(a), bool)
            for at in range(0, len(a), PAIRS):
                x, y = own[a[at : at + PAIRS]], own[b[at : at + PAIRS]]
                earlier = np.zeros(len(x), bool)
                for k in range(x.shape[1]):
                    earlier |= (x[:, k] < cell) & (y == x[:, k : k + 1]).any(1)
                alone[at : at + PAIRS] = ~earlier
            n = block.column("n").to_numpy()
            count = np.bincount(a[alone], n[b[alone]], len(cls)) + np.bincount(b[alone], n[a[alone]], len(cls))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[some]), pa.array(count[some].astype(np.int64)), pa.nulls(len(some), pa.int64())], ["a", "n", "b"]
            )
            u, v = forest(near | np.eye(len(near), dtype=bool))
            yield pa.RecordBatch.from_arrays([pa.array(cls[u]), pa.nulls(len(u), pa.int64()), pa.array(cls[v])], ["a", "n", "b"])

    found = written(rows.mapInArrow(compare, "a long, n long, b long"), "embedding-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n_links"))
    return counts, found.where("b is not null").select("a", "b")


def embedding_links(vectors: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept, for each row of vectors (vec_id, embedding, label)."""
    rows = short_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    classes = written(classes_of(rows.where(usable())), "embedding-classes")
    counts, edges = links(classes, cosine)
    parts = components(edges, "embedding-components").withColumnRenamed("node", "cls")
    member = classes.select("cls", "n", "least").join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = member.groupBy("component").agg(F.min("least").alias("named"))
    labels = (
        member.join(named, "component").join(counts, "cls", "left")
        .select("cls", "named", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    keyed = rows.select("vec_id", F.when(usable(), F.xxhash64("label", "embedding")).alias("cls"))
    component = F.coalesce("named", "vec_id")
    return keyed.join(labels, "cls", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
