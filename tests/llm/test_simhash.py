from collections import Counter
from itertools import combinations

import numpy as np
import xxhash

import plain
from qsolake.llm import simhash


def fingerprint(text):
    words = plain.words(plain.lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    prints = [fingerprint(r[1]) for r in rows]
    edges = [(a, b) for a, b in combinations(sorted(set(prints)), 2) if (a ^ b).bit_count() <= 4]
    group = plain.joined(set(prints), edges)
    least = {}
    for (doc, *_), p in zip(rows, prints):
        if doc is not None:
            least[group[p]] = min(least.get(group[p], doc), doc)
    return [(r[0], f"{p:016x}", least.get(group[p])) for r, p in zip(rows, prints)]


def test_awkward_rows(spark):
    rows = plain.awkward()
    made = simhash.simhash_components(spark.createDataFrame(rows, plain.DOCS))
    assert Counter(map(tuple, made.collect())) == Counter(expected(rows))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{plain.SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    made = simhash.simhash_components(docs)
    assert sorted(map(tuple, made.collect())) == sorted(expected(rows))


def test_every_close_pair_shares_a_key():
    rng = np.random.default_rng(3)
    for n in (10, 10**6, 10**9, 10**12):
        masks = simhash.cut(n)
        for _ in range(200):
            differing = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(differing & m == 0 for m in masks)


def test_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(4)
    some = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 300)]
    near = []
    for x in some[:100]:
        y = x & (1 << 64) - 1
        for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
            y ^= 1 << int(b)
        near.append(y - (1 << 64) if y >> 63 else y)
    rows = sorted(set(some + near))
    made = simhash.links(spark.createDataFrame([(x,) for x in rows], "fp long")).collect()
    full = [(a, b) for a, b in combinations(rows, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert plain.joined(rows, [(r.a, r.b) for r in made]) == plain.joined(rows, full)


def test_one_document_of_each_group_stays(spark):
    rows = plain.awkward()
    kept = simhash.simhash_dedup(spark.createDataFrame(rows, plain.DOCS))
    assert kept.columns == ["doc_id", "text", "source", "n_lines"]
    # One row of each component, also where one id names two of them.
    prints = {fingerprint(r[1]) for r in rows}
    group = plain.joined(prints, [(a, b) for a, b in combinations(sorted(prints), 2) if (a ^ b).bit_count() <= 4])
    named = {group[int(p, 16)]: c for _, p, c in expected(rows)}
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted(c for c in named.values() if c is not None)


def test_one_text_of_each_group_stays(spark):
    copy = plain.BASE
    rows = [*plain.awkward(), (1000, copy, "a", None), (None, copy, "a", None), (None, copy + " tail", "b", None)]
    kept = simhash.simhash_dedup(spark.createDataFrame(rows, plain.DOCS)).collect()
    assert {tuple(r) for r in kept} <= set(rows)
    prints = [fingerprint(r[1]) for r in rows]
    edges = [(a, b) for a, b in combinations(sorted(set(prints)), 2) if (a ^ b).bit_count() <= 4]
    group = plain.joined(set(prints), edges)
    assert Counter(group[fingerprint(r.text)] for r in kept) == dict.fromkeys(group.values(), 1)
    least = {c: i for _, p, i in expected(rows) for c in [group[int(p, 16)]]}
    assert all(r.doc_id == least[group[fingerprint(r.text)]] for r in kept)


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame(plain.awkward(), plain.DOCS).selectExpr("*", "'x' as _hash", "1 as _id", "2 as _none", "3 as fp", "'y' as _row")
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert {tuple(r)[4:] for r in kept.collect()} == {("x", 1, 2, 3, "y")}


def test_empty_table(spark):
    empty = spark.createDataFrame([], plain.DOCS)
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.simhash_dedup(empty).count() == 0
