import numpy as np

import plain
from qsolake.llm import embedding_dedup as e

VECTORS = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows):
    fine = {
        i: np.array(v, np.float64)
        for i, (_, v, label, *_) in enumerate(rows)
        if label is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)
    }
    pairs = set()
    for i, u in fine.items():
        for j, v in fine.items():
            if i < j and rows[i][2] == rows[j][2] and len(u) == len(v):
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= e.COSINE:
                    pairs.add((i, j))
    return pairs


def test_recall_and_precision(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    rng = np.random.default_rng(6)  # the table has no close pair of its own: plant one for each vector
    for vec_id, v, label in rows[:]:
        noise = rng.standard_normal(len(v)) * 0.3 * np.linalg.norm(v) / np.sqrt(len(v))
        rows.append((vec_id + 1_000_000, (np.array(v) + noise).tolist(), label))
    vectors = spark.createDataFrame([(*r, "") for r in rows], VECTORS)
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    pairs = brute(rows)
    links = {r[0]: 0 for r in rows}
    for i, j in pairs:
        links[rows[i][0]] += 1
        links[rows[j][0]] += 1
    found = {r.vec_id: r for r in e.embedding_links(vectors).collect()}
    assert found.keys() == links.keys()
    assert all(found[k].n_links <= n for k, n in links.items())
    assert sum(r.n_links for r in found.values()) >= 0.9 * sum(links.values()) > 0
    group = plain.joined(links, [(rows[i][0], rows[j][0]) for i, j in pairs])
    same = sum(found[k].component_id == c for k, c in group.items())
    assert same >= 0.9 * len(group)
    assert all(r.kept == (r.component_id == r.vec_id) for r in found.values())


def test_awkward_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16).tolist()
    near = (np.array(base) + 0.001).tolist()
    rows = [(1, base, 0, ""), (2, base, 0, ""), (3, near, 0, ""), (4, base, 1, ""), (5, base, None, ""), (6, None, 0, "")]
    rows += [(7, [0.0] * 16, 0, ""), (8, [float("nan"), *base[1:]], 0, ""), (9, [None, *base[1:]], 0, ""), (10, base[:8], 0, "")]
    rows += [(11, [], 0, ""), (12, [float("inf"), *base[1:]], 0, ""), (None, base, 2, ""), (13, base, 2, "")]
    found = sorted((r for r in e.embedding_links(spark.createDataFrame(rows, VECTORS)).collect()), key=lambda r: r.vec_id or 0)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {
        None: (1, 13), 1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7),
        8: (0, 8), 9: (0, 9), 10: (0, 10), 11: (0, 11), 12: (0, 12), 13: (1, 13),
    }


def test_large_cells_are_counted_whole(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.01 * rng.standard_normal(16)).tolist(), 0, "") for i in range(2500)]  # more than two blocks
    found = e.embedding_links(spark.createDataFrame(rows, VECTORS)).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(2499, 0)}


def test_empty_table(spark):
    assert e.embedding_links(spark.createDataFrame([], VECTORS)).count() == 0


def test_decode_gives_the_nearest_lattice_point():
    x = np.random.default_rng(3).standard_normal((200, 8)) * 2
    point = e.decode(x)
    assert len(e.roots()) == 240 and np.allclose((e.roots() ** 2).sum(1), 2)
    best = ((x - point) ** 2).sum(1)
    for r in e.roots():
        assert (best <= ((x - point - r) ** 2).sum(1) + 1e-9).all()
