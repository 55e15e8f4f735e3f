from collections import Counter, defaultdict

import numpy as np

import plain
from qsolake.llm import line_dedup
from qsolake.llm.line_dedup import PerfectHash


def expected(rows):
    docs, last = defaultdict(set), {}
    for at, (doc, text, *_) in enumerate(rows):
        for line in (text or "").split("\n"):
            key = plain.lower(line.strip(plain.BLANKS))
            if len(key) >= 40:
                docs[key].add(at)
                last[key] = max(last.get(key, line_dedup.NO_ID), line_dedup.NO_ID if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        own = line_dedup.NO_ID if doc is None else doc
        keys = [plain.lower(x.strip(plain.BLANKS)) for x in lines]
        kept = [x for x, k in zip(lines, keys) if not (len(docs.get(k, ())) >= 5 and last[k] != own)]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def test_against_plain(spark):
    rows = plain.awkward()
    made = line_dedup.line_dedup(spark.createDataFrame(rows, plain.DOCS))
    assert set(made.columns) == {"doc_id", "text", "source", "n_lines", "n_dropped"}
    found = Counter((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in made.collect())
    assert found == expected(rows)
    assert any(n for *_, n in found)


def test_empty_table(spark):
    made = line_dedup.line_dedup(spark.createDataFrame([], plain.DOCS))
    assert made.count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    a, b, c, d = rng.integers(0, 1 << 63, (4, 5000)).astype(np.uint64)
    mph = PerfectHash.unpack(PerfectHash.build(a, b).pack())
    assert sorted(mph.index(a, b)) == list(range(5000))
    other = mph.index(c, d)
    assert ((other >= -1) & (other < 5000)).all()
