"""Runs against a search that tries every period, and comparisons counted on texts that repeat much."""

import hashlib
import random
import zlib
from collections import Counter

import plain
import pytest
from qsolake.llm import periodic, queries


def every_run(w: list, least: int, periods: float) -> list[tuple[int, int, int]]:
    found, n = [], len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i - s + p
            if i > s and length >= max(least, periods * p) and not any(w[s : s + length - q] == w[s + q : s + length] for q in range(1, p)):
                found.append((s, length, p))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def without(w: list, runs: list) -> list:
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


@pytest.mark.parametrize("least, periods", [(2, 2), (6, 4), (3, 2.5)])
def test_short_lists(least, periods):
    rng = random.Random(7)
    for _ in range(1500):
        n, k = rng.randint(0, 36), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 6)
            w = [w[i] if i < a + p else w[a + (i - a) % p] for i in range(n)]
        runs = periodic.text_runs(w, least, periods)
        assert runs == every_run(w, least, periods), w
        assert periodic.collapsed(w, runs) == without(w, runs)


class Word(int):
    """A word that counts how often it is compared."""

    compared = 0

    def __eq__(self, other):
        Word.compared += 1
        return int(self) == int(other)

    def __lt__(self, other):
        Word.compared += 1
        return int(self) < int(other)

    def __gt__(self, other):
        Word.compared += 1
        return int(self) > int(other)

    __hash__ = int.__hash__


def fibonacci(n: int) -> list[int]:
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def repeating(n: int) -> dict[str, list[int]]:
    rng = random.Random(3)
    made = {
        "one word": [1] * n, "Fibonacci": fibonacci(n), "Thue-Morse": [bin(i).count("1") % 2 for i in range(n)], "two words": [rng.randrange(2) for _ in range(n)],
        "a long period": [rng.randrange(3) for _ in range(37)] * (n // 37), "rare change": ([0] * 50 + [1]) * (n // 51), "two halves": [0] * (n // 2) + [1] + [0] * (n // 2),
        "nested": sum([([0] * k + [1]) * 4 + [2] for k in range(int((n / 2) ** 0.5))], []),
    }
    return made | {f"{k}, other order": [-x for x in w] for k, w in made.items()}


def test_comparisons_grow_with_the_words_alone():
    for n in (2_000, 20_000):
        for name, w in repeating(n).items():
            Word.compared = 0
            list(periodic.roots([Word(x) for x in w], 2))
            assert Word.compared < 12 * len(w), (name, n)


def test_long_lists():
    for name, w in repeating(600).items():
        assert periodic.text_runs(w, 2, 2) == every_run(w, 2, 2), name


AWKWARD = ["a b " * 40, "x " + "one two three " * 5 + "four", "na " * 5, "na " * 6, "\x85a b\xa0c " * 9, "q\tq\nq\x0bq\x0cq\rq q", "zwei " * 30_000]


def test_awkward_rows(spark):
    rows = plain.awkward() + [(500 + i, t, "a", None) for i, t in enumerate(AWKWARD)]
    docs = spark.createDataFrame(rows, plain.DOCS).selectExpr("*", "1 as runs", "2 as collapsed", "3 as _text", "'y' as _in_0")
    found = periodic.periodic_runs(docs)
    assert found.columns == [*docs.columns[:4], "_text", "_in_0", "runs", "collapsed"]
    want = Counter()
    for i, t, *_ in rows:
        w = plain.words(t)
        runs = [(0, 30_000, 1)] if i == 506 else periodic.text_runs(w) if len(w) > 1000 else every_run(w, 6, 4)
        want[i, t, tuple(runs), " ".join(without(w, runs))] += 1
    assert Counter((r.doc_id, r.text, tuple(map(tuple, r.runs)), r.collapsed) for r in found.collect()) == want
    assert sum(bool(k[2]) for k in want) == 6
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_periods_are_checked(spark):
    with pytest.raises(ValueError):
        periodic.periodic_runs(spark.createDataFrame([], plain.DOCS), periods=1.5)


def test_the_query(spark):
    """The registered query over its whole table."""
    want = Counter()
    for r in spark.read.parquet(f"{plain.SF}/documents.parquet").collect():
        w = plain.words(r.text)
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = every_run(w, 6, 4) if n < 700 else periodic.text_runs(w)
        s, length, p = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(without(w, runs)))]
        want[r.doc_id, len(runs), s, length, p, runs and 1000 * length // p or None, *digest] += 1
    assert Counter(map(tuple, queries.op13_periodic_runs(spark, plain.SF).collect())) == want
    assert sum(k[1] > 0 for k in want) > 5
