"""Toxicity scores against the formulas worked out with dictionaries, one text after the other; learnt ids that repeat."""

import bisect
import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import plain
from pyspark.sql import functions as F
from qsolake.llm import toxicity as tox


def bare(text):
    return [b for w in (text or "").lower().split() if (b := w.strip(tox.EDGES))]


def pieces(word):
    word = f"<{word}>"
    return [word[i : i + n] for n in tox.GRAMS for i in range(len(word) - n + 1)]


def chance(t, o, share):
    same = math.lgamma(t + o + 1) - math.lgamma(t + 1) - math.lgamma(o + 1) + t * math.log(share) + o * math.log1p(-share)
    return -math.log1p(t + o) - same


def sure(part, c):
    return 1 / (1 + (1 - part) / part * math.exp(min(-c, 700.0)))


def telling(chances):
    part = 0.05
    for _ in range(100):
        part = min(max(sum(sure(part, c) * n for c, n in chances.items()) / chances.total(), 1e-6), 0.5)
    return part


class Plain:
    def __init__(self, train):
        self.n, self.pair, self.piece = {}, {}, {}
        for text, y in train:
            found = bare(text)
            for table, keys in ((self.n, found), (self.pair, zip(found, found[1:])), (self.piece, (g for w in set(found) for g in pieces(w)))):
                for k in set(keys):
                    table.setdefault(k, [0, 0])[y] += 1
        sums = lambda table: ([sum(v[c] for v in table.values()) for c in (0, 1)], [sum(v[c] > 0 for v in table.values()) for c in (0, 1)])
        (self.total, self.distinct), (self.p_total, self.p_distinct) = sums(self.n), sums(self.piece)
        self.follows, self.of, self.types, self.all_types = Counter(), {}, {}, Counter()
        for (h, w), v in self.pair.items():
            self.follows[w] += 1
            self.all_types[h] += 1
            for c in (0, 1):
                self.of.setdefault(h, [0, 0])[c] += v[c]
                self.types.setdefault(h, [0, 0])[c] += v[c] > 0
        self.shared = sum(max(self.follows[w], 1) for w in self.n)
        self.share, self.p_share = self.total[1] / sum(self.total), self.p_total[1] / sum(self.p_total)
        self.telling = telling(Counter(chance(v[1], v[0], self.share) for v in self.n.values()))
        self.p_telling = telling(Counter(chance(v[1], v[0], self.p_share) for v in self.piece.values()))
        edges = np.arange(-40, 40.05, 0.1).tolist()
        seen = Counter()
        for (_, w), v in self.pair.items():
            c = chance(v[1], v[0], self.pair_share(self.probability(w, self.n[w], 0.0)))
            i = min(bisect.bisect_right(edges, min(max(c, -40), 40)), len(edges) - 1) - 1
            seen[(edges[i] + edges[i + 1]) / 2] += 1
        self.pair_telling = telling(seen)

    def pair_share(self, p):
        odds = self.share / (1 - self.share) * p[1] / p[0]
        return min(max(odds / (1 + odds), 1e-9), 1 - 1e-9)

    def probability(self, w, n, letters):
        s, alone = sure(self.telling, chance(n[1], n[0], self.share)), max(sum(n), 1) / sum(self.total)
        tilt = math.exp(-letters / 2), math.exp(letters / 2)
        own = [(max(n[c] - tox.D, 0) + tox.D * self.distinct[c] * max(self.follows[w], 1) / self.shared * tilt[c]) / self.total[c] for c in (0, 1)]
        return [s * own[c] + (1 - s) * alone * tilt[c] for c in (0, 1)]

    def letters(self, word, own):
        sums = 0.0
        for g in pieces(word):
            n = list(self.piece.get(g, (0, 0)))
            if own is not None and g in self.piece:
                n[own] = max(n[own] - 1, 0)
            if sum(n):
                alone, s = sum(n) / sum(self.p_total), sure(self.p_telling, chance(n[1], n[0], self.p_share))
                p = [s * (max(n[c] - tox.D, 0) + tox.D * self.p_distinct[c] * alone) / self.p_total[c] + (1 - s) * alone for c in (0, 1)]
                sums += math.log(p[1] / p[0])
        return sums / max(len(pieces(word)), 1)

    def evidence(self, text, weight, own=None):
        found, sums, known = bare(text), 0.0, {}
        for i, w in enumerate(found):
            if w not in known:
                n = list(self.n.get(w, (0, 0)))
                if own is not None and w in self.n:
                    n[own] = max(n[own] - 1, 0)
                letters = weight * self.letters(w, own) if weight else 0.0
                known[w] = n, letters, self.probability(w, n, letters)
            n, letters, q = known[w]
            r = math.log(q[1] / q[0]) if sum(n) else letters
            h = found[i - 1] if i else None
            if i and (h, w) in self.pair:
                m, of, types, all_types = list(self.pair[h, w]), list(self.of[h]), list(self.types[h]), self.all_types[h]
                if own is not None:
                    m[own] -= 1
                    of[own] -= 1
                    types[own] -= m[own] == 0
                    all_types -= sum(m) == 0
                if sum(m) > 0:
                    alone = max(sum(n), 1) / sum(self.total)
                    pool = (max(sum(m) - tox.D, 0) + tox.D * all_types * alone) / sum(of)
                    back = [pool * q[c] / alone for c in (0, 1)]
                    made = [(max(m[c] - tox.D, 0) + tox.D * types[c] * back[c]) / of[c] if of[c] > 0 else back[c] for c in (0, 1)]
                    s = sure(self.pair_telling, chance(m[1], m[0], self.pair_share(q)))
                    made = [s * made[c] + (1 - s) * back[c] for c in (0, 1)]
                    r = math.log(made[1] / made[0])
            sums += r
        return sums / (len(found) + tox.PRIOR_WORDS)


def best(rows):
    """Best F1 and its threshold, by trying each."""
    top = (-1.0, 0.0)
    values = sorted({x for x, _ in rows}, reverse=True)
    for i, v in enumerate(values):
        hit, taken = sum(y for x, y in rows if x >= v), sum(x >= v for x, _ in rows)
        f1 = 2 * hit / (taken + max(sum(y for _, y in rows), 1))
        if f1 > top[0]:
            top = f1, max((v + max(values[i + 1] if i + 1 < len(values) else 0.0, 0.0)) / 2, 1e-6)
    return top


def test_scores_against_plain(spark):
    docs, labels = (spark.read.parquet(f"{plain.SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: int(r.toxic) for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    train = [(texts[i], y) for i, y in marks.items() if i in texts]
    model = Plain(train)
    cuts = [(*best([(model.evidence(t, w, y), y) for t, y in train]), w) for w in tox.LETTER_WEIGHTS]
    _, cut, weight = max(cuts, key=lambda c: (round(c[0], 9), c[2]))
    assert weight > 0
    made = {r.doc_id: r for r in tox.toxicity(docs, labels).collect()}
    assert made.keys() == texts.keys()
    for i, text in texts.items():
        x = model.evidence(text, weight)
        score = 1 / (1 + math.exp(-((x / cut - 1) * 5 + math.log(tox.CUT / (1 - tox.CUT)))))
        score = max(score, tox.CUT) if x >= cut else min(score, tox.CUT - 1e-9)
        assert math.isclose(made[i].score, score, abs_tol=1e-9) and made[i].predicted == (x >= cut), i


def test_learnt_ids_that_repeat_count_once(spark):
    docs, labels = (spark.read.parquet(f"{plain.SF}/{t}.parquet") for t in ("documents", "labels"))
    learnt = next(r.doc_id for r in labels.where("toxic = 1").orderBy("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    again = docs.where(F.col("doc_id") == learnt).crossJoin(spark.range(20_000)).select(docs.columns)
    once, often = (tox.toxicity(d, labels).select("doc_id", "score").distinct() for d in (docs, docs.union(again)))
    assert {r.doc_id: r.score for r in once.collect()} == {r.doc_id: r.score for r in often.collect()}


def test_very_long_texts_are_scored_but_not_learnt(spark):
    rows = [(i, f"good words {i} " * 30, 0) for i in range(40)] + [(100 + i, f"vile words {i} " * 30, 1) for i in range(40)] + [(200, "vile " * 150_000, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    made = {r.doc_id: r.predicted for r in tox.toxicity(frame.drop("toxic"), frame.drop("text")).collect()}
    assert made[200] == 1 and sum(made[i] for i in range(40)) == 0 and sum(made[100 + i] for i in range(40)) == 40


def test_pieces_are_told_apart():
    keys, owner = tox.grams(["pathetic", "ä", "clown"])
    assert Counter(owner.tolist()) == Counter({i: len(pieces(w)) for i, w in enumerate(("pathetic", "ä", "clown"))})
    assert len(set(keys.tolist())) == len({g for w in ("pathetic", "ä", "clown") for g in pieces(w)})


def test_what_a_word_or_pair_says_is_worked_out_once(spark, monkeypatch):
    rows = [(f"good words {i} are here", False) for i in range(30)] + [(f"vile words {i} are there", True) for i in range(30)]
    model, seen, chance = tox.fit(spark.createDataFrame(rows, "text string, toxic boolean")), [], tox.chance
    monkeypatch.setattr(tox, "chance", lambda t, o, share: (seen.append(len(t)), chance(t, o, share))[1])
    worked = []
    for copies in (tox.AT_ONCE // 2, 20 * tox.AT_ONCE):
        model.made = {}
        seen.clear()
        texts = pd.Series(["Vile, words are (here)", "vile words are here!"] * copies + [None, ""])
        (made,) = tox.evidence_udf(SimpleNamespace(value=model), 1.0).func(iter([texts]))
        assert len(made) == len(texts) and made[0] == made[1] == made[2 * copies - 1] > 0 == made[2 * copies]
        worked.append(sum(seen))
    assert worked[0] == worked[1]


def test_keys_are_found_by_their_first_bits():
    rng = np.random.default_rng(3)
    for kind in (np.int64, np.uint64):
        for keys in (rng.integers(np.iinfo(kind).min, np.iinfo(kind).max, 5000, kind), np.arange(300, dtype=kind), np.array([np.iinfo(kind).min, np.iinfo(kind).max], kind), np.zeros(0, kind)):
            keys = np.unique(keys)
            wanted = np.concatenate([keys, keys + kind(1), keys - kind(1), np.array([0, 7, np.iinfo(kind).max], kind)])
            place, there = tox.Keys(keys).at(wanted)
            assert (there == np.isin(wanted, keys)).all() and (keys[place[there]] == wanted[there]).all()
