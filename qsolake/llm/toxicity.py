"""Toxicity by class-conditional Kneser-Ney models of words, alone and after their predecessor, and of their letters.

Counts are of documents that hold a word or a pair of words. Each class has its own counts, discounted by D; the
discounted mass goes to a distribution that both classes share: of a word, the number of distinct words it follows;
of a pair, the pair's Kneser-Ney probability in both classes together, times the word's own ratio. Class model and
shared distribution are interpolated by the posterior probability that the counts tell the classes apart (any share
of the class is as likely, against the share of a word as such), so every word and pair counts by its evidence and
none is cut off. A pair that wasn't learnt from counts as its word, and a word that wasn't, or of which the counts say
little, as its letters: the lowest order is the pieces of three to five letters (edges of the word marked), counted and
discounted in the same way, whose mean log ratio tilts what the word's shared distribution gives to each class. A text's
score is the difference of its two log-likelihoods over its words and PRIOR_WORDS more, put on a logistic curve whose 0.7
lies at the threshold that is best on the rows learnt from, each scored without its own counts. How much the letters
weigh (LETTER_WEIGHTS) is chosen on the same rows in the same way, of equally good weights the largest.

The models are fitted on at most PER_CLASS labelled documents of each class, those with the smallest hash of their id, as
far as they hold WORDS_PER_CLASS words, and none of over LONGEST words; of rows that repeat an id one is learnt from, the
one whose text has the smallest hash. Rows of the held-out fold are never among them, unless all are to be learnt from.

Defined cases: a null or empty text has no expression and scores as an ordinary one; without labelled rows of both
classes every score is 0; a null id is never held out; labels that contradict each other count as toxic; repeated
rows are learnt from once and scored alike; a very long text is scored whole; an empty table gives no row; the columns of docs stay, ones named like a result are
replaced."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qsolake.llm.common import n_words, short_batches, tidy, written

PER_CLASS = 6_000
WORDS_PER_CLASS = 4_000_000
LONGEST = 100_000
D = 0.75
#: Words that a text is taken to be longer, so that one word doesn't decide a very short one.
PRIOR_WORDS = 50
CUT = 0.7
#: Lengths of the pieces of letters.
GRAMS = (3, 4, 5)
LETTER_WEIGHTS = (0.0, 1.0)
#: Parts in which the driver fetches the pairs; a power of two.
PARTS = 16
EDGES = ".,;:!?\"'()[]{}<>*_-#$%&|"
FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 2 * PER_CLASS + 2)))])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def grams(bare: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pieces of GRAMS letters of words, edges marked, and the place of the word that each is from."""
    letters = np.frombuffer("".join(f"<{w}>" for w in bare).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, bare), np.int64, len(bare)) + 2
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner, at = np.repeat(np.arange(len(bare)), lengths), np.arange(len(letters))
    keys, owners, mix = [], [], np.uint64(0x9E3779B97F4A7C15)
    for n in GRAMS:
        key = np.full(max(len(letters) - n + 1, 0), n, np.uint64)
        for i in range(n):
            key = (key ^ letters[i : i + len(key)]) * mix
            key ^= key >> np.uint64(29)
        whole = at[: len(key)] + n <= ends[: len(key)]
        keys.append(key[whole])
        owners.append(owner[: len(key)][whole])
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


class Numbers(dict):
    """Numbers words as they come, and lists those that are new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Words:
    """What is known of words, once for all with the same letters: in hash that of the letters without EDGES (0 if nothing
    is left), at the place of the letters."""

    SIZE = 300_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number, self.place, self.bare = Numbers(), np.zeros(0, np.int64), Numbers()
        self.hash = np.zeros(0, np.uint64)

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the words of all texts one after the other, and how many there are in each."""
        if len(self.number) > self.SIZE:
            self.clear()
        found = [(text or "").lower().split() for text in texts]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        i = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(found)), np.int64, int(lengths.sum()))
        if self.number.new:
            place = [self.bare[w.strip(EDGES)] for w in self.number.new]
            self.place = np.concatenate([self.place, np.array(place, np.int64)])
            if self.bare.new:
                self.add(self.bare.new)
            self.number.new, self.bare.new = [], []
        i = self.place[i]
        some = self.hash[i] != 0
        return i[some], np.bincount(np.repeat(np.arange(len(found)), lengths)[some], minlength=len(found))

    def add(self, bare: list[str]) -> None:
        import xxhash

        made = np.fromiter((xxhash.xxh64_intdigest(b) or 1 if b else 0 for b in bare), np.uint64, len(bare))
        self.hash = np.concatenate([self.hash, made])


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return before * np.uint64(0x9E3779B97F4A7C15) + after * np.uint64(0xC2B2AE3D27D4EB4F)


def chance(t: np.ndarray, o: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """Log of how much likelier the counts are if any share of toxic documents is as likely than with this share."""
    t, o = np.asarray(t, np.int64), np.asarray(o, np.int64)
    same = FACTORIAL[t + o] - FACTORIAL[t] - FACTORIAL[o] + t * np.log(share) + o * np.log1p(-share)
    return -np.log1p(t + o) - same


def sure(telling: float, chances: np.ndarray) -> np.ndarray:
    """Posterior that counts tell the classes apart, if the part telling of all does."""
    return 1 / (1 + (1 - telling) / telling * np.exp(np.minimum(-chances, 700.0)))


def telling(chances: np.ndarray, n: np.ndarray) -> float:
    part = 0.05
    for _ in range(100):
        part = min(max(float((sure(part, chances) * n).sum() / n.sum()), 1e-6), 0.5)
    return part


def at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted keys in sorted ones, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


class Keys:
    """Sorted hashes, looked up by their first bits: a start for each value of these, then one key after the other."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(len(keys).bit_length(), 1)
        self.shift, self.half = keys.dtype.type(64 - bits), (1 << bits - 1) if keys.dtype.kind == "i" else 0
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.first(keys), minlength=1 << bits))]).astype(np.int32)

    def first(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift).astype(np.int64) + self.half

    def at(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As at(); the place of a key that isn't there is any."""
        first = self.first(wanted)
        place, end, there = self.starts[first].astype(np.int64), self.starts[first + 1], np.zeros(len(wanted), bool)
        left = np.flatnonzero(place < end)
        while len(left):
            key, want = self.keys[place[left]], wanted[left]
            there[left[key == want]] = True
            left = left[key < want]
            place[left] += 1
            left = left[place[left] < end[left]]
        place[~there] = 0
        return place, there


class Letters:
    """Counts of pieces of letters in documents of the toxic and the ordinary class (columns 1 and 0), keys sorted."""

    def __init__(self, table: pa.Table):
        key = table.column("w").to_numpy()
        order = np.argsort(key)
        self.key = key[order]
        self.n = np.stack([table.column(c).to_numpy().astype(np.int32)[order] for c in ("o", "t")], 1)
        self.total, self.distinct = self.n.sum(0, dtype=np.int64), (self.n > 0).sum(0)
        self.share = float(self.total[1] / max(self.total.sum(), 1))
        self.telling, self.known = 0.01, np.zeros(0)

    def learn(self) -> None:
        """How many pieces tell the classes apart, and the ratio of each."""
        counts, n = np.unique(self.n, axis=0, return_counts=True)
        self.telling = telling(chance(counts[:, 1], counts[:, 0], self.share), n)
        self.known = self.ratio_of(self.n.astype(np.int64))

    def ratio_of(self, n: np.ndarray) -> np.ndarray:
        """Log ratio of pieces with these counts, none for one that isn't left."""
        alone = np.maximum(n.sum(1), 1) / self.total.sum()
        own = (np.maximum(n - D, 0) + D * self.distinct * alone[:, None]) / self.total
        s = sure(self.telling, chance(n[:, 1], n[:, 0], self.share))[:, None]
        p = s * own + (1 - s) * alone[:, None]
        return np.where(n.sum(1) > 0, np.log(p[:, 1] / p[:, 0]), 0.0)

    @functools.cached_property
    def keys(self) -> Keys:
        return Keys(self.key)

    @functools.cached_property
    def without(self) -> list[np.ndarray]:
        """The ratio of each piece without one document of either class."""
        return [self.ratio_of(np.maximum(self.n - one, 0).astype(np.int64)) for one in np.eye(2, dtype=np.int64)]

    def ratios(self, bare: list[str], owns: list[int | None]) -> list[np.ndarray]:
        """Log ratio of words by their letters, the mean of their pieces, for each of owns: a class of which the counts of
        one document that holds them all are left out."""
        if not len(self.key) or not bare:
            return [np.zeros(len(bare)) for _ in owns]
        keys, owner = grams(bare)
        place, there = self.keys.at(keys)
        n = np.maximum(np.bincount(owner, minlength=len(bare)), 1)
        place, owner = place[there], owner[there]
        return [np.bincount(owner, (self.known if own is None else self.without[own])[place], len(bare)) / n for own in owns]


class Model:
    """Counts of the toxic and the ordinary class (columns 1 and 0).

    word, n: sorted hashes and counts. of, types, all_types, follows: of each word, the pairs it begins by class, the
    distinct ones by class and in all, and the distinct words it follows. pair, pair_n: sorted keys and counts."""

    def __init__(self, vocabulary: pa.Table):
        def columns(*names: str) -> np.ndarray:
            return np.stack([vocabulary.column(c).to_numpy().astype(np.int32)[order] for c in names], 1)

        key = vocabulary.column("w").to_numpy().view(np.uint64)
        order = np.argsort(key)
        self.word, self.n = key[order], columns("o", "t")
        self.of, self.types = columns("of_o", "of_t"), columns("types_o", "types_t")
        self.all_types, self.follows = columns("types")[:, 0], columns("follows")[:, 0]
        self.pair, self.pair_n = np.zeros(0, np.int64), np.zeros((0, 2), np.uint16)
        self.total, self.distinct = self.n.sum(0, dtype=np.int64), (self.n > 0).sum(0)
        self.shared = int(np.maximum(self.follows, 1).sum(dtype=np.int64))
        self.telling = self.pair_telling = 0.01
        self.letters: Letters | None = None
        self.made: dict[float, np.ndarray] = {}

    @functools.cached_property
    def words(self) -> Keys:
        return Keys(self.word)

    @functools.cached_property
    def pairs(self) -> Keys:
        return Keys(self.pair)

    @property
    def usable(self) -> bool:
        return bool((self.total > 0).all())

    @property
    def share(self) -> float:
        return float(self.total[1] / self.total.sum())

    def learn(self, parts: Iterator[pa.Table]) -> None:
        """The pairs (k, w, t, o, in parts of rising k), and how many words and pairs tell the classes apart."""
        counts, n = np.unique(self.n, axis=0, return_counts=True)
        self.telling = telling(chance(counts[:, 1], counts[:, 0], self.share), n)
        edges, seen, keys, both = np.arange(-40, 40.05, 0.1), 0, [self.pair], [self.pair_n]
        for table in parts:
            k = table.column("k").to_numpy()
            order = np.argsort(k)
            place, _ = at(self.word, table.column("w").to_numpy().view(np.uint64)[order])
            keys.append(k[order])
            both.append(np.stack([table.column(c).to_numpy().astype(np.uint16)[order] for c in ("o", "t")], 1))
            c = chance(both[-1][:, 1], both[-1][:, 0], self.shares(self.probability(self.n[place], place)))
            seen = seen + np.histogram(np.clip(c, -40, 40), edges)[0]
        self.pair, self.pair_n = np.concatenate(keys), np.concatenate(both)
        if np.sum(seen):
            self.pair_telling = telling((edges[:-1] + edges[1:]) / 2, seen)

    def shares(self, p: np.ndarray) -> np.ndarray:
        odds = self.share / (1 - self.share) * p[:, 1] / p[:, 0]
        return np.clip(odds / (1 + odds), 1e-9, 1 - 1e-9)

    def probability(self, n: np.ndarray, place: np.ndarray, letters: np.ndarray | float = 0.0) -> np.ndarray:
        """P(word) in both classes; letters: the log ratio of its letters."""
        tilt = np.exp(np.multiply.outer(np.broadcast_to(letters, len(n)), np.array([-0.5, 0.5])))
        own = (np.maximum(n - D, 0) + D * self.distinct * (np.maximum(self.follows[place], 1) / self.shared)[:, None] * tilt) / self.total
        s = sure(self.telling, chance(n[:, 1], n[:, 0], self.share))[:, None]
        return s * own + (1 - s) * (np.maximum(n.sum(1), 1) / self.total.sum())[:, None] * tilt

    def pair_ratios(self, pair: np.ndarray, before: np.ndarray, n: np.ndarray, q: np.ndarray, own: int | None = None) -> np.ndarray:
        """Log ratio of pairs by their places, the places of the words they begin with, and count and probability of those
        they end with; with own, without one document of that class, and none (nan) for a pair that isn't left."""
        m, of, types, all_types = self.pair_n[pair].astype(np.int64), self.of[before].astype(np.int64), self.types[before].astype(np.int64), self.all_types[before].astype(np.int64)
        out = np.full(len(pair), np.nan)
        if own is not None:
            m[:, own] -= 1
            of[:, own] -= 1
            types[:, own] -= m[:, own] == 0
            all_types -= m.sum(1) == 0
        left = np.flatnonzero(m.sum(1) > 0)
        if own is not None:
            m, n, q, of, types, all_types = (x[left] for x in (m, n, q, of, types, all_types))
        alone = np.maximum(n, 1) / self.total.sum()
        pool = (np.maximum(m.sum(1) - D, 0) + D * all_types * alone) / of.sum(1)
        back = pool[:, None] * q / alone[:, None]
        made = np.where(of > 0, (np.maximum(m - D, 0) + D * types * back) / np.maximum(of, 1), back)
        s = sure(self.pair_telling, chance(m[:, 1], m[:, 0], self.shares(q)))[:, None]
        made = s * made + (1 - s) * back
        out[left] = np.log(made[:, 1] / made[:, 0])
        return out


class Scores(Words):
    """Words with what a model says of them, in ways (weight of the letters, class of which one document is left out).

    A ratio follows from the word, or from its pair, alone. So it is worked out once for each, and those of pairs with all
    counts stay with the model, as a Python worker uses one model in many tasks."""

    def __init__(self, model: Model, ways: list[tuple[float, int | None]]):
        self.model, self.ways = model, ways
        super().__init__()

    def clear(self) -> None:
        super().clear()
        self.at, self.there = np.zeros(0, np.int64), np.zeros(0, bool)
        #: For each way count, probability and ratio.
        self.said = [(np.zeros(0, np.int64), np.zeros((0, 2)), np.zeros(0)) for _ in self.ways]

    def add(self, bare: list[str]) -> None:
        super().add(bare)
        place, there = self.model.words.at(self.hash[-len(bare) :])
        self.at, self.there = np.concatenate([self.at, place]), np.concatenate([self.there, there])
        owns = [own for weight, own in self.ways if weight]
        by_letters = dict(zip(owns, self.model.letters.ratios(bare, owns)))
        for k, (weight, own) in enumerate(self.ways):
            letters = weight * by_letters[own] if weight else np.zeros(len(bare))
            n = self.model.n[place].astype(np.int64)
            if own is not None:
                n[:, own] = np.maximum(n[:, own] - 1, 0)
            n[~there] = 0
            p = self.model.probability(n, place, letters)
            n = n.sum(1)
            r = np.where(n > 0, np.log(p[:, 1] / p[:, 0]), letters)
            self.said[k] = tuple(map(np.concatenate, zip(self.said[k], (n, p, r))))

    def of_pairs(self, k: int, pair: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        n, p, _ = self.said[k]
        weight, own = self.ways[k]
        if own is not None:
            return self.model.pair_ratios(pair, self.at[before], n[after], p[after], own)
        if weight not in self.model.made:
            self.model.made[weight] = np.full(len(self.model.pair), np.nan)
        made = self.model.made[weight]
        new = np.flatnonzero(np.isnan(made[pair]))
        made[pair[new]] = self.model.pair_ratios(pair[new], self.at[before[new]], n[after[new]], p[after[new]])
        return made[pair]

    def evidence(self, texts: list[str | None], ways: list[int]) -> np.ndarray:
        """The evidence of each text (rows) in each of these ways (columns)."""
        i, lengths = self.numbered(texts)
        starts, full = np.cumsum(lengths) - lengths, lengths > 0
        known = self.there[i]
        both = known[:-1] & known[1:]
        both[starts[(starts > 0) & (starts < len(i))] - 1] = False
        second = np.flatnonzero(both) + 1
        pair, there = self.model.pairs.at(pair_keys(self.hash[i[second - 1]], self.hash[i[second]]).view(np.int64))
        pair, second = pair[there], second[there]
        out = np.zeros((len(texts), len(ways)))
        for column, k in enumerate(ways):
            r = self.said[k][2][i]
            made = self.of_pairs(k, pair, i[second - 1], i[second])
            r[second] = np.where(np.isnan(made), r[second], made)
            if len(r):
                out[full, column] = np.add.reduceat(r, starts[full]) / (lengths[full] + PRIOR_WORDS)
        return out


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, hold_out: bool = True) -> DataFrame:
    """text, toxic of the documents to learn from: a bounded number and length of each class, one row for each id."""
    marks = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (~held_out(F.col("doc_id")) if hold_out else F.lit(True)))
        .groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    )
    few = [marks.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for c in (F.col("toxic"), ~F.col("toxic"))]
    chosen = few[0].unionByName(few[1])  # 2 x PER_CLASS rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Words are counted after the join, in the aggregate: a filter by n would go below it and count those of every text.
    short = F.col("n") <= LONGEST
    one = (
        texts.join(F.broadcast(chosen), "doc_id").withColumn("n", n_words(F.col("text"))).groupBy("doc_id", "toxic")
        .agg(F.min_by(F.when(short, F.struct("text", "n")), F.when(short, F.xxhash64("text"))).alias("row"))
        .where("row is not null").select("doc_id", "toxic", "row.*")
    )
    rows = written(one, "toxicity-rows")
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")  # PER_CLASS numbers at most
    whole = rows.select("doc_id", (F.sum("n").over(order) <= WORDS_PER_CLASS).alias("learnt")).where("learnt")
    return rows.join(F.broadcast(whole), "doc_id").select("text", "toxic")


#: Kinds of what is counted.
WORD, PAIR, PIECE = 0, 1, 2
#: Texts that are counted or scored at once.
AT_ONCE = 200
#: Rows that a task sums up before they are shuffled.
HELD_ROWS = 1_000_000


def fit(train: DataFrame) -> Model:
    """The counts of the bounded training rows."""

    def summed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Counts of each (kind, h, w, k, toxic) of documents that are held."""
        for kind in (WORD, PAIR, PIECE):
            h, w, k, lengths, toxic = zip(*(x[1:] for x in held if x[0] == kind))
            h, w, k = map(np.concatenate, (h, w, k))
            _, first, which = np.unique(k if kind == PAIR else w, return_index=True, return_inverse=True)
            t = np.bincount(which, np.repeat(toxic, lengths), len(first)).astype(np.int64)
            columns = np.full(len(first), kind, np.int64), h[first], w[first], k[first], t, np.bincount(which, minlength=len(first)) - t
            for start in range(0, len(first), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[start : start + 50_000]) for x in columns], ["kind", "h", "w", "k", "t", "o"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, rows = Words(), [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                texts, marks = (c.to_pylist() for c in batch.slice(start, AT_ONCE).columns[:2])
                places, lengths = known.numbered(texts)
                names = list(known.bare)
                for i, toxic in zip(np.split(places, np.cumsum(lengths)[:-1]), marks):
                    pairs, one = np.unique(i[:-1] << 32 | i[1:]), np.unique(i)
                    h, w = known.hash[pairs >> 32], known.hash[pairs & (1 << 32) - 1]
                    pieces = np.unique(grams(list(map(names.__getitem__, one.tolist())))[0]) if len(one) else one
                    for kind, h, w in (WORD, None, known.hash[one]), (PAIR, h, w), (PIECE, None, pieces):
                        h = np.zeros(len(w), np.int64) if h is None else h
                        k = pair_keys(h, w) if kind == PAIR else h
                        held.append((kind, *(x.view(np.int64) for x in (h, w, k)), len(w), int(toxic)))
                        rows += len(w)
                    if rows > HELD_ROWS:
                        yield from summed(held)
                        held, rows = [], 0
        if held:
            yield from summed(held)

    counts = train.mapInArrow(count, "kind long, h long, w long, k long, t long, o long").groupBy("kind", "h", "w", "k")
    counts = written(counts.agg(F.sum("t").cast("int").alias("t"), F.sum("o").cast("int").alias("o")), "toxicity-counts")
    pairs = counts.where(F.col("kind") == PAIR)
    begun = pairs.groupBy(F.col("h").alias("w")).agg(
        F.sum("t").cast("int").alias("of_t"), F.sum("o").cast("int").alias("of_o"), F.count_if(F.col("t") > 0).cast("int").alias("types_t"),
        F.count_if(F.col("o") > 0).cast("int").alias("types_o"), F.count(F.lit(1)).cast("int").alias("types"),
    )
    follows = pairs.groupBy("w").agg(F.count(F.lit(1)).cast("int").alias("follows"))
    vocabulary = counts.where(F.col("kind") == WORD).select("w", "t", "o").join(begun, "w", "left").join(follows, "w", "left").na.fill(0)
    model = Model(vocabulary.toArrow())
    if model.usable:
        # Part by part, so that the driver holds little besides the model.
        step = (1 << 64) // PARTS
        parts = (pairs.where(F.col("k").between(a, a + step - 1)).select("k", "w", "t", "o") for a in range(-(1 << 63), 1 << 63, step))
        model.learn(part.toArrow() for part in parts)
        model.letters = Letters(counts.where(F.col("kind") == PIECE).select("w", "t", "o").toArrow())
        model.letters.learn()
    return model


def best_cut(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The best F1 of accepting all above a threshold, and the middle of the gap in which that lies."""
    order = np.argsort(-x, kind="stable")
    x, y = x[order], y[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(x) + 1) + max(y.sum(), 1))
    f1[:-1][x[:-1] == x[1:]] = -1
    best = int(f1.argmax())
    below = x[best + 1] if best + 1 < len(x) else 0.0
    return float(f1[best]), float(max((x[best] + max(below, 0.0)) / 2, 1e-6))


def chosen_weight(train: DataFrame, model: Broadcast) -> tuple[float, float]:
    """The weight of the letters and the threshold that do best on the training rows, each without its own counts."""
    rows = train.select(evidence_without_udf(model)("text", "toxic").alias("x"), "toxic").collect()  # 2 x PER_CLASS at most
    x, y = np.array([r.x for r in rows]), np.array([r.toxic for r in rows])
    cuts = [(*best_cut(x[:, i], y), w) for i, w in enumerate(LETTER_WEIGHTS)]
    _, cut, weight = max(cuts, key=lambda c: (round(c[0], 9), c[2]))
    return weight, cut


def evidence_udf(model: Broadcast, weight: float):
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Scores(model.value, [(weight, None)])
        for texts in batches:
            made = [known.evidence(list(texts[i : i + AT_ONCE]), [0])[:, 0] for i in range(0, len(texts), AT_ONCE)]
            yield pd.Series(np.concatenate([np.zeros(0), *made]), dtype="float64")
        known.clear()
        tidy()

    return run


def evidence_without_udf(model: Broadcast):
    """The evidence of texts learnt from, each without its own counts, for each weight of the letters."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = Scores(model.value, [(weight, own) for own in (0, 1) for weight in LETTER_WEIGHTS])
        n = len(LETTER_WEIGHTS)
        for texts, toxic in batches:
            made = np.zeros((len(texts), n))
            for own in (0, 1):
                rows = np.flatnonzero(toxic.to_numpy(bool) == bool(own))
                for i in range(0, len(rows), AT_ONCE):
                    some = rows[i : i + AT_ONCE]
                    made[some] = known.evidence(list(texts.iloc[some]), list(range(own * n, own * n + n)))
            yield pd.Series(made.tolist())
        known.clear()
        tidy()

    return run


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hold_out: bool = True) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (score >= 0.7).

    Without hold_out the labels of the held-out fold are learnt from too, for use rather than for measuring."""
    train = labelled(short_batches(docs), labels, id_col, text_col, hold_out)
    model = fit(train)
    rest = docs.select(*[c for c in docs.columns if c not in ("held_out", "score", "predicted")], held_out(F.col(id_col)).alias("held_out"))
    if not model.usable:
        return rest.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    model = docs.sparkSession.sparkContext.broadcast(model)
    weight, cut = chosen_weight(train, model)
    x = evidence_udf(model, weight)(F.col(text_col))
    score = 1 / (1 + F.exp(-((F.col("score") / cut - 1) * 5 + math.log(CUT / (1 - CUT)))))
    return (
        rest.withColumn("score", x).withColumn("predicted", (F.col("score") >= cut).cast("int"))
        .withColumn("score", F.when(F.col("predicted") == 1, F.greatest(score, F.lit(CUT))).otherwise(F.least(score, F.lit(CUT - 1e-9))))
    )
