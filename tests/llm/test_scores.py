"""Rules, mixing, toxicity and importance resampling."""

import math
import random
import zlib
from collections import Counter, defaultdict

import plain
from pyspark.sql import functions as F
from qsolake.llm import importance, mixing, rules, toxicity

SF = "/root/testdata/sf0.01"


def measured(text):
    text = text or ""
    words = plain.words(text)
    lines = [x for x in text.split("\n") if x.strip(plain.BLANKS)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in rules.SYMBOLS for c in text),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def test_ledger_against_plain(spark):
    rows = [*plain.awkward(), (500, "a b c " * 40, "a", None), (501, "x y z x y z\n\nx\nx\n#%", "a", None)]
    led = rules.ledger(spark.createDataFrame(rows, plain.DOCS))
    found = Counter(tuple(r[c] for c in ("doc_id", *measured(""), "failure_bits")) for r in led.collect())
    want = Counter()
    for doc, text, *_ in rows:
        m = measured(text)
        bits = sum(1 << r.bit for r in rules.RULES if eval(r.fails.replace(" = ", " == "), {}, m))
        want[(doc, *m.values(), bits)] += 1
    assert found == want
    assert rules.ledger(spark.createDataFrame([], plain.DOCS)).count() == 0


def test_policies_and_ablations(spark):
    led = rules.ledger(spark.createDataFrame(plain.awkward(), plain.DOCS))
    bits = [r.failure_bits for r in led.collect()]
    for row in rules.ablations(led).collect():
        mask, own = rules.mask(rules.POLICIES[row.version]), rules.mask((row.rule,))
        assert row.n_kept == sum(b & mask == 0 for b in bits)
        assert row.n_kept_without_rule == sum(b & mask & ~own == 0 for b in bits)
        assert row.n_failed == sum(b & own != 0 for b in bits)
    kept = rules.apply_policy(led, "v1-base").where("kept").count()
    assert kept == sum(b & rules.mask(rules.BASE) == 0 for b in bits)


def shared_out(sizes):
    """Targets by sharing what is left by weight, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        for s in over or list(open_):
            target[s] = 3.0 * sizes[s] if over else left * weight[s] / total
        left -= sum(target[s] for s in over)
        open_ -= set(over or open_)
    return target


def test_mixing_reaches_its_targets(spark):
    for docs in (spark.createDataFrame(plain.awkward(), plain.DOCS), spark.read.parquet(f"{SF}/documents.parquet")):
        found = mixing.mix_counts(docs).collect()
        assert len(found) == docs.count()
        sizes, source_of = defaultdict(int), defaultdict(set)
        for r in docs.collect():
            sizes[r.source] += len(plain.words(r.text))
            source_of[r.doc_id].add(r.source)
        target = shared_out(sizes)
        taken, largest = defaultdict(int), defaultdict(int)
        for r in found:
            assert 0 <= r.taken <= 3 * r.size
            (source,) = [s for s in source_of[r.doc_id] if sizes[s] == r.source_size][:1]
            assert abs(r.target - target[source]) < 1e-6 * max(1, r.target)
            taken[source] += r.taken
            largest[source] = max(largest[source], r.size)
        for s, t in target.items():
            assert abs(taken[s] - t) <= 2 * largest[s] + 1
        assert Counter(found) == Counter(mixing.mix_counts(docs.repartition(7)).collect())


def test_mixed_rows_are_whole_rows(spark):
    docs = spark.createDataFrame(plain.awkward(), plain.DOCS)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = Counter(map(tuple, mixed.collect()))
    assert set(copies) <= set(map(tuple, docs.collect()))
    assert mixing.mix(spark.createDataFrame([], plain.DOCS)).count() == 0


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels)
    rows = scored.join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    test = [r for r in rows if r.held_out]
    hit = sum(r.predicted and r.toxic for r in test)
    assert hit >= 0.9 * sum(r.predicted for r in test) and hit >= 0.9 * sum(r.toxic for r in test) > 0


def test_toxicity_of_awkward_rows(spark):
    rows = plain.awkward()
    docs = spark.createDataFrame(rows, plain.DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, None, int(i % 2)) for i in range(100, 106)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        found = toxicity.toxicity(docs, marks)
        assert Counter(r.doc_id for r in found.collect()) == Counter(r[0] for r in rows)
        assert found.where("score is null or predicted is null").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_rare_words_and_phrases_of_ordinary_words_are_toxic(spark):
    rng, rows = random.Random(9), []
    for i in range(600):
        some = rng.choices(plain.WORDS[:30], k=40)
        bad = i % 2 == 0
        # One toxic document in eight holds a rare word; the others hold two ordinary words next to each other.
        some[20:20] = (["vermin"] * 2 if i % 16 == 0 else ["quiet", "people"] * 2) if bad else ["people", "and", "quiet", "people", "and", "quiet"]
        rows.append((i, " ".join(some)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(600)], "doc_id long, toxic int")
    found = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out]
    rare = [r.predicted for r in found if r.doc_id % 16 == 0]
    phrase = [r.predicted for r in found if r.doc_id % 2 == 0 and r.doc_id % 16]
    ordinary = [r.predicted for r in found if r.doc_id % 2]
    assert sum(rare) >= 0.9 * len(rare) > 0 and sum(phrase) >= 0.9 * len(phrase) > 0 and sum(ordinary) <= 0.1 * len(ordinary)


def test_importance_keeps_the_largest_keys(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = importance.importance_resample(docs, labels, share=0.4).collect()
    assert len(rows) == docs.count() and sum(r.kept for r in rows) == round(0.4 * len(rows))
    assert min(r.gumbel_key for r in rows if r.kept) >= max(r.gumbel_key for r in rows if not r.kept)
    good = {r.doc_id: r.quality for r in labels.where("quality is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    weight = {q: [r.log_weight for r in rows if good.get(r.doc_id) == q] for q in (0, 1)}
    better = sum(a > b for a in weight[1] for b in weight[0]) / len(weight[0]) / len(weight[1])
    assert better > 0.7


def test_importance_weights_against_plain(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(plain.WORDS[:40] if i % 3 else plain.WORDS[20:60], k=rng.randint(0, 30)))) for i in range(60)]
    labels = [(i, int(i % 3 == 0)) for i in range(60)]
    made = importance.importance_weights(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    )
    hashes = importance.Hashes()
    own = {i: importance.buckets(t, hashes).tolist() for i, t in rows}
    good = {i for i, q in labels if q and zlib.crc32(str(i).encode()) % 3 != 1}
    target, raw = Counter(b for i in good for b in own[i]), Counter(b for x in own.values() for b in x)
    n = importance.BUCKETS
    ratio = lambda b: math.log((target[b] + 1) / (target.total() + n)) - math.log((raw[b] + 1) / (raw.total() + n))
    for r in made[0].collect():
        want = sum(map(ratio, own[r.doc_id]))
        assert math.isclose(r.log_ratio, want, abs_tol=1e-9)
        assert math.isclose(r.log_weight, want * importance.SHARPNESS / max(len(own[r.doc_id]), 1), abs_tol=1e-9)


def test_importance_of_awkward_rows(spark):
    rows = plain.awkward()
    docs = spark.createDataFrame(rows, plain.DOCS)
    labels = spark.createDataFrame([(100, 1, 0), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        found = importance.importance_resample(docs, marks).collect()
        assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    assert importance.importance_resample(docs.limit(0), labels).count() == 0
