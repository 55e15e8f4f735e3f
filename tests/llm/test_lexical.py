"""Ranked search against scores computed one document after the other."""

import math
import re
from collections import Counter

import plain
from qsolake.llm import lexical

ITEMS = [
    (1, "This line is SHARED by word7 and word8, word7"), (2, "d0e É x"), (2, "here no word9"), (3, None), (4, " \n"), (5, "unheard-of"), (None, "no id here"),
    (6, "\x85d\xa0e"), (7, plain.BASE), (8, "A B a"),
]


def terms(text: str | None) -> list[str]:
    return re.findall(lexical.TERM, plain.lower(text or ""))


def expected(docs: list[tuple], items: list[tuple], k: int = lexical.K) -> Counter:
    """(item_id, rank, doc_id, score) from (doc_id, text) and (item_id, text)."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in held)
    length = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item in {i for i, _ in items}:
        wanted = {t for i, text in items if i == item for t in terms(text)}
        scores = []
        for doc, c in held:
            n = sum(c.values())
            m = n and 10 + 90 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score:
                scores.append((-score, -math.inf if doc is None else doc))
        for rank, (score, doc) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, None if doc == -math.inf else doc, -score] += 1
    return out


def made(spark, docs, items, **options) -> Counter:
    table = spark.createDataFrame(docs, plain.DOCS).selectExpr("*", "'x' as term", "1 as bucket", "2 as batch")
    wanted = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as score", "'y' as w")
    index = lexical.postings(table.repartition(3))
    return Counter(tuple(r) for r in lexical.search(index, wanted, **options).select("item_id", "rank", "doc_id", "score").collect())


def test_awkward_rows(spark):
    docs = plain.awkward()
    want = expected([r[:2] for r in docs], ITEMS)
    assert len({k[0] for k in want}) == 6 and made(spark, docs, ITEMS) == want


def test_items_that_are_not_sent(spark):
    docs = plain.awkward()
    want = expected([r[:2] for r in docs], ITEMS, 3)
    assert made(spark, docs, ITEMS, k=3, sent_terms=0) == want


def test_long_lists_are_dealt_by_batch(spark, monkeypatch):
    docs = plain.awkward()
    monkeypatch.setattr(lexical, "LONG_LIST", 2)
    monkeypatch.setattr(lexical, "AT_ONCE", 7)
    assert made(spark, docs, ITEMS) == expected([r[:2] for r in docs], ITEMS)


def test_empty_tables(spark):
    assert not made(spark, [], ITEMS) and not made(spark, plain.awkward(), []) and not made(spark, [(1, None, "a", "b")], ITEMS)


def test_whole_table_has_each_posting_once(spark):
    docs = spark.read.parquet(f"{plain.SF}/documents.parquet")
    want = Counter()
    for r in docs.collect():
        for t, tf in Counter(terms(r.text)).items():
            want[t, r.doc_id, tf] += 1
    lists = lexical.postings(docs).where(f"term <> '{lexical.ALL}'")
    got = Counter((r.term, r.p.ids, r.p.counts >> 32) for r in lists.selectExpr("term", "explode(arrays_zip(ids, counts)) p").collect())
    assert got == want
    assert lists.selectExpr("bucket", "term").distinct().count() == len({t for t, *_ in want})
