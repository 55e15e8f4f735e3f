"""op10's files and op9's packing, against the tokenizers library on whole texts."""

import functools
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import plain
from qsolake.llm import packing, token_files, tokens
from qsolake.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def whole():
    made = Tokenizer.from_file(PATH)
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aAéz'’s 0 1\n\t\r.,;!?-_<>|\xa0\x85 漢")), st.characters(codec="utf-8")), max_size=60))
def test_cut_text_encodes_as_the_whole(text):
    code = encoder(PATH)
    assert np.frombuffer(code.ids(text), code.dtype).tolist() == whole()(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from(list("aAéz'’s 0 1\n\t\r.,;!?-_<>|\xa0\x01漢")), st.characters(codec="utf-8")), max_size=40)), max_size=8))
def test_texts_encode_together_as_alone(texts):
    code = encoder(PATH)
    assert [np.frombuffer(x, code.dtype).tolist() for x in code.many(texts)] == [whole()(t) for t in texts]


def test_cuts_of_many_texts_are_encoded_once(monkeypatch):
    made, word = [], tokens.Encoder._word
    monkeypatch.setattr(tokens.Encoder, "_word", lambda self, text: (made.append(text), word(self, text))[1])
    code, texts = tokens.Encoder(PATH), [f"some words, again\n\nand {i % 3} again. <|endoftext|>"[: 40 - i % 2 * 14] for i in range(60)]
    code.words.size = 2
    for _ in range(3):
        assert [np.frombuffer(x, code.dtype).tolist() for x in code.many(texts)] == [whole()(t) for t in texts]
    assert max(Counter(made).values()) <= 3
    monkeypatch.setattr(tokens, "CUTS", 3)
    for part in (texts, ["other words"], texts[:7]):
        assert [np.frombuffer(x, code.dtype).tolist() for x in code.many(part)] == [whole()(t) for t in part]
    assert len(code.known[0]) < 20


def test_special_strings_are_as_in_the_library_or_text():
    text = "a <|endoftext|> b <|endoftext|>"
    code, literal = encoder(PATH), encoder(PATH, True)
    assert np.frombuffer(code.ids(text), code.dtype).tolist() == whole()(text)
    assert 50256 not in np.frombuffer(literal.ids(text), literal.dtype)
    assert literal.tokenizer.decode(np.frombuffer(literal.ids(text), literal.dtype).tolist(), skip_special_tokens=False) == text


def test_ids_that_are_no_integers_are_refused(spark):
    for kind, ok in (("string", False), ("smallint", True)):
        docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
        if ok:
            assert [r.doc_id for r in token_files.read_token_files(token_files.write_token_files(docs)).collect()] == [1]
        else:
            with pytest.raises(TypeError):
                token_files.write_token_files(docs)


def test_files_round_trip(spark):
    rows = plain.awkward()
    encode = whole()
    manifest = token_files.write_token_files(spark.createDataFrame(rows, plain.DOCS))
    found = token_files.read_token_files(manifest).collect()
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in found) == Counter(
        (d, len(ids), np.array(ids, "<u4").tobytes()) for d, t, *_ in rows for ids in [[*encode(t), 0]]
    )
    found.sort(key=lambda r: r.start)
    at = 0
    for before, r in zip([None, *found], found):
        assert r.start == at and (not before or (before.doc_id is None or before.doc_id <= r.doc_id))
        at += r.n_tokens


def test_files_are_views(spark):
    manifest = token_files.write_token_files(spark.createDataFrame(plain.awkward(), plain.DOCS), length=64)
    for row in manifest.collect():
        n = 0
        for ids, mask in token_files.sequences(row.tokens_file):
            assert ids.shape[1] == 64 and not ids.flags.owndata
            assert pa.types.is_fixed_size_list(mask.type)
            n += sum(mask.flatten().to_pylist())
        assert n == row.n_tokens


def test_packing_keeps_each_id_once(spark):
    rows = plain.awkward()
    encode = whole()
    pieces = packing.pack(spark.createDataFrame(rows, plain.DOCS)).collect()
    texts = defaultdict(list)
    for d, t, *_ in rows:
        texts[d].append(np.array([*encode(t), 1], "<u4"))
    covered = defaultdict(int)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0 and p.length + p.offset <= 2048
        assert any(len(x) == p.doc_tokens and (x[p.start : p.start + p.length] == ids).all() for x in texts[p.doc_id])
        covered[p.doc_id] += p.length
    assert covered == {d: sum(map(len, x)) for d, x in texts.items()}
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    padded = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        size = own[0].sequence_length
        assert at <= size <= 2048 and size & (size - 1) == 0
        padded += size - at
    assert padded <= 1024


def test_empty_table(spark):
    empty = spark.createDataFrame([], plain.DOCS)
    assert packing.pack(empty).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(empty)).count() == 0


def test_hilbert_neighbours_are_neighbours():
    bits = 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3), -1).reshape(-1, 3)
    key = packing.hilbert_key(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
