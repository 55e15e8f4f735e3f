"""Token ids of whole texts through the tokenizers library, with a bounded memo of words.

A byte-level BPE first cuts a text into pieces that never cross from a visible character to white space, and
ends every letter run before punctuation. So a text can be cut at such places, each distinct cut encoded once
and its ids kept; joining the kept ids gives the ids of the whole text. A text with unusual white space, in
which those cuts aren't certain, is encoded whole. tests/llm compares both ways."""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PIECE = re.compile(
    rf"[\n\t\r](?=[^ \n\t\r])| ?[{LETTERS}]+(?=[.,;:!? \n\t\r]|\Z)|[.,;:!?]+(?=[ \n\t\r]|\Z)"
    r"|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+"
)
RUN = re.compile(rf" ?[{LETTERS}]+\Z")
#: Marks that a word may end with: no letter, digit, blank or apostrophe.
TAIL = ".,;:!?\"#$%&()*+-/<=>@[\\]^_`{|}~"
ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n\t\r"]
RUNS = ("  ", " \n", " \t", " \r")
#: Entries of a memo.
MEMO = 400_000
#: Cuts that are kept as Arrow arrays, from texts that are encoded together; what marks them, and the characters of a text up
#: to which it is among these.
CUTS = 1_000_000
CUT_MARK = "\x01"
TOGETHER = 1_000_000


def is_run(text: str) -> bool:
    body = text.removeprefix(" ")
    return body.isalpha() if body.isascii() else bool(RUN.match(text))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Memo(dict):
    """text -> ids as bytes, filled at the first look-up; when it holds `size` keys it starts anew.

    The keys before stay at hand as `old` until the next start, so that a frequent one is never made again."""

    def __init__(self, fill, size: int = MEMO):
        super().__init__()
        self.fill, self.size, self.old = fill, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.fill(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: a printable Latin-1 character stands for itself, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """The ids that the tokenizers library gives with add_special_tokens=False. A string of an added token in a text
    gives that token's id, as there; with literal it is text like any other."""

    def __init__(self, path: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.added = [] if literal else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.words = Memo(self._word)
        #: Cuts of many() and their ids, as Arrow arrays.
        self.known = None

    def _whole(self, text: str) -> bytes:
        (made,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(made.ids, self.dtype).tobytes()

    def _run(self, run: str) -> bytes:
        """A letter run is one pre-token, which the BPE model takes in its byte alphabet."""
        if run.isascii():
            mapped = "Ġ" + run[1:] if run[0] == " " else run
        else:
            mapped = run.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _word(self, text: str) -> bytes:
        if is_run(text):
            return self._run(text)
        body = text.rstrip(TAIL)
        if body != text and is_run(body):  # then the tail is one pre-token
            return self.words[body] + self.words[text[len(body) :]]
        pieces = PIECE.findall(text)
        return self._whole(text) if len(pieces) < 2 else b"".join(map(self.words.__getitem__, pieces))

    def ids(self, text: str | None) -> bytes:
        """The ids of the whole text as bytes of self.dtype; null is an empty text."""
        if not text:
            return b""
        if self._odd(text):
            return self._whole(text)
        if any(c in text for c in RUNS):
            return self._word(text)
        return b"".join(map(self.words.__getitem__, self._keys(text)))

    def _odd(self, text: str) -> bool:
        return any(c in text for c in ODD) or any(t in text for t in self.added)

    def many(self, texts: list[str | None]) -> list[bytes]:
        """ids() of each of some texts. Arrow numbers the cuts of all of them and finds those that are known, so that Python
        handles only new ones; a text with unusual white space, the mark or great length goes by itself."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out: list[bytes] = [b""] * len(texts)
        plain, marked = [], []
        for i, text in enumerate(texts):
            if text and (len(text) > TOGETHER or CUT_MARK in text or any(c in text for c in RUNS) or self._odd(text)):
                out[i] = self.ids(text)
            elif text:
                plain.append(i)
                marked.append(self._marked(text))
        if not plain:
            return out
        cuts = pc.split_pattern(pa.array(marked, pa.large_string()), pattern=CUT_MARK)
        coded = pc.dictionary_encode(cuts.flatten())
        if self.known is None:
            self.known = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        found = pc.index_in(coded.dictionary, value_set=self.known[0])
        new = coded.dictionary.filter(found.is_null())
        made = [self._word(k) if k[-1:] in TAIL else self.words[k] for k in new.to_pylist()]
        place = found.fill_null(-1).to_numpy().copy()
        place[place < 0] = len(self.known[0]) + np.arange(len(new))
        self.known = tuple(map(pa.concat_arrays, zip(self.known, (new, pa.array(made, pa.large_binary())))))
        now = self.known[1].take(pa.array(place))
        if len(self.known[0]) > CUTS:
            self.known = coded.dictionary, now
        parts = now.take(coded.indices)
        starts, ids = map(memoryview, parts.buffers()[1:])
        at = np.frombuffer(starts, np.int64)[cuts.offsets.to_numpy()].tolist()
        for i, start, end in zip(plain, at, at[1:]):
            out[i] = bytes(ids[start:end])
        return out

    @staticmethod
    def _marked(text: str) -> str:
        """The text with marks between its _keys()."""
        marked = text.replace(" ", CUT_MARK + " ")
        return marked if "\n\n" in text else marked.replace("\n", f"{CUT_MARK}\n{CUT_MARK}")

    @staticmethod
    def _keys(text: str) -> list[str]:
        """The cuts of a text without runs of blanks: words with the blank before them, and single line feeds."""
        if "\n\n" in text:
            first, *rest = text.split(" ")
            return [first, *[" " + w for w in rest]]
        keys = []
        for line in text.split("\n"):  # a line feed without another one or a blank before it is a piece of its own
            first, *rest = line.split(" ")
            keys += "\n", first
            keys += [" " + w for w in rest]
        return keys[1:]


@functools.lru_cache(maxsize=2)
def encoder(path: str, literal: bool = False) -> Encoder:
    """One per Python worker, so that the memo outlives a task."""
    return Encoder(path, literal)
