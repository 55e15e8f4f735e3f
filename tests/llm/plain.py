"""Plain versions of what the operators do, and documents with all the awkward cases."""

import random

BLANKS = " \t\n\x0b\x0c\r"
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, n_lines string"

_rng = random.Random(5)
WORDS = [f"word{i}" for i in range(400)]


def sentence(n: int) -> str:
    return " ".join(_rng.choices(WORDS, k=n))


SHARED = "This Line Is Shared By Many Documents And Is Long Enough"
BASE = sentence(120)


def awkward() -> list[tuple]:
    rows = [(i, f"{sentence(30)}\n  {SHARED if i % 2 else SHARED.upper()}\t\n{sentence(12)}", "abc"[i % 3], "x") for i in range(14)]
    rows += [(100 + i, BASE, "a", None) for i in range(6)]  # exact copies
    rows += [(110, BASE + " tail", "b", None), (111, BASE.replace("word1 ", "other ", 1), None, None)]  # near copies
    rows += [(200, None, "a", None), (201, "", None, None), (202, " \t\n ", "c", None), (203, "one", "c", None)]
    rows += [(None, "no id here\n" + SHARED, "a", None), (None, None, None, None)]
    rows += [(3, "an id again\n" + SHARED, "b", None), (300, BASE, "z", None), (300, BASE, "z", None)]
    rows += [(400, "\n".join([sentence(2000)] + [SHARED] * 3), "a", None), (401, "x" * 50_000, "a", None)]
    rows += [(402, "ä b　c \x85d\xa0e É", "b", None), (403, "a\r\nb\r\n\r\n" + "=" * 60, "b", None)]
    return rows


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    out, now = [], ""
    for c in text or "":
        if c in BLANKS:
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return [*out, now] if now else out


def joined(nodes, edges) -> dict:
    """node -> smallest node of its component."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
