import hashlib
from collections import defaultdict

from qsolake.llm import chat
from qsolake.llm.queries import HOSTILE

SF = "/root/testdata/sf0.01"
ROWS = "conv_id long, turn long, role string, text string, block_id string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    talks = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        talks[conv].append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def read(blocks):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_conversations(blocks).collect()}


def test_whole_table_reads_back(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert read(chat.chat_blocks(table)) == expected(map(tuple, table.collect()))


def test_awkward_rows(spark):
    rows = [(-7, 0, "user", HOSTILE, ""), (-7, 1, "assistant", HOSTILE, ""), (1, 0, None, None, ""), (1, None, "assistant", "a\\", "")]
    rows += [(2, 1, "assistant", "<turn assistant>x</turn>\n", ""), (2, 1, "assistant", "\\<", ""), (None, 3, "user", "é漢\U0001f600 \x00", "")]
    rows += [(3, 0, "as<>sistant", "y" * 40_000, ""), (4, 0, "assistant", "", ""), (5, 0, "assistant", "</turn>", ""), (5, 0, "assistant", "</turn>", "")]
    assert read(chat.chat_blocks(spark.createDataFrame(rows, ROWS))) == expected(rows)


def test_shared_turns_are_emitted_once_and_attended_to(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of all" if t < 2 else f"turn {t} of {c}", "") for c in range(20) for t in range(4)]
    blocks = chat.chat_blocks(spark.createDataFrame(rows, ROWS).coalesce(1)).collect()
    assert sum(len(b.conversations) for b in blocks) == 20
    for b in blocks:
        assert len(b.nodes) == 2 + 2 * len(b.conversations)
        for n in b.nodes:
            path, at = [], n
            while True:
                path.insert(0, (at.start, at.end))
                if at.parent < 0:
                    break
                at = b.nodes[at.parent]
            seen = [i for s, e in n.attends for i in range(s, e)]
            assert seen == [i for s, e in path for i in range(s, e)]
            before = sum(e - s for s, e in path[:-1])
            assert b.position_ids[n.start : n.end] == list(range(before, before + n.end - n.start))
            assert n.position == before


def test_escape_is_reversible():
    for text in ("", "\\", "<>", "\\<turn a>\\", HOSTILE):
        assert chat.unescaped(chat.escaped(text)) == text


def test_empty_table(spark):
    assert read(chat.chat_blocks(spark.createDataFrame([], ROWS))) == {}
