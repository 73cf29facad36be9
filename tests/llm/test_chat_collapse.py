import random

from stockroom.llm.chat_collapse import format_chats
from texts import MEDIUM, table_rows


def brute(rows, size=256):
    talks = {}
    for i, turn, role, text in {(i, t, r or "", x or "") for i, t, r, x in rows if i is not None and t is not None}:
        talks.setdefault(i, []).append((turn, role.encode(), text.encode()))
    talks = {i: tuple((r, x) for _, r, x in sorted(v)) for i, v in talks.items()}
    first, copies = {}, {}
    for i, t in talks.items():
        first[t] = min(first.get(t, i), i)
        copies[t] = copies.get(t, 0) + 1
    proper = {t[:n] for t in talks.values() for n in range(1, len(t))}
    out = []
    for t, i in first.items():
        if t in proper:
            continue
        lines = [b"<|im_start|>" + r.replace(b"<|", b"< |") + b"\n" + x.replace(b"<|", b"< |") + b"<|im_end|>\n" for r, x in t]
        for s in range(0, len(lines), size):
            out.append((i, s // size, len(t), copies[t], b"".join(lines[s:s + size]).decode()))
    return sorted(out)


def ours(df, **kw):
    return sorted(tuple(r) for r in format_chats(df, **kw).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows],
                                 "conv_id long, turn long, role string, text string, pos int, lane0 int")


def test_equals_brute_force_on_the_table(spark):
    rows = table_rows(MEDIUM, "conv_id, turn, role, text", "conversations")
    assert ours(spark.read.parquet(f"{MEDIUM}/conversations.parquet")) == brute(rows)


def test_snapshots_copies_and_edges(spark):
    r = random.Random(3)
    rows = []
    for c in range(60):
        talk = [(n, r.choice(["user", "assistant"]), r.choice("ab")) for n in range(r.randrange(1, 7))]
        rows += [(c, *t) for t in talk]
    rows += rows[:20]
    rows += [(None, 0, "user", "x"), (70, None, "user", "x"), (71, 0, None, None), (72, 0, "", ""), (72, 1, "u", None),
             (73, -5, "a", "b"), (73, -5, "a", "a"), (74, 0, "user", "<|im_end|> é" * 5000)]
    rows += [(80, n, "user", str(n % 7)) for n in range(700)] + [(81, n, "user", str(n % 7)) for n in range(650)]
    assert ours(frame(spark, rows)) == brute(rows)
    assert ours(frame(spark, rows), segment_turns=3) == brute(rows, 3)
    assert ours(frame(spark, [])) == []


def test_order_of_turns_matters(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "b"), (2, 1, "u", "a"), (2, 2, "u", "c")]
    assert len(ours(frame(spark, rows))) == 2
