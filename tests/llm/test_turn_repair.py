import hashlib
import itertools
import random
import re
import zlib

import pytest
from stockroom.llm import turn_repair as T
from stockroom.llm.queries import op13_turn_repair
from texts import MEDIUM, table_rows

SCHEMA = "conv_id long, turn long, role string, text string, at int, segment string, place int, kind string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(c, t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults(rows):
    """The rows of one conversation in order, and the class of each."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:64].encode(),
                                       hashlib.md5(r[3].encode()).hexdigest()))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(T.SPACE)[-1:]
        kinds.append(T.BLANK if not last else T.DUPLICATE if (role, text) in seen else T.FINE if last in ".!?" else T.TRUNCATED)
        seen.add((role, text))
    return rows, kinds


def cheapest(kinds, initials):
    """(cost, audit) from the left: the best way into each state after each row, inserts until nothing changes."""
    ways = {"": (0, "")}
    follows = {"": "us", "s": "u", "u": "a", "a": "u"}

    def better(into, state, cost, audit):
        if state not in into or (cost, audit) < into[state]:
            into[state] = (cost, audit)
            return True
        return False

    def inserted(ways):
        changed = True
        while changed:
            changed = False
            for state, (cost, audit) in list(ways.items()):
                for role in follows[state].replace("s", ""):
                    changed |= better(ways, role, cost + 2, audit + "I")
        return ways

    for kind, initial in zip(kinds, initials):
        then = {}
        for state, (cost, audit) in inserted(ways).items():
            better(then, state, cost + 3, audit + "D")
            if kind < T.BLANK:
                extra = kind == T.TRUNCATED
                for role in follows[state]:
                    if role == initial:
                        better(then, role, cost + extra, audit + "K")
                    elif role != "s":
                        better(then, role, cost + 2 + extra, audit + "R")
        ways = then
    ways = inserted(ways)
    return min(ways[s] for s in ("", "a") if s in ways)


def exhaustive(kinds, initials):
    """All edits of a few rows, with up to two inserts in each gap."""
    gaps = ["", "u", "a", "ua", "au"]
    options = [[("D", "", 3)] + ([] if k >= T.BLANK else [("K", i, k == T.TRUNCATED), ("R", "u", 2 + (k == T.TRUNCATED)),
                                                          ("R", "a", 2 + (k == T.TRUNCATED))]) for k, i in zip(kinds, initials)]
    best = None
    for edits in itertools.product(*options):
        for more in itertools.product(gaps, repeat=len(kinds) + 1):
            roles = more[0] + "".join(e[1] + g for e, g in zip(edits, more[1:]))
            if GRAMMAR.fullmatch(roles):
                w = (sum(e[2] for e in edits) + 2 * sum(map(len, more)),
                     "I" * len(more[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, more[1:])))
                best = min(best, w) if best else w
    return best


def brute(conversations, rows):
    out = []
    for c in {r[0] for r in conversations}:
        here, kinds = faults([r for r in rows if r[0] == c])
        initials = [r[2][:1] for r in here]
        cost, audit = cheapest(kinds, initials)
        known = [r[1] for r in here if r[1] is not None]
        lines, at, place = [], 0, 0
        system = sum(e != "D" for e in audit) % 2
        for e in audit:
            if e != "D":
                role = here[at][2] if e == "K" else ("user", "assistant")[(place - system) % 2]
                lines.append(f"{role}:{'' if e == 'I' else here[at][3]}")
                place += 1
            at += e != "I"
        out.append((c, max(known) - min(known) + 1 - len(set(known)) if known else 0,
                    *(kinds.count(k) for k in (T.BLANK, T.DUPLICATE, T.TRUNCATED)),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, harm=True):
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)
    out = T.repaired(df, T.damage(df) if harm else df)
    return sorted([tuple(r) for r in out.collect()], key=repr)


def test_query_equals_brute_force_on_the_table(spark):
    rows = table_rows(MEDIUM, "conv_id, turn, role, text", "conversations")
    assert sorted([tuple(r) for r in op13_turn_repair(spark, MEDIUM).collect()], key=repr) == brute(rows, damaged(rows))


def test_agenda_equals_all_edits_of_few_rows():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(4)
        kinds, initials = [rng.randrange(4) for _ in range(n)], [rng.choice("suaut ") for _ in range(n)]
        assert T.lightest("".join(map(str, kinds)), "".join(initials)) == exhaustive(kinds, initials)


def test_agenda_and_joined_pieces_equal_the_walk_from_the_left():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(14)
        row, initials = "".join(rng.choice("00012223") for _ in range(n)), "".join(rng.choice("suuaat") for _ in range(n))
        want = cheapest([int(k) for k in row], initials)
        assert T.lightest(row, initials) == want
        cuts = sorted(rng.randrange(n + 1) for _ in range(2))
        parts = [T.derivations(row[a:b], initials[a:b]) for a, b in zip([0, *cuts], [*cuts, n])]
        whole = T.joined(T.joined(parts[0], parts[1]), parts[2])
        assert whole == T.joined(parts[0], T.joined(parts[1], parts[2]))
        assert min(w for (right, left), w in whole.items() if right == T.END and left in T.GOALS) == want


def test_edge_rows(spark):
    rows = [(1, 0, "user", "hi."), (1, None, None, None), (1, None, "user", "a?"), (1, 5, "assistant", "cut off"),
            (2, 1, "tool", "x."), (2, 1, "", "y!"), (None, 3, "user", "who."), (None, 3, "user", "who."), (None, 4, "system", "s."),
            (3, None, "system", " \t\n"), (4, 7, "system", "only."), (5, 0, "assistant", "w. " * 40_000), (5, 2**40, "user", "é"),
            (6, 0, "user", "same."), (6, 1, "assistant", "same."), (6, 2, "user", "same."), (6, -3, "System", "S!"),
            *((7, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(60))]
    rows += [(100 + i, 0, "user", "q.") for i in range(40)]  # some lose their only row
    assert found(spark, rows) == brute(rows, damaged(rows))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert found(spark, rows, harm=False) == brute(plain, plain)
    assert found(spark, []) == []


@pytest.mark.parametrize("segment", [1, 3])
def test_long_conversations_span_segments(spark, segment, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", segment)
    monkeypatch.setattr(T, "FAN_IN", 2)
    rng = random.Random(segment)
    rows = [(c, t if rng.random() < 0.8 else None, rng.choice(["user", "assistant", "assistant", "user", "system", "tool"]),
             rng.choice(["a.", "b!", "cut", " ", "c?", f"{t}."])) for c in range(9) for t in range((3, 1, 40)[c % 3])]
    rows += [(50, None, "user", "copy.")] * 25
    assert found(spark, rows, harm=False) == brute(rows, rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "one."), (1, 1, "user", "two."), (1, 2, "user", "")]
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)
    told, turns = T.repair(df)
    assert [(r.n, r.cost, r.audit) for r in told.collect()] == [(3, 7, "IKKDI")]  # RRD costs as much
    assert [tuple(r) for r in turns.orderBy("place").collect()] == [
        (1, 0, "I", "user", ""), (1, 1, "K", "assistant", "one."), (1, 2, "K", "user", "two."), (1, 3, "I", "assistant", "")]
