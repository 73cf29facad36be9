import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from stockroom.llm import set_join
from stockroom.llm.components import components
from stockroom.llm.set_join import PLAN, Plan, link_components
from texts import MEDIUM, docs_frame, table_rows


def shingle_set(text, k=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, num=75, den=100):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for at, (i, s) in enumerate(sets):
        for e in s:
            holders.setdefault(e, []).append(at)
    seen = set()
    for at, (i, s) in enumerate(sets):
        for other in {o for e in s for o in holders[e] if o < at}:
            j, t = sets[other]
            if i is None or j is None or (i, j) in seen:
                continue
            n = len(s & t)
            if den * n >= num * (len(s) + len(t) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted([(i, len(s), None if i is None else find(i)) for i, s in sets], key=repr)


def ours(df, **kw):
    return sorted([tuple(r) for r in link_components(df, **kw).collect()], key=repr)


def test_equals_brute_force_on_the_table(spark):
    got = ours(spark.read.parquet(f"{MEDIUM}/documents.parquet"))
    assert got == brute(table_rows(MEDIUM))
    assert sum(r[0] != r[2] for r in got) > 10


def near_copies(seed):
    r = random.Random(seed)
    rows = []
    for family in range(14):
        n = r.choice([3, 5, 6, 9, 14, 30, 60, 150])
        base = [r.choice("abcdefghijklmnop") + str(r.randrange(9)) for _ in range(n)]
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + n // 12)):
                at = r.randrange(len(w))
                w[at:at + r.randrange(2)] = [f"z{r.randrange(99)}"] * r.randrange(3)
            rows.append((len(rows) * 3 + 1, " ".join(w).title() if r.random() < 0.3 else " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    rows = near_copies(seed)
    assert ours(docs_frame(spark, rows)) == brute(rows)


def test_sets_without_units_take_the_side_path(spark):
    rows = near_copies(3)
    tight = Plan(75, 100, PLAN.bounds, (1,) * len(PLAN.bounds))
    assert ours(docs_frame(spark, rows), plan=tight) == brute(rows)


def test_shared_passages_and_a_chain(spark):
    """One passage in many unlike texts; a chain whose ends don't link; a family around it."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(r.randrange(5, 30))] + passage)) for i in range(60)]
    chain = [word() for _ in range(80)]
    for i in range(30):
        rows.append((100 + i, " ".join(chain)))
        chain = chain[4:] + [word() for _ in range(4)]
    assert ours(docs_frame(spark, rows)) == brute(rows)


def test_edge_rows(spark):
    p = " ".join(f"w{i}" for i in range(20))
    rows = [(4, p), (2, p.upper()), (9, None), (3, ""), (None, p), (5, " \t"), (6, "a b"), (1, "A\tb"), (7, "a b c"),
            (8, p + " x"), (8, p + " x"), (10, "é " * 9), (11, " x"), (12, "word " * 20000)]
    assert ours(docs_frame(spark, rows)) == brute(rows)
    assert ours(docs_frame(spark, [])) == []


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (4, 5), (9, 9), (7, 8), (8, 10), (10, 12), (12, 7)] + [
        (100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 5, 7, 8, 10, 12)} == {
        1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 10: 7, 12: 7}
    assert all(got[100 + i] == 100 for i in range(41))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_that_repeat_a_doc_id_join_their_classes(spark):
    p, q, z = (" ".join(f"{c}{i}" for i in range(20)) for c in "pqz")
    rows = [(7, p), (3, p), (7, q), (9, q), (9, ""), (5, z), (None, z), (8, z), (3, z + " more")]
    assert ours(docs_frame(spark, rows)) == brute(rows)


def test_allocation_weighs_second_units_by_cost():
    def unit(cost, grp, segment=-1, second=0):
        return {"cost": cost, "grp": grp, "segment": segment, "second": second}

    units = [unit(9, 1), unit(2, 2), unit(5, 3, 16), unit(1, 4, 16, 1), unit(1, 5, 16, 1), unit(1, 6, 32, 1)]
    # Of 10 units, 5 have partners, the seconds of segments 16 and 32 among them; the rest are free.
    assert set_join.allocate(units, 10, 5) == []
    assert set_join.allocate(units, 10, 6) == [6]  # the second of segment 32, whose first is free
    assert set_join.allocate(units, 10, 8) == [6, 2, 3]
    assert sorted(set_join.allocate(units, 10, 9)) == [2, 3, 4, 5, 6]  # the second of 16 before a first that costs 9
    assert sorted(set_join.allocate(units, 10, 10)) == [1, 2, 3, 4, 5, 6]
    # A second unit without partners comes with its first.
    assert set_join.allocate([unit(4, 1, 16), unit(3, 2)], 6, 6) == [2, 1]


def test_second_units_are_paid_under_the_production_plan():
    """A family of edited copies: what its sets pay for holds second units, as its first units are dear."""
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(4):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(w))
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    met = set_join.meet(pa.Table.from_batches(set_join.signatures(iter([batch]), 1, PLAN, 5)), 75, 100)
    paid, free_seconds, units, sets = 0, 0, {}, {}
    for kind, blob in zip(met.column("kind").to_pylist(), met.column("blob").to_pylist()):
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, at, cols = struct.unpack_from("<Q", raw)[0], 8, {}
        for c, t in set_join._COLUMNS[kind]:
            cols[c] = np.frombuffer(raw, t, n, at).tolist()
            at += n * np.dtype(t).itemsize
        for i in range(n):
            row = {c: v[i] for c, v in cols.items()}
            if kind == "unit":
                units.setdefault((row["key1"], row["key2"]), []).append(row)
            if kind == "base":
                sets[row["key1"], row["key2"]] = row
    for key, mine in units.items():
        have, need = sets[key]["firsts"] + sets[key]["seconds"], int(PLAN.differences(np.int64(sets[key]["n_shingles"]))) + 1
        chosen = set(set_join.allocate(mine, have, need))
        paid += sum(u["grp"] in chosen for u in mine if u["second"])
        free_seconds += sets[key]["seconds"] > 0
    assert paid > 0 and free_seconds == len(units)


def test_rows_of_a_chunk_stay_small_over_many_buckets():
    """Of short texts over many buckets, where a set has few rows in each and its key of 12 bytes goes along."""
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(250)) for _ in range(400)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    sent = [(n, len(blob)) for b in set_join.signatures(iter([batch]), 64, PLAN, 5)
            for kind, n, blob in zip(*(b.column(c).to_pylist() for c in ("kind", "n", "blob"))) if kind == "rows"]
    assert sum(size for _, size in sent) < 11 * sum(n for n, _ in sent)
