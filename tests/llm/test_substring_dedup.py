import random

import pytest

from stockroom.llm.substring_dedup import drop_repeated_passages
from texts import MEDIUM, docs_frame, table_rows


def brute(rows, k=13):
    first, out = {}, []
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[j:j + k])
                first[key] = min(first.get(key, i), i)
    for i, w in words:
        hit = set()
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j:j + k])] < i:
                hit.update(range(j, j + k))
        kept = b" ".join(x for j, x in enumerate(w) if j not in hit)
        out.append((i, len(w), len(hit), kept.decode()))
    return sorted(out, key=repr)


def ours(df, **kw):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text)
                   for r in drop_repeated_passages(df, **kw).collect()], key=repr)


def test_equals_brute_force_on_the_table(spark):
    rows = table_rows(MEDIUM)
    got = ours(spark.read.parquet(f"{MEDIUM}/documents.parquet"))
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


def test_edge_rows(spark):
    p = " ".join(f"w{i}" for i in range(20))
    rows = [(1, p), (2, "x " + p + " y"), (2, p), (3, None), (4, ""), (None, p), (5, p), (5, p), (6, "\t\n "),
            (7, "é ü " + p.replace(" ", "\n")), (8, " ".join(["a"] * 100)), (9, " ".join(["a"] * 5000))]
    assert ours(docs_frame(spark, rows)) == brute(rows)
    assert ours(docs_frame(spark, [])) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_few_words_many_repeats(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(40), " ".join(r.choice("abc") for _ in range(r.randrange(60)))) for _ in range(80)]
    assert ours(docs_frame(spark, rows), k=6, m=3) == brute(rows, 6)


def test_hash_is_only_a_sieve(monkeypatch):
    import numpy as np

    from stockroom.llm import substring_dedup as s
    from stockroom.llm.common import word_hashes, words_of

    monkeypatch.setattr(s, "run_hashes", lambda h, k, seed: np.zeros(len(h) - k + 1, dtype=np.uint64))
    w = words_of([b"a b c d", b"b c x", b"a b c"])
    _, later = s.repeated_windows(w, word_hashes(w), np.array([3, 2, 1]), 2)
    # a b | b c | c d of id 3, b c | c x of 2, a b | b c of 1
    assert later.tolist() == [True, True, False, False, True, False, False, False, False, False]


def test_a_frequent_run_of_words_fills_no_bucket(spark, monkeypatch):
    from stockroom.llm import substring_dedup as s
    from stockroom.llm.common import run_hashes, word_hashes, words_of

    # a phrase that is the minimiser of nearly every window that holds it, each time among other words
    phrase = next(p for p in (f"hot{i} run of words" for i in range(10000))
                  if run_hashes(word_hashes(words_of([p.encode()])), 4, 23)[0] < 2**64 // 200)
    r = random.Random(3)
    some = lambda n: [f"w{r.randrange(10**4)}" for _ in range(n)]
    rows = [(i, " ".join(some(12) + phrase.split() + some(12))) for i in range(600)]
    rows += [(1000 + i, "x " + rows[i * 7][1] + " y") for i in range(50)]
    judge, most = s.judge_bucket, 16384

    def bounded(table, k):
        held = sum(len(s._unpack(b)[4]) for b, d in zip(table["blob"].to_pylist(), table["decided"].to_pylist()) if not d)
        if held > 2 * most:
            raise ValueError(f"bucket of {held} bytes")
        return judge(table, k)

    monkeypatch.setattr(s, "BUCKET_BYTES", most)
    monkeypatch.setattr(s, "judge_bucket", bounded)
    assert ours(docs_frame(spark, rows)) == brute(rows)
