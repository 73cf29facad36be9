import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stockroom.llm import secret_scan as S
from stockroom.llm.queries import op4_secret_scan
from texts import MEDIUM, docs_frame, table_rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, b, k) for a, _, b, k in sorted(out)]


def base(text):
    raw = (text or "").encode()
    return [s for s in S.in_code_points(raw, S.scan(raw)) if s[2] in S.BASE_KINDS]


def test_query_equals_brute_force_on_the_table(spark):
    rows = table_rows(MEDIUM)
    got = {r.doc_id: r for r in op4_secret_scan(spark, MEDIUM).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = brute(text)
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[2] == k for x in want) for k in S.BASE_KINDS]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got.values()) > 0


def github(body):
    return "ghp_" + body + S.checksum(body.encode()).decode()


@pytest.mark.parametrize("text", [
    "secret: token: abcdefgh", "token=token=abcdefgh", "passwordtoken=abc123", "PassWord = 'Abc.def-=/+'", "api_key:x",
    "apikey\": \"123456\"", "AKIAAKIA" + "A" * 15 + "é", "AKIA" + "B" * 15 + " AKIA" + "B" * 16, "é" * 9 + "0a" * 13,
    "f" * 23 + "g" + "f" * 24, "ſecret=abcdefg toKen=abcdefgh", "password\t= abcdefgh", "token=" + "a" * 100_000,
    "akia" + "A" * 20, "passwd=passwd=passwd:abcdef", "", "token  :  \"abcde secret=\"abcdef"])
def test_base_kinds(text):
    assert base(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "token", "api_key", "API", "key", "secret", "AKIA", "=", ":", " ", "'", '"',
                                 "abcdef", "0123456789ab", "ABCDEFGHIJKLMNOP", "é", "_", "\n", "x"]), max_size=40))
def test_base_kinds_at_random(parts):
    assert base("".join(parts)) == brute("".join(parts))


def test_checksums_decide():
    good = github("abcdefghijklmnopqrstuvwxyz0123")
    raw = f"é {good} x{good} {good[:-1]}! {good}a npm_{good[4:]}".encode()
    spans = S.in_code_points(raw, S.scan(raw))
    assert [(a, b, k) for a, b, k in spans if k not in S.BASE_KINDS] == [
        (2, 42, "github"), (len(raw.decode()) - 40, len(raw.decode()), "npm")]
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert S.scan(bad.encode()) == []


def test_redact_and_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "é token=abcdef!"), (3, "token=" + "ab" * 20 + " x"), (3, "clean é")]
    out = S.redact_secrets(docs_frame(spark, rows))
    assert out.columns == docs_frame(spark, rows).columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect() if r.text is not None) == [
        (0, "é [REDACTED]!"), (2, ""), (3, "[REDACTED] x"), (3, "clean é")]
    assert S.find_secrets(docs_frame(spark, rows)).count() == 5
    assert S.find_secrets(docs_frame(spark, [])).count() == 0
