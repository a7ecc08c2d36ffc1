"""Trigram queries, and spans against a scan of every text with the contract's own patterns."""

import hashlib
import re

import pyarrow as pa
import pytest

from quarry.llm import secrets, trigrams
from quarry.llm.common import documents
from tests.conftest import SF_ORACLE

KEYS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow_base(text):
    t = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def tri(s):
    return ("tri", s.encode())


@pytest.mark.parametrize("pattern,query", [
    ("abc", tri("abc")), ("ab", trigrams.ALL), ("[0-9a-f]{32,}", trigrams.ALL), ("AKIA[A-Z0-9]+", ("and", (tri("aki"), tri("kia")))),
    ("ab+c", trigrams.ALL), ("abc|xyz", ("or", (tri("abc"), tri("xyz")))), ("abc|x", trigrams.ALL), ("(?:abc)?d", trigrams.ALL), ("(abc)+.*def", ("and", (tri("abc"), tri("def")))),
    ("x[ab]y", ("or", (tri("xay"), tri("xby")))), ("a(?=b)bc", tri("abc"))])
def test_queries(pattern, query):
    assert trigrams.query_of(pattern) == query


TEXTS = [None, "", "password = hunter22x", "PassWord:'abc' token=secret=abcdefgh", "ſecret=abcdefgh1 Secret='abcdefgh1'", "é" * 9 + " api_key=ABCDEFGH", "apikey:  12345678",
         "AKIA" + "A" * 12 + " AKIAAKIA12 xAKIA" + "9" * 30, "f" * 31 + " " + "0a" * 16 + "g" + "e" * 40, "to", "ken=abcdefghij", "token" * 50 + "==abcdefgh",
         "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "http://me:word@host/", "Bearer " + "x" * 25, "a" * 200_000 + "secret=0123456789"]


def test_spans_match_a_full_scan():
    got = secrets.Scanner().spans(pa.array(TEXTS))
    every = [(no, k, re.compile(p, re.ASCII), g, n) for no, (k, p, g, n) in enumerate(secrets.RULES)]
    for t, spans in zip(TEXTS, got):
        base = [(s["start"], s["stop"], s["kind"]) for s in spans if s["kind"] in ("assign", "access", "hex")]
        assert base == [(a, e, k) for a, _, e, k in slow_base(t)]
        full = sorted((m.start(), no, m.end(), k) for no, k, f, g, n in every for m in f.finditer(t or "") if len(m[g]) >= n)
        assert [(s["start"], s["stop"], s["kind"]) for s in spans] == [(a, e, k) for a, _, e, k in full]
    assert {s["kind"] for x in got for s in x} >= {"private_key", "github", "url_login", "bearer"}


def test_query_matches_brute_force(spark):
    got = {r.doc_id: r for r in secrets.op8_secrets(spark, SF_ORACLE).collect()}
    rows = documents(spark, SF_ORACLE).select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for r in rows:
        base = slow_base(r.text)
        g = got[r.doc_id]
        some += len(base)
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(b[3] == k for b in base) for k in ("assign", "access", "hex"))
        assert g.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in base).encode()).hexdigest()
        assert {f"{k}:{a}:{e}" for a, _, e, k in base} <= set(g.spans.split(","))
    assert some


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, "secret=abcdefgh", "x"), (1, "secret=abcdefgh", "x"), (None, None, None)], "doc_id long, text string, spans string")
    assert sorted((r.doc_id or -1, len(r.spans)) for r in secrets.find_secrets(df).collect()) == [(-1, 0), (1, 1), (1, 1)]
    assert secrets.find_secrets(df.limit(0)).count() == 0
