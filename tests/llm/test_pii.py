"""Base spans against the contract's own patterns; disguises, offsets and edge rows."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import pii
from quarry.llm.common import documents
from tests.conftest import SF_ORACLE

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def good_card(s):
    d = [int(c) for c in s if c.isdigit()]
    for i in range(len(d) - 2, -1, -2):
        d[i] = d[i] * 2 if d[i] < 5 else d[i] * 2 - 9
    return 13 <= len(d) <= 19 and sum(d) % 10 == 0


def slow_base(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if good_card(m[0])]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def base(t):
    return [(k, a, b) for k, a, b, own in pii.spans(t) if own]


def added(t):
    return [(k, t[a:b]) for k, a, b, own in pii.spans(t) if not own]


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text("a@b.c-0129 +()%_5éа", max_size=60), st.text("0123456789 -.+", max_size=60), st.text(max_size=40)))
def test_base_spans_match_the_patterns(t):
    assert base(t) == slow_base(t)
    for _, a, b, _ in pii.spans(t):
        assert 0 <= a < b <= len(t)


@pytest.mark.parametrize("text,kind,part", [
    ("write to john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("john(at)example.com!", "email", "john(at)example.com"),
    ("ask john dot smith at mail dot example dot org, please", "email", "john dot smith at mail dot example dot org"),
    ("jane @ example.net", "email", "jane @ example.net"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("a​b@exam­ple.com", "email", "a​b@exam­ple.com"),
    ("x＠example．com", "email", "x＠example．com"),
    ("\U0001d41a\U0001d41b@example.com", "email", "\U0001d41a\U0001d41b@example.com"),
    ("at 192[.]168[.]1[.]10 now", "ip", "192[.]168[.]1[.]10"),
    ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("١٠.0.0.٧", "ip", "١٠.0.0.٧"),
    ("card ４１１１ 1111 1111 1111.", "card", "４１１１ 1111 1111 1111"),
    ("4111 1111 1l11 1111", "card", "4111 1111 1l11 1111"),
    ("four one one one " + "eins " * 4 + "un un un un uno uno uno uno", "card", "four one one one " + "eins " * 4 + "un un un un uno uno uno uno"),
    ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
    ("+1 (171) 555‑2028 x", "phone", "+1 (171) 555‑2028"),
])
def test_disguises(text, kind, part):
    for around in ("{}", "é \U0001f600 {} 中", "one, {}\nmail a@b.cd"):
        t = around.format(text)
        assert (kind, part) in added(t)
        assert base(t) == slow_base(t)


@pytest.mark.parametrize("text", [
    "meet me at home dot matrix", "thanks @john.doe and look at example.com", "at the point of view at point com", "eins zwei drei vier",
    "mail john@example.com dot is", "Привет мир", "un deux trois quatre cinq", "look at the dot", "4111 1111 1l11 1112",
    "one of the six at five dot", "a.b@c.de 10.0.0.1 4111111111111111", "0x1l2 O0O", "version 1 dot 2", "", " ", "​​", "中文。中文，１２"])
def test_clean_texts_stay_clean(text):
    assert added(text) == [] and base(text) == slow_base(text)


def test_offsets_pass_through_all_transducers():
    t = "​4​111 l111 1111 one one one one; jоhn [at] mail [dot] example (dot) com"
    assert added(t) == [("email", "jоhn [at] mail [dot] example (dot) com"), ("card", "4​111 l111 1111 one one one one")]
    r = pii.Rewriting("abcdef", [(0, 1, ""), (2, 4, "X"), (5, 6, "YZ")])
    assert r.text == "bXeYZ"
    assert r.back(0, 1) == (1, 2, False) and r.back(1, 2) == (2, 4, True) and r.back(0, 5) == (1, 6, True) and r.back(2, 3) == (4, 5, False)


def test_the_hint_loses_nothing(spark):
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = [t for t, _, _ in test_disguises.pytestmark[0].args[1]] + [r.text or "" for r in documents(spark, SF_ORACLE).select("text").collect()]
    hints = pc.match_substring_regex(pa.array(rows), pii.HINT, ignore_case=True).to_pylist()
    assert [pii.spans(t, h) for t, h in zip(rows, hints)] == [pii.spans(t) for t in rows]
    assert not all(hints)


def test_very_long_texts_take_linear_time():
    t0 = time.time()
    for t in ("a" * 10 ** 6, "1" * 10 ** 6, "1." * 500_000, "a@" * 300_000, "+1" * 300_000, "1 " * 500_000, "one " * 250_000, " at a" * 200_000,
              "аb" * 300_000, "a dot " * 150_000, "a [at] " * 100_000, "(" * 10 ** 6, "1l" * 300_000):
        assert all(own for *_, own in pii.spans(t)) or t[0] in "o1аa"
    assert time.time() - t0 < 60


def test_query_matches_brute_force(spark):
    got = {r.doc_id: r for r in pii.op12_pii(spark, SF_ORACLE).collect()}
    rows = documents(spark, SF_ORACLE).select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for r in rows:
        want = slow_base(r.text or "")
        some += len(want)
        g = got[r.doc_id]
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(w[0] == k for w in want) for k in pii.KINDS)
        written = [f"{k}:{a}:{b}" for k, a, b in want]
        assert g.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(g.spans.split(",")) | {""}
    assert some


def test_edge_rows_and_masking(spark):
    t = "a@b.cd and x (at) example.com"
    df = spark.createDataFrame([(1, t, "x"), (1, t, "x"), (None, None, None), (2, "", "y")], "doc_id long, text string, spans string")
    found = pii.find_personal_data(df)
    assert sorted((r.doc_id or -1, len(r.spans)) for r in found.collect()) == [(-1, 0), (1, 2), (1, 2), (2, 0)]
    assert pii.find_personal_data(df.limit(0)).count() == 0
    out = df.select("doc_id", pii.masked(df.text, pii.personal_data(df.text)).alias("m")).collect()
    assert sorted((r.doc_id or -1, r.m) for r in out if r.m is not None) == [(1, "[email] and [email]"), (1, "[email] and [email]"), (2, "")]
    assert sum(r.m is None for r in out) == 1
