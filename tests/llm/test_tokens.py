"""rANS round trips and token files against plain encoding."""

import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import rans, tokens
from quarry.llm.common import documents
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("n", [0, 1, 5, 700, 5000, 300_000])
def test_round_trip_and_checkpoints(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.geometric(0.002, n), 40_000)
    coder = rans.Coder(rans.normalise(np.bincount(ids, minlength=10)))
    block = coder.encode(ids, every=4)
    assert (coder.decode(block) == ids).all()
    for k, mark in enumerate(block["marks"], 1):
        if k % 7 == 1:
            assert (coder.decode(block, k) == ids[mark["step"] * block["lanes"]:]).all()
    if n == 300_000:
        p = np.bincount(ids) / n
        entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * n / 8
        assert len(block["words"]) < 1.02 * entropy + 8 * block["lanes"]


def test_frequencies():
    f = rans.normalise(np.r_[np.ones(200_000, dtype=np.int64), 10 ** 9, 0])
    assert f.sum() == 1 << rans.SCALE and (f[:-1] > 0).all() and f[-1] == 0
    with pytest.raises(ValueError):
        rans.normalise(np.ones(20, dtype=np.int64), scale=4)


def same(enc, texts):
    ids, n = enc.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in enc.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want]
    ends = np.cumsum(n)
    for t, w, a, b in zip(texts, want, ends - n, ends):
        assert ids[a:b].tolist() == w, repr(t)


def test_words_are_encoded_as_whole_texts_are():
    enc = tokens.Encoder(tokens.tokenizer_path())
    assert enc.by_word and enc.plain("Straße,.") and enc.plain("naïve") and not enc.plain("İ") and not enc.plain("য়")
    same(enc, ["The CAT's 12th, café. Naïve x\x1cy <|endoftext|> é́ ́a don't,.. I.B.M., İstanbul ΣΣ BİLGİ. DENİZİ, ve", None, "", " \n\t ",
               "word,word. Word.. ,. ... 中文 \U0001f600!", "a" * 5000, "<|ENDOFTEXT|> a<|startoftext|>b,", "সময়. পাহাড়, ਸ਼. क़, ଡ଼.", "\u00a0x\u2003y.\u0085z \u212a, \u212b."])


def test_every_letter_beside_marks_and_signs():
    enc = tokens.Encoder(tokens.tokenizer_path())
    letters = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c))[0] in "LM"]
    texts = [f"ab{c}. {c}, x{c}y.,{c} {c}1 {c}'s A{c.upper()}. {c}\u0301, .{c}" for c in letters]
    for a in range(0, len(texts), 4000):
        same(enc, texts[a:a + 4000])


def test_random_texts_match():
    enc = tokens.Encoder(tokens.tokenizer_path())
    rnd = random.Random(3)
    signs = list("aAbBzZéÉßñçÇøØǅǆŉİıſKÅ.,.,.,'s  \n\t-!?019<|>়̧́가ΣσςΆ中文য়ড়") + ["\u00a0", "\u2028", "\x1c", "<|endoftext|>", "the", "ing", "\U0001f600", "ﬁ"]
    same(enc, ["".join(rnd.choices(signs, k=rnd.randint(0, 24))) for _ in range(50_000)])


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 300)
    same(tokens.Encoder(tokens.tokenizer_path()), ["one two. Two, three three THREE. é è ü"] * 3)


def test_case_and_signs_behind_do_not_make_another_word(monkeypatch):
    enc = tokens.Encoder(tokens.tokenizer_path())
    texts = ["house House. HOUSE, HoUsE.,. hOUSE... naïve Naïve, x1. X1, house"]
    same(enc, texts)
    asked = []
    plain = enc.plain
    monkeypatch.setattr(enc, "plain", lambda w: asked.append(w) or plain(w))
    same(enc, ["HOUSE,, hOuSe.. House, Naïve.. naïve", "other Other"])
    assert asked == ["other"]  # what is remembered is not matched again


def test_words_that_are_not_plain_are_not_taken_apart():
    enc = tokens.Encoder(tokens.tokenizer_path())
    same(enc, ["x1 x1. X1, x1.,"])
    assert "x1" not in enc.stems and {"x1", "x1.", "X1,", "x1.,"} <= enc.words.keys()
    same(enc, ["x1.. X1 ... , BİLGİ BİLGİ. bİlgİ, ÉCOLE. École, école"])
    enc.plain = None  # every word as it stands
    same(enc, ["x1.. X1 ... , The the. THE,", None, "", "a"])


def test_query_matches_plain_encoding(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    rows = documents(spark, SF_SMALL).select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in tokens.op3_rans_tokens(spark, SF_SMALL).collect()}
    start = 0
    for r in rows:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert tuple(got[r.doc_id]) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


def test_edge_rows_blocks_and_damage(spark, tmp_path):
    rows = [(5, "b c", 1), (None, "z", 2), (5, "b c", 3), (1, None, 4), (2, "", 5), (3, "x " * 4000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    path = f"file://{tmp_path}/t"
    tokens.write_tokens(df, path, block_ids=3)
    got = sorted(tokens.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1, 2, 3, 5, 5, None]
    assert [r.n_tokens for r in got] == [1, 1, 4001, 3, 3, 2]
    assert [r.start for r in got] == [0, 1, 2, 4003, 4006, 4009]
    assert all(r.ids[-1] == 1 for r in got)
    tokens.write_tokens(df.limit(0), f"{path}0")
    assert tokens.read_tokens(spark, f"{path}0").count() == 0
    block = rans.Coder(rans.normalise(np.array([3, 4, 5]))).encode(np.array([0, 1, 2, 2, 1]))
    block_ = block | {"states": bytes([block["states"][0] ^ 1]) + block["states"][1:]}
    assert rans.checksum(block) != rans.checksum(block_)
