"""Text function goldens and tag codec properties."""

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import tags as TG
from quarry.functions.text import (details_text, html_to_text, html_text_py, normalize_date, printable_ascii,
                                   strip_control)


def _one(spark, col_fn, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col_fn(F.col("v")).alias("o")).first().o


def test_html_goldens(spark):
    cases = {
        "<h1>AI Author Assist Test</h1>": "AI Author Assist Test",
        "this is some <b>text</b>": "this is some text",
        "This is a<br /> question!": "This is a question!",
        "<h1>This is a fantactic title!</h1> <p>Test</p>": "This is a fantactic title! Test",
        '<script>var t="</p>";</script><p>a &amp; b</p><!-- c -->': "a & b",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", html_to_text(F.col("v")).alias("o"))
    assert {r.v: r.o for r in df.collect()} == cases


def test_control_and_printable(spark):
    src = ".\x80 \x80\x9c\x00http://www.google.com \xe2\x80\x9d."
    assert _one(spark, strip_control, src) == ". http://www.google.com \xe2."
    assert _one(spark, strip_control, "ó") == "ó"
    assert _one(spark, printable_ascii, "ó a\tb") == " a\tb"


def test_date_goldens(spark):
    cases = {
        "2023-04-14T19:04:11.000000Z": "2023-04-14T19:04:11+00:00",
        "2023-09-11T08:59:52Z": "2023-09-11T08:59:52+00:00",
        "0001-01-01T00:00:00Z": "0001-01-01T00:00:00+00:00",
        "2023-09-11T08:61:52": None,
        "2023-09-11T10:00:00+02:00": "2023-09-11T08:00:00+00:00",
        "not a date": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", normalize_date(F.col("v")).alias("o"))
    assert {r.v: r.o for r in df.collect()} == cases


def test_details_concat(spark):
    rows = [([("a", "A", "Some  Title"), ("b", "B", "<b>Some Content</b>Here it is"), ("c", "C", "")],)]
    df = spark.createDataFrame(rows, "d array<struct<name:string,label:string,value:string>>")
    out = df.select(printable_ascii(html_to_text(details_text(F.col("d")))).alias("o")).first().o
    assert out == "Some  Title\nSome ContentHere it is"


def test_tag_decode_rejects_malformed(spark):
    df = spark.createDataFrame([(['"a"."b"', "broken"],)], "t array<string>")
    out = df.select(TG.decode_tags("t").alias("o")).first().o
    assert (out[0].key, out[0].value) == ("a", "b") and out[1].key is None


names = st.text(alphabet=st.characters(blacklist_characters='"', blacklist_categories=("Cs", "Cc", "Zl", "Zp")), min_size=1, max_size=8)


@settings(max_examples=20, deadline=None, phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(st.dictionaries(names, st.lists(names, min_size=1, max_size=3), min_size=1, max_size=4))
def test_tag_roundtrip(spark, tags):
    df = spark.createDataFrame([(tags,)], "m map<string,array<string>>")
    enc = df.select(TG.encode_tags("m").alias("e")).first().e
    # map entry order is not insertion order, so compare as multisets
    assert sorted(enc) == sorted(TG.encode_py(tags))
    assert {k: sorted(v) for k, v in TG.decode_py(enc).items()} == {k: sorted(v) for k, v in tags.items()}
    dec = spark.createDataFrame([(enc,)], "t array<string>").select(TG.decode_tags("t").alias("o")).first().o
    assert sorted((x.key, x.value) for x in dec) == sorted((k, v) for k, vs in tags.items() for v in vs)


def test_html_python_helper_entities():
    assert html_text_py("&copy; x &middot; y&amp;&amp;") == "© x · y&&"


def test_html_batches_go_back_in_slices():
    import pyarrow as pa

    from quarry.functions.text import _html_to_text_batches
    texts = [f"<p>{k} &amp; {'x' * 400_000}</p>" if k % 3 else None for k in range(20)]
    out = list(_html_to_text_batches(iter([pa.array(texts, pa.string())])))
    assert len(out) > 1 and max(len(a) for a in out) < len(texts)
    assert [t for a in out for t in a.to_pylist()] == [html_text_py(t) for t in texts]
