"""Batches against counting everything anew."""

from collections import Counter

import pytest

from quarry.llm import rollup

COLS = "op string, doc_id long, source string, lang string, text string, seq int, n_tokens long"


def changes(spark, rows):
    return spark.createDataFrame([(*r, 99) for r in rows], COLS)


def words(spark, path):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals(spark, path).where("version = 'space-1'").collect()}


BATCHES = [
    [("insert", 1, "a", "en", "x y z", 1), ("insert", 2, "a", "en", "x", 1), ("insert", 3, None, None, None, 1), ("insert", 1, "a", "en", "x y z", 1),
     ("insert", None, "a", "en", "lost", 1), ("guess", 9, "a", "en", "lost", 1), ("insert", 4, "b", "de", "", 1)],
    [("delete", 2, None, None, None, 1), ("revise", 1, "b", "de", "one two", 1), ("revise", 1, "b", "de", "one two three four", 2), ("delete", 77, None, None, None, 1)],
    [("insert", 2, "a", "en", "back again", 1), ("revise", 3, "c", "fr", "q r", 1), ("delete", 4, None, None, None, 5), ("insert", 4, "a", "en", "no", 4)],
]


def recounted(upto):
    docs = {}
    for batch in BATCHES[:upto]:
        for op, d, s, l, t, _ in sorted((b for b in batch if b[1] is not None and b[0] != "guess"), key=lambda b: b[5]):
            docs.pop(d, None)
            if op != "delete":
                docs[d] = (s, l, len((t or "").split()))
    n = Counter((s, l) for s, l, _ in docs.values())
    return {k: (c, sum(w for s, l, w in docs.values() if (s, l) == k)) for k, c in n.items()}


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    p = f"file://{tmp_path_factory.mktemp('rollup')}/r"
    rollup.create(spark, p)
    assert rollup.totals(spark, p).count() == 0
    return p


def test_batches_and_replays(spark, path):
    for k, rows in enumerate(BATCHES, 1):
        rollup.commit(spark, path, k, changes(spark, rows))
        assert words(spark, path) == recounted(k)
        rollup.commit(spark, path, k, changes(spark, rows))  # the same batch again
        assert words(spark, path) == recounted(k)
    rollup.commit(spark, path, 2, changes(spark, BATCHES[1]))  # an old one again
    assert words(spark, path) == recounted(3)
    rollup.commit(spark, path, 4, changes(spark, BATCHES[0]).limit(0))
    assert words(spark, path) == recounted(3)
    with pytest.raises(ValueError):
        rollup.commit(spark, path, 0, changes(spark, BATCHES[0]))
