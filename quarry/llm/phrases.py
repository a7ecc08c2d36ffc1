"""Phrase mining by SETM: occurrence relations, merge-joined by piece and adjacent position.

The relation of length 1 holds every occurrence of a word as (piece, position, code), in that
order. It is stored in slices: one row per slice has the codes of some 8 MB of text one after
the other, and the slice's own groups stand beside it, one row per different group (its code,
its key, how often it occurs). A piece never spans two slices, so the merge-join of a relation
with itself on (piece, position + 1) meets neighbours of one slice only.

Per length: groups are counted over all slices and keys below the least count fall out; the
rest go back to their slices (the semi-join of the relation with the frequent groups), and the
next relation is joined from occurrences that are left. A group of length k is the pair of the
groups of length k - 1 that begin and end it, named by numbers, so keys are exact and short.

A slice has one row per different group, so the most frequent group of all has as many rows as
there are slices, not as there are occurrences: that is what makes its window small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, documents, materialize, prepare, release, store

#: Least occurrences of a phrase, and phrases given per language.
LEAST, BEST = 10, 2000
#: A candidate goes if a longer one that holds it has at least this many per cent of its occurrences.
SWALLOW = 50
NO_LANG = "und"
#: Parts of a language that are ranked by themselves first.
PARTS = 64
#: Text bytes of a slice (a single longer piece is a slice of its own).
SLICE = 8 << 20
#: Bits of a group's code within its slice, and of a slice's number within its task.
CODE_BITS, SEQ_BITS = 31, 12
#: Rows of an Arrow batch that a task gives back.
ROWS = 1 << 16

# Characters between pieces, and between words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_TABLE = bytes(10 if c in PIECE_ENDS else 32 if c in BLANKS else c + 32 if 65 <= c <= 90 else c for c in range(256))

WORDS = pa.schema([("slice", pa.int64()), ("codes", pa.binary()), ("joined", pa.binary()), ("code", pa.int32()),
                   ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
PAIRS = pa.schema([("slice", pa.int64()), ("codes", pa.binary()), ("joined", pa.binary()), ("code", pa.int32()),
                   ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
WORDS_DDL = "slice long, codes binary, joined binary, code int, lang string, word string, n long"
PAIRS_DDL = "slice long, codes binary, joined binary, code int, a long, b long, n long"


def _lots(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[bytes], list[str]]]:
    """Lots of about ``limit`` bytes of text with their languages; a longer text is cut between pieces."""
    texts: list[bytes] = []
    langs: list[str] = []
    size = 0
    for b in batches:
        for text, lang in zip(b.column(0), b.column(1)):
            raw = (text.as_py() or "").encode().translate(_TABLE)
            at = 0
            while at < len(raw):
                stop = len(raw)
                if stop - at > limit:
                    stop = raw.rfind(b"\n", at, at + limit)
                    if stop <= at:  # one piece is longer than a slice
                        stop = raw.find(b"\n", at + limit)
                    stop = len(raw) if stop < 0 else stop
                if texts and size + stop - at > limit:
                    yield texts, langs
                    texts, langs, size = [], [], 0
                texts.append(raw[at:stop])
                langs.append(lang.as_py())
                size += stop - at
                at = stop + 1
    if texts:
        yield texts, langs


def _slice_number(seq: int) -> int:
    part = TaskContext.get().partitionId()
    if seq >> SEQ_BITS or part >> (62 - CODE_BITS - SEQ_BITS):
        raise ValueError(f"slice {seq} of task {part} has no number: read the table in more, or larger, partitions")
    return part << SEQ_BITS | seq


def _relation(schema: pa.Schema, number: int, codes: np.ndarray, joined: np.ndarray | None) -> pa.RecordBatch:
    planes = np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T)  # the high bytes are alike
    row = {"slice": number, "codes": zstandard.ZstdCompressor(level=1).compress(planes), "joined": None if joined is None else np.packbits(joined).tobytes()}
    return pa.RecordBatch.from_pylist([row], schema)


def _codes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def _groups(schema: pa.Schema, number: int, columns: list) -> Iterator[pa.RecordBatch]:
    size = len(columns[0])
    for a in range(0, size, ROWS):
        m = min(ROWS, size - a)
        head = [pa.array(np.full(m, number)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(np.arange(a, a + m, dtype=np.int32))]
        yield pa.RecordBatch.from_arrays(head + [pa.array(c[a:a + m]) if isinstance(c, np.ndarray) else c.slice(a, m) for c in columns], schema=schema)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order and how often each occurs; ``keys`` is sorted in place."""
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.diff(first, append=len(keys))


def _places(keys: np.ndarray) -> np.ndarray:
    """Each key's place among the different keys, in order, with fewer arrays at once than np.unique makes."""
    order = np.argsort(keys)
    keys = keys[order]
    place = np.cumsum(np.r_[False, keys[1:] != keys[:-1]], dtype=np.int32)
    del keys
    out = np.empty(len(order), dtype=np.int32)
    out[order] = place
    return out


def _split(raw: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Where the words of a lot begin, the words, and which are followed by one of the same piece."""
    cps = np.frombuffer(raw, dtype=np.uint8)
    word = (cps != 10) & (cps != 32)
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False)).astype(np.int32)  # begins and ends in turn
    starts = edge[::2]
    bounds = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(edge[1::2] - starts, out=bounds[1:])
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(cps[word])])
    joined = np.ones(len(starts), dtype=bool)
    joined[-1:] = False
    after = np.searchsorted(starts, np.flatnonzero(cps == 10).astype(np.int32))  # the first word behind a piece's end
    joined[after[after > 0] - 1] = False
    return starts, words, joined


def _slice_rows(number: int, texts: list[bytes], langs: list[str]) -> Iterator[pa.RecordBatch]:
    """The relation of a lot and its groups; ``texts`` is emptied."""
    begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    names = {x: k for k, x in enumerate(dict.fromkeys(langs))}
    raw = b"\n".join(texts)
    texts.clear()
    starts, words, joined = _split(raw)
    del raw
    if not len(starts):
        return
    found = words.dictionary_encode()
    del words
    size = len(found.dictionary)
    kind = np.int32 if len(names) * size < 1 << 31 else np.int64
    per_text = np.diff(np.searchsorted(starts, begin.astype(np.int32)), append=len(starts))
    of = np.repeat(np.array([names[x] * size for x in langs], dtype=kind), per_text)
    del starts
    of += found.indices.to_numpy()
    different = found.dictionary
    del found
    yield _relation(WORDS, number, _places(of), joined)
    del joined
    key, n = _counted(of)
    del of
    lang = pa.array(list(names), pa.string()).take(pa.array(key // size))
    yield from _groups(WORDS, number, [lang, different.take(pa.array(key % size)), n.astype(np.int64)])


def _words(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, (texts, langs) in enumerate(_lots(batches, limit)):
            yield from _slice_rows(_slice_number(seq), texts, langs)
            release()  # else the next slice takes its memory beside what this one freed
        release()

    return run


def occurrences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limit: int = SLICE) -> DataFrame:
    """The relation of length 1: slices of word codes, and every slice's (language, word, n)."""
    rows = docs.select(F.col(text_col).alias("t"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("l")).where("t IS NOT NULL")
    return store(rows.mapInArrow(_words(limit), WORDS_DDL))


def frequent(groups: DataFrame, key: list[str], least: int) -> DataFrame:
    """A row for every (slice, code) whose group occurs at least ``least`` times in all slices, with the
    group's number ``id`` (its first (slice, code), so unique) and, on that one's row alone, its key and
    count ``f``."""
    w = Window.partitionBy(*key)
    own = F.shiftleft(F.col("slice"), CODE_BITS) + F.col("code")
    rows = groups.select(own.alias("own"), *key, F.col("n").cast("int").alias("n"))
    rows = rows.select("own", *key, F.sum("n").over(w).alias("f"), F.min("own").over(w).alias("id")).where(F.col("f") >= least)
    first = F.col("own") == F.col("id")
    return rows.select(F.shiftright("own", CODE_BITS).alias("slice"), F.col("own").bitwiseAND((1 << CODE_BITS) - 1).cast("int").alias("code"),
                       *[F.when(first, F.col(k)).alias(k) for k in key], F.when(first, F.col("f")).alias("f"), "id")


def _with_relation(groups: DataFrame, relation: DataFrame) -> DataFrame:
    """Frequent groups and a relation in one table, so that what both are made of is made once."""
    return store(groups.unionByName(relation.select("slice", "codes", "joined"), allowMissingColumns=True))


def _merged(with_groups: bool):
    """The next relation of one slice, or its groups. ``left``: the slice's relation, ``right``: its frequent (code, id)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return PAIRS.empty_table()
        number = left.column("slice")[0].as_py()
        codes = _codes(left.column("codes")[0].as_py())
        bits = left.column("joined")[0].as_py()
        code, ids = right.column("code").to_numpy(), right.column("id").to_numpy()
        size = int(code.max()) + 1
        id_of = np.full(size + 1, -1, dtype=np.int64)  # the last place: no frequent group
        id_of[code] = ids
        at = np.where((codes < 0) | (codes >= size), size, codes)
        there = id_of[at] >= 0
        pair = there[:-1] & there[1:]
        if bits is not None:  # occurrences of one word touch only within a piece; longer ones overlap
            pair &= np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(codes))[:-1].astype(bool)
        if not pair.any():
            return PAIRS.empty_table()
        key = at[:-1][pair].astype(np.int64) * size
        key += at[1:][pair]
        total = len(at)
        del at, there
        if with_groups:
            key, n = _counted(key)
            out = list(_groups(PAIRS, number, [id_of[key // size], id_of[key % size], n.astype(np.int64)]))
        else:
            new = np.full(total, -1, dtype=np.int32)
            new[:-1][pair] = _places(key)
            out = [_relation(PAIRS, number, new, None)]
        if len(codes) > ROWS:
            release()
        return pa.Table.from_batches(out)

    return run


def extend(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, relation) of the next length: occurrences of frequent groups, merge-joined at adjacent
    positions. Groups are many and go straight to their count; both read the same shuffles."""
    left = kept.where("codes IS NOT NULL").select("slice", "codes", "joined").groupBy("slice")
    right = kept.where("code IS NOT NULL").select("slice", "code", "id").groupBy("slice")
    both = left.cogroup(right)
    return both.applyInArrow(_merged(True), PAIRS_DDL), both.applyInArrow(_merged(False), PAIRS_DDL)


def _score(left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly: counts to 10 ** 14 fit the decimals."""
    d = lambda c: f"CAST({c} AS DECIMAL(14,0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({d('a')} * {d('a')})) div ({d(left)} * {d(right)})")


def phrases(docs: DataFrame, least: int = LEAST, best: int | None = BEST, swallow: int = SWALLOW, limit: int = SLICE,
            text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two and three words of every language.

    A null text has no words, a null language counts as ``und``. Repeated rows count as often as
    they stand. Equal scores go by ``a``, then by the phrase in UTF-8 order; equal cuts by the
    shorter first part. An empty table gives no rows. Other columns are not read."""
    found = occurrences(docs, text_col, lang_col, limit)
    n = materialize(found.where("code IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")))
    one = _with_relation(frequent(found.where("code IS NOT NULL"), ["lang", "word"], least), found.where("codes IS NOT NULL"))
    discard(found)
    w = materialize(one.where("f IS NOT NULL").select("id", "lang", "word", "f"))
    groups, relation = extend(one)
    two = _with_relation(frequent(groups, ["a", "b"], least), relation)
    discard(one)
    pairs = materialize(two.where("f IS NOT NULL").select("id", "a", "b", "f"))
    three, _ = extend(two)
    long = three.groupBy(F.col("a").alias("p1"), F.col("b").alias("p2")).agg(F.sum("n").alias("a"))
    long = store(long.where(F.col("a") >= least))
    discard(two)

    w1 = w.select(F.col("id").alias("a"), "lang", F.col("word").alias("w1"), F.col("f").alias("f1"))
    w2 = w.select(F.col("id").alias("b"), F.col("word").alias("w2"), F.col("f").alias("f2"))
    short = materialize(pairs.join(w1, "a").join(w2, "b"))

    # a pair goes if it begins or ends a longer candidate with enough of its occurrences
    most = (long.select(F.col("p1").alias("m_id"), "a").unionByName(long.select(F.col("p2").alias("m_id"), "a"))
            .groupBy("m_id").agg(F.max("a").alias("longer")))
    two_words = (short.join(most, F.col("id") == F.col("m_id"), "left").where(~F.coalesce(100 * F.col("longer") >= swallow * F.col("f"), F.lit(False)))
                 .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r")))
    p1 = short.select(F.col("id").alias("p1"), "lang", F.col("w1").alias("x1"), F.col("w2").alias("x2"), F.col("f1").alias("g1"), F.col("f").alias("g12"))
    p2 = short.select(F.col("id").alias("p2"), F.col("w2").alias("x3"), F.col("f2").alias("g3"), F.col("f").alias("g23"))
    cut = lambda k, left, right: F.struct(_score(left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    three_words = (long.join(p1, "p1").join(p2, "p2").withColumn("c", F.array_min(F.array(cut(1, "g1", "g23"), cut(2, "g12", "g3"))))
                   .select("lang", F.concat_ws(" ", "x1", "x2", "x3").alias("phrase"), "a", "c.l", "c.r", "c.score"))
    every = two_words.withColumn("score", _score("l", "r")).unionByName(three_words)
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    if best is not None:  # the best of every part of a language first, so its last ranking is short
        every = every.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        every = every.withColumn("rank", rank("lang", "part")).where(F.col("rank") <= best).drop("part", "rank")
    out = every.withColumn("rank", rank("lang").cast("long"))
    if best is not None:
        out = out.where(F.col("rank") <= best)
    n = n.withColumnRenamed("lang", "n_lang")
    return out.join(n, F.col("lang") == F.col("n_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return phrases(documents(spark, sf_dir))


SQL_TEXT = f"""
WITH t AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '{NO_LANG}') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^ \\t]+') AS w FROM t),
q AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f, min(w[i:i + m - 1]) AS ws
  FROM q, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, ws, f AS a FROM f WHERE m > 1 AND f >= {LEAST}),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT k.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1:k.k], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
gone AS (
  SELECT DISTINCT b.lang, b.phrase FROM b JOIN c ON c.lang = b.lang AND c.m > b.m AND 100 * c.a >= {SWALLOW} * b.a
  AND (c.ws[1:2] = b.ws OR c.ws[2:3] = b.ws)),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b ANTI JOIN gone ON gone.lang = b.lang AND gone.phrase = b.phrase)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= {BEST}"""

QUERIES = {"op11_phrases": op11_phrases}
SQL = {"op11_phrases": SQL_TEXT}
