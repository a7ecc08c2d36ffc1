"""Divergence of sources within a language, from stripes that mappers fold in memory.

A mapper folds whole documents into a hash of stripes: (language, term) to its document
frequency and its count in every source. When the hash is full it is spilt: its stripes are
emitted and it starts anew. Stripes are dealt and sorted by key, and equal keys are merged one
after the other, so one stripe is held at a time. Merged stripes of terms that enough documents
have are stored; from each batch of them the shares of all sources follow at once, and with
them the differences that are summed (pairs of sources) or ranked (terms of a source).

The (language, source) groups come to the driver and are broadcast: the result has a row for
every two sources of a language, so there are at most as many groups as its square root per
language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, materialize, prepare, text_slices

#: Documents of its language that a term needs, terms given per source.
LEAST_DOCS, BEST = 30, 50
#: Shares are in parts of this, with this much added to every count.
PARTS, EXTRA = 1_000_000_000, 5
#: Text bytes folded at once; terms and counts a mapper holds before it spills.
SLICE, HOLD_TERMS, HOLD_CELLS = 8 << 20, 1 << 19, 1 << 21
#: Cells of the (term, source) and (source, source) tables that are made at once.
CELLS = 1 << 21

# A term is a run of these bytes of UTF-8, A-Z in lower case.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

STRIPES_DDL = "lang int, term string, df long, sources array<int>, counts array<long>"
STRIPES = pa.schema([("lang", pa.int32()), ("term", pa.string()), ("df", pa.int64()), ("sources", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


class Groups:
    """The (language, source) groups by number, in order of both; a source's number is that of its group."""

    def __init__(self, names: list[tuple[str, str]]):
        self.names = sorted(names, key=lambda g: (g[0].encode(), g[1].encode()))
        self.langs = list(dict.fromkeys(x for x, _ in self.names))
        self.number = {g: k for k, g in enumerate(self.names)}
        at = {x: k for k, x in enumerate(self.langs)}
        self.lang_of = np.array([at[x] for x, _ in self.names], dtype=np.int64)

    def of(self, lang: int) -> np.ndarray:
        return np.flatnonzero(self.lang_of == lang)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sums of their ``n``, in integers."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(n, first)


class Stripes:
    """The hash of a mapper: terms by number, document frequencies and counts by (term, language or group)."""

    def __init__(self, groups: Groups):
        self.g, self.n_groups, self.n_langs = groups, max(1, len(groups.names)), max(1, len(groups.langs))
        self.clear()

    def clear(self) -> None:
        self.terms: dict[str, int] = {}
        none = np.zeros(0, dtype=np.int64)
        self.df, self.cells = (none, none), (none, none)

    def add(self, texts: pa.Array, group: np.ndarray) -> None:
        """Whole documents, one group number each."""
        raw = [(t or "").encode() for t in texts.to_pylist()]
        data = b" ".join(raw).translate(_TABLE)
        chars = np.frombuffer(data, dtype=np.uint8)
        word = chars != 32
        starts = np.flatnonzero(word & np.r_[True, ~word[:-1]]) if len(word) else np.zeros(0, dtype=np.int64)
        if not len(starts):
            return
        found = pc.ascii_split_whitespace(pa.array([data], pa.binary()).cast(pa.string())).flatten()
        found = found.filter(pc.not_equal(found, "")).dictionary_encode()
        begin = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])
        doc = np.searchsorted(begin, starts, "right") - 1
        number = self.terms
        to = np.array([number.setdefault(t, len(number)) for t in found.dictionary.to_pylist()], dtype=np.int64)
        size = len(to)
        key, n = np.unique(doc * size + found.indices.to_numpy(), return_counts=True)  # (document, term)
        g, term = group[key // size], to[key % size]
        df = term * self.n_langs + self.g.lang_of[g]
        for name, k, m in (("df", df, np.ones(len(df), dtype=np.int64)), ("cells", term * self.n_groups + g, n.astype(np.int64))):
            old = getattr(self, name)
            setattr(self, name, _summed(np.r_[old[0], k], np.r_[old[1], m]))

    def full(self) -> bool:
        return len(self.terms) >= HOLD_TERMS or len(self.cells[0]) >= HOLD_CELLS

    def spill(self) -> Iterator[pa.RecordBatch]:
        """All stripes, and the hash is empty."""
        if len(self.df[0]):
            term, lang = self.df[0] // self.n_langs, self.df[0] % self.n_langs
            c_term, g = self.cells[0] // self.n_groups, self.cells[0] % self.n_groups
            # groups are in order of their languages, so cells stand in the order of the stripes
            c_key = c_term * self.n_langs + self.g.lang_of[g]
            ends = np.r_[0, np.searchsorted(c_key, self.df[0], "right")].astype(np.int32)
            names = pa.array(list(self.terms), pa.string()).take(pa.array(term))
            yield from _stripe_batches(lang, names, self.df[1], ends, g, self.cells[1])
        self.clear()


def _stripe_batches(lang, term, df, ends, sources, counts, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(df), rows):
        e = min(a + rows, len(df))
        offsets = pa.array((ends[a:e + 1] - ends[a]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[ends[a]:ends[e]].astype(t))) for x, t in ((sources, np.int32), (counts, np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(lang[a:e].astype(np.int32)), term.slice(a, e - a), pa.array(df[a:e]), *lists], schema=STRIPES)


def _fold(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: Groups = held.value
        stripes = Stripes(groups)
        for b in batches:
            for a, e in text_slices(b.column(0), SLICE):
                group = [groups.number[g] for g in zip(b.column(1)[a:e].to_pylist(), b.column(2)[a:e].to_pylist())]
                stripes.add(b.column(0)[a:e], np.array(group, dtype=np.int64))
                if stripes.full():
                    yield from stripes.spill()
        yield from stripes.spill()

    return run


def _merge(least: int):
    """Sorted stripes to one per key, of terms that ``least`` documents have; the last key is carried on."""
    def merged(b: pa.RecordBatch):
        lang, term = b.column(0).to_numpy(), b.column(1)
        new = np.r_[True, lang[1:] != lang[:-1]]
        new[1:] |= pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        lens = pc.list_value_length(b.column(3)).to_numpy().astype(np.int64)
        g = b.column(3).flatten().to_numpy().astype(np.int64)
        size = int(g.max()) + 1 if len(g) else 1
        key, n = _summed(np.repeat(run, lens) * size + g, b.column(4).flatten().to_numpy())
        ends = np.r_[0, np.searchsorted(key // size, np.arange(len(first)), "right")]
        df = np.add.reduceat(b.column(2).to_numpy(), first)
        return lang[first], term.take(pa.array(first)), df, ends, key % size, n

    def kept(x, stop):
        lang, term, df, ends, g, n = x
        yes = np.flatnonzero(df[:stop] >= least)
        if not len(yes):
            return
        lens = np.diff(ends)[yes]
        at = np.repeat(ends[yes] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
        yield from _stripe_batches(lang[yes], term.take(pa.array(yes)), df[yes], np.r_[0, np.cumsum(lens)], g[at], n[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for b in batches:
            if not b.num_rows:
                continue
            b = pa.RecordBatch.from_arrays(b.columns, schema=STRIPES)
            x = merged(pa.concat_batches([carried, b]) if carried is not None else b)
            last = len(x[2]) - 1
            yield from kept(x, last)
            a = x[3][last]
            carried = next(_stripe_batches(x[0][last:], x[1].slice(last), x[2][last:], x[3][last:] - a, x[4][a:], x[5][a:]))
        if carried is not None:
            x = merged(carried)
            yield from kept(x, 1)

    return run


def shares(counts: np.ndarray, total, terms: int) -> np.ndarray:
    """1 + floor(PARTS * (count + EXTRA) / (total + EXTRA * terms)) by long division, so nothing passes 64 bits."""
    whole = np.asarray(total, dtype=np.int64) + EXTRA * terms
    rest = counts + EXTRA
    out = rest // whole
    rest = rest % whole
    for _ in range(3):  # three digits at a time
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


OUT_DDL = "part string, g int, h int, term string, value long"
OUT = pa.schema([("part", pa.string()), ("g", pa.int32()), ("h", pa.int32()), ("term", pa.string()), ("value", pa.int64())])


def _pair_rows(g: np.ndarray, sums: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    m = sums.size
    return pa.RecordBatch.from_arrays([pa.array(["pair"] * m), pa.array(np.repeat(g, len(h)).astype(np.int32)), pa.array(np.tile(h, len(g)).astype(np.int32)),
                                       pa.nulls(m, pa.string()), pa.array(sums.reshape(-1))], schema=OUT)


def _emit(held, best: int):
    """Sums of differences by pair, and terms that may be among a source's best, from merged stripes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, totals, n_terms = held.value
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            lang = b.column(0).to_numpy()
            lens = pc.list_value_length(b.column(3)).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), lens)
            g_all, n_all = b.column(3).flatten().to_numpy(), b.column(4).flatten().to_numpy()
            for x in np.unique(lang).tolist():
                own, v = groups.of(x), n_terms[x]
                total = totals[own]
                size = len(own)
                rows = np.flatnonzero(lang == x)
                step = max(1, CELLS // size)
                for a in range(0, len(rows), step):
                    lot = rows[a:a + step]
                    mine = np.flatnonzero(np.isin(row, lot))
                    count = np.zeros((len(lot), size), dtype=np.int64)
                    count[np.searchsorted(lot, row[mine]), g_all[mine] - own[0]] = n_all[mine]
                    p = shares(count, total, v)
                    q = shares(count.sum(axis=1), total.sum(), v)
                    over = np.where(count > 0, p - q[:, None], 0)
                    of, at = [], []
                    for k in range(size):
                        worth = over[:, k]
                        some = np.flatnonzero(worth > 0)
                        if len(some) > best:  # all that tie with the last one stay
                            some = some[worth[some] >= np.partition(worth[some], len(some) - best)[len(some) - best]]
                        of.append(np.full(len(some), k))
                        at.append(some)
                    of, at = np.concatenate(of), np.concatenate(at)
                    yield pa.RecordBatch.from_arrays([pa.array(["term"] * len(at), pa.string()), pa.array(own[of].astype(np.int32)), pa.nulls(len(at), pa.int32()),
                                                      b.column(1).take(pa.array(lot[at])), pa.array(over[at, of])], schema=OUT)
                    hold = size * size <= CELLS
                    if hold and x not in sums:
                        if sum(s.size for s in sums.values()) + size * size > CELLS:
                            for y, s in sums.items():
                                yield _pair_rows(groups.of(y), s, groups.of(y))
                            sums.clear()
                        sums[x] = np.zeros((size, size), dtype=np.int64)
                    for k in range(size):
                        f = np.abs(p - p[:, k:k + 1]).sum(axis=0)
                        if hold:
                            sums[x][k] += f
                        else:
                            yield _pair_rows(own[k:k + 1], f, own)
        for y, s in sums.items():
            yield _pair_rows(groups.of(y), s, groups.of(y))

    return run


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, best: int = BEST, text_col: str = "text",
                lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how far sources of a language lie apart, and on which terms.

    ``pair``: every other source of the language. ``term``: terms that the source has more of than
    the language as a whole. Null text, language and source are ''; a source without terms has its
    row in ``pair`` all the same. Repeated rows are documents of their own. Equal values go by the
    item in UTF-8 order. An empty table gives no rows. Other columns are not read."""
    spark = docs.sparkSession
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(read(text_col).alias("t"), read(lang_col).alias("l"), read(source_col).alias("s"))
    groups = Groups([(r.l, r.s) for r in rows.select("l", "s").distinct().collect()])
    held = spark.sparkContext.broadcast(groups)
    stripes = rows.mapInArrow(_fold(held), STRIPES_DDL)
    kept = materialize(stripes.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge(least_docs), STRIPES_DDL))

    totals = np.zeros(len(groups.names), dtype=np.int64)
    for r in kept.select(F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("c.sources").agg(F.sum("c.counts").alias("n")).collect():
        totals[r.sources] = r.n
    n_terms = np.zeros(max(1, len(groups.langs)), dtype=np.int64)
    for r in kept.groupBy("lang").count().collect():
        n_terms[r.lang] = r["count"]
    known = spark.sparkContext.broadcast((groups, totals, n_terms))
    found = materialize(kept.mapInArrow(_emit(known, best), OUT_DDL))

    names = spark.createDataFrame([(k, x, s) for k, (x, s) in enumerate(groups.names)], "g int, lang string, source string")
    other = names.select(F.col("g").alias("h"), F.col("lang").alias("h_lang"), F.col("source").alias("item"))
    sums = found.where("part = 'pair'").groupBy(F.col("g").alias("s_g"), F.col("h").alias("s_h")).agg(F.sum("value").alias("value"))
    pairs = names.join(other, (F.col("lang") == F.col("h_lang")) & (F.col("g") != F.col("h")))
    pairs = pairs.join(sums, (F.col("g") == F.col("s_g")) & (F.col("h") == F.col("s_h")), "left")
    in_order = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("value").desc(), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", in_order(["lang", "source"]))
    terms = found.where("part = 'term'").select(F.col("g").alias("t_g"), F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", in_order(["t_g"])).where(F.col("rank") <= best)
    terms = terms.join(names, F.col("t_g") == F.col("g")).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return divergences(documents(spark, sf_dir))


SQL_TEXT = f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
tot AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    (1 + {PARTS}::HUGEINT * (coalesce(c.n, 0) + {EXTRA}) // (tot.total + {EXTRA} * v.v))::BIGINT AS p
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang JOIN tot ON tot.lang = g.lang AND tot.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
lt AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
lq AS (
  SELECT lt.lang, lt.term, (1 + {PARTS}::HUGEINT * (lt.n + {EXTRA}) // ((SELECT sum(total) FROM tot WHERE tot.lang = lt.lang) + {EXTRA} * v.v))::BIGINT AS q
  FROM lt JOIN v ON v.lang = lt.lang),
pr AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tm AS (
  SELECT dense.lang, dense.source, dense.term AS item, dense.p - lq.q AS value
  FROM dense JOIN lq ON lq.lang = dense.lang AND lq.term = dense.term WHERE dense.n > 0 AND dense.p > lq.q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pr UNION ALL SELECT lang, source, 'term', item, value FROM tm),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= {BEST}"""

QUERIES = {"op13_source_divergence": op13_source_divergence}
SQL = {"op13_source_divergence": SQL_TEXT}
