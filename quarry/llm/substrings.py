"""Repeated passages: words covered by a window that also stands in a document with a smaller id go.

Matching statistics against suffix automata find the repeats. One automaton over everything
would not fit, and streaming every document past every shard would grow with the square of the
corpus, so documents are routed. Every window of W words has an anchor, the least hash among
its K-word grams; equal windows have equal anchors at equal places. A run of windows with one
anchor is a segment. Segments are routed by anchor; the different segments of one anchor are a
reference shard, which is streamed in the order of document ids past an automaton of what came
before. Windows whose match is at least W long are covered; overlapping ones make maximal spans.

Equal segments collapse to one row before words are sent anywhere, and all their documents but
the first are covered as a whole. Anchors with more than ``SHARD`` different segments would
make one long stream; their windows are compared by hash and aggregated instead, to the same
result. Words are 64-bit hashes of their characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import codepoints, documents, materialize, prepare, text_slices
from quarry.llm.hashing import span_hashes, word_bounds

WINDOW, GRAM = 50, 10
#: Different segments of an anchor that one automaton is built from.
SHARD = 512


class SuffixAutomaton:
    """Suffix automaton of several sequences; ``match`` gives matching statistics."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, arcs: dict) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the strings of q that end an arc from p; a copy of q if q has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = self._split(last, q, c)
                continue
            p, last = last, self._state(self.length[last] + 1, 0, {})
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = last
                p = self.link[p]
            if p >= 0:
                self.link[last] = self._split(p, self.next[p][c], c)

    def match(self, sequence: list[int]) -> list[int]:
        """For every place the length of the longest stretch ending there that a sequence added holds."""
        out, state, size = [], 0, 0
        arcs, link, length = self.next, self.link, self.length
        for c in sequence:
            while state and c not in arcs[state]:
                state = link[state]
                size = length[state]
            to = arcs[state].get(c)
            if to is not None:
                state, size = to, size + 1
            out.append(size)
        return out


class Words:
    """Word hashes of a slice of texts and their rows."""

    def __init__(self, texts: pa.Array):
        self.cps, self.bounds = codepoints(texts)
        self.start, self.stop, self.row = word_bounds(self.cps, self.bounds)
        self.hash = span_hashes(self.cps, self.start, self.stop)
        self.first = np.searchsorted(self.row, np.arange(len(texts) + 1))


def _segments(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in text_slices(b.column(1)):
                w = Words(b.column(1)[x:y])
                n = len(w.hash)
                if n < window:
                    continue
                g = span_hashes(w.hash, np.arange(n - gram + 1), np.arange(gram, n + 1))
                at = np.arange(n - window + 1)
                anchor = at + np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).argmin(axis=1)
                at = at[w.row[window - 1:] == w.row[:n - window + 1]]  # windows within one text
                if not len(at):
                    continue
                new = np.ones(len(at), dtype=bool)
                new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (np.diff(at) != 1)
                s = at[new]
                size = np.diff(np.r_[np.flatnonzero(new), len(at)])
                row = w.row[s]
                ids = b.column(0)[x:y].to_numpy(zero_copy_only=False)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[anchor[s]].view(np.int64)), pa.array(span_hashes(w.hash, s, s + size + window - 1).view(np.int64)),
                     pa.array(ids), pa.array((s - w.first[row]).astype(np.int32)), pa.array(size.astype(np.int16))], ["anchor", "content", "id", "s", "n"])

    return run


def _packed(text: Column) -> Column:
    """Texts pass the shuffle compressed."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        z = zstandard.ZstdCompressor(level=1)
        for texts in batches:
            yield pa.array([z.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary").asNondeterministic()(text)


def _unpacked(packed: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    z, rows, size, start = zstandard.ZstdDecompressor(), [], 0, 0
    for k, p in enumerate(packed.to_pylist()):
        rows.append(z.decompress(p).decode("utf-8", "surrogatepass"))
        size += len(rows[-1])
        if size > 1 << 20 or k + 1 == len(packed):
            yield start, k + 1, pa.array(rows, pa.string())
            rows, size, start = [], 0, k + 1


def _fetch(window: int):
    """The words of every asked segment of a document, where the document has it (its id may repeat)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(1)
            for x, y, texts in _unpacked(b.column(0)):
                w = Words(texts)
                ask, per = wanted[x:y].flatten(), pc.list_value_length(wanted[x:y]).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(y - x), per)
                col = {f.name: ask.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(ask.type)}
                s = w.first[row] + col["s"]
                e = s + col["n"] + window - 1
                ok = e <= w.first[row + 1]
                ok[ok] = span_hashes(w.hash, s[ok], e[ok]).view(np.int64) == col["content"][ok]
                words = [w.hash[i:j].tobytes() for i, j in zip(s[ok], e[ok])]
                yield pa.RecordBatch.from_arrays([*(pa.array(col[c][ok]) for c in ("anchor", "content", "first", "k")), pa.array(words, pa.binary())],
                                                 ["anchor", "content", "first", "k", "words"])

    return run


def _stream(window: int):
    """Covered windows of every segment; rows come by anchor, then by first document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, first, seen, waiting, automaton = None, None, None, [], None
        for b in batches:
            out = ([], [], [], [])
            for a, c, f, raw in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if a != anchor:
                    anchor, first, seen, waiting, automaton = a, None, set(), [], SuffixAutomaton()
                if c in seen:
                    continue  # a document that stands twice
                seen.add(c)
                if f != first:  # only documents before count
                    for w in waiting:
                        automaton.add(w)
                    first, waiting = f, []
                words = np.frombuffer(raw, dtype=np.uint64).tolist()
                ends = [i - window + 1 for i, m in enumerate(automaton.match(words)) if m >= window]
                if len(ends) < len(words) - window + 1:
                    waiting.append(words)
                if ends:
                    for o, v in zip(out, (a, c, f, ends)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["anchor", "content", "first", "js"])

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, c, f, raw in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4))):
                words = np.frombuffer(raw, dtype=np.uint64)
                n = len(words) - window + 1
                h = span_hashes(words, np.arange(n), np.arange(window, len(words) + 1)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([v] * n, pa.int64()) for v in (a, c, f)] + [pa.array(np.arange(n, dtype=np.int32)), pa.array(h)],
                                                 ["anchor", "content", "first", "j", "win"])

    return run


def covered(docs: DataFrame, window: int, gram: int, shard: int) -> DataFrame:
    """(id, cuts): per document with repeats, the segments (content, s, n) and their covered windows (js; null: all).

    ``docs``: id (long, not null) and text."""
    segments = materialize(docs.select("id", "text").mapInArrow(_segments(window, gram), "anchor long, content long, id long, s int, n short"))
    holder = F.min(F.struct("id", "s", "n"))
    contents = segments.groupBy("anchor", "content").agg(holder.alias("h"), F.max("id").alias("last"))
    contents = materialize(contents.select("anchor", "content", F.col("h.id").alias("first"), F.col("h.s").alias("s"), F.col("h.n").alias("n"), "last"))
    several = contents.groupBy("anchor").agg(F.count("*").alias("k"), F.min("first").alias("least"), F.max("first").alias("most"))
    several = several.where("k > 1 AND least < most").select(F.col("anchor").alias("anchor_"), "k")
    asked = (contents.join(several, F.col("anchor") == F.col("anchor_")).groupBy(F.col("first").alias("id_"))
             .agg(F.collect_list(F.struct("anchor", "content", "first", "s", "n", "k")).alias("asked")))  # one document's own segments
    texts = docs.select("id", _packed(F.col("text")).alias("packed")).join(asked, F.col("id") == F.col("id_")).select("packed", "asked")
    words = materialize(texts.mapInArrow(_fetch(window), "anchor long, content long, first long, k long, words binary"))

    part = words.where(F.col("k") <= shard).repartition("anchor").sortWithinPartitions("anchor", "first", "content")
    found = part.mapInArrow(_stream(window), "anchor long, content long, first long, js array<int>")
    # the aggregate and the join both read the windows: they are made once
    each = materialize(words.where(F.col("k") > shard).mapInArrow(_windows(window), "anchor long, content long, first long, j int, win long"))
    least = each.groupBy("win").agg(F.min("first").alias("least")).withColumnRenamed("win", "win_")
    more = (each.join(least, F.col("win") == F.col("win_")).where("least < first").groupBy("anchor", "content")
            .agg(F.min("first").alias("first"), F.collect_set("j").alias("js")))  # at most a segment's windows
    whole = contents.where("last > first").select("anchor", "content", "first", F.lit(None).cast("array<int>").alias("js"))
    known = whole.unionByName(found).unionByName(more).withColumnsRenamed({"anchor": "a_", "content": "c_"})
    hits = segments.join(known, (F.col("anchor") == F.col("a_")) & (F.col("content") == F.col("c_")))
    hits = hits.where((F.col("js").isNull() & (F.col("id") > F.col("first"))) | (F.col("js").isNotNull() & (F.col("id") == F.col("first"))))
    # a set: rows that repeat an id and a text have the same segments
    return hits.groupBy(F.col("id").alias("id_")).agg(F.collect_set(F.struct("content", "s", "n", "js")).alias("cuts"))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _cut(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, texts in _unpacked(b.column(1)):
                w = Words(texts)
                gone = np.zeros(len(w.hash) + 1, dtype=np.int64)  # +1 where a span begins, -1 where it ends
                for r, cuts in enumerate(b.column(2)[x:y].to_pylist()):
                    for c in cuts or []:
                        s = w.first[r] + c["s"]
                        e = s + c["n"] + window - 1
                        if e > w.first[r + 1] or int(span_hashes(w.hash[s:e], np.array([0]), np.array([e - s])).view(np.int64)[0]) != c["content"]:
                            continue  # another row with this id
                        if c["js"] is None:
                            gone[s] += 1
                            gone[e] -= 1
                        else:
                            j = np.array(c["js"], dtype=np.int64)
                            np.add.at(gone, s + j, 1)
                            np.add.at(gone, s + j + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                rows = texts.to_pylist()
                kept, spans, removed = [], [], []
                for r, t in enumerate(rows):
                    a, z = w.first[r], w.first[r + 1]
                    g, base = gone[a:z], w.bounds[r]
                    removed.append(int(g.sum()))
                    edge = np.flatnonzero(np.diff(np.r_[0, g.astype(np.int8), 0]))
                    spans.append([{"start": int(i), "stop": int(j)} for i, j in edge.reshape(-1, 2)])
                    kept.append(" ".join([t[i:j] for i, j in zip((w.start[a:z][~g] - base).tolist(), (w.stop[a:z][~g] - base).tolist())]))
                digest = [hashlib.sha256(k.encode("utf-8", "surrogatepass")).hexdigest() for k in kept]
                cols = [b.column(0)[x:y], pa.array(np.diff(w.first)), pa.array(removed, pa.int64()), pa.array(digest), pa.array(spans, SPANS)]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept)] * with_text, names + ["kept"] * with_text)

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
                    shard: int = SHARD, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans (word numbers, end exclusive)
    and, if asked for, ``kept``, the words left joined by a space.

    A null or empty text has no words. Rows without an id come after all ids, in the order of
    their texts' hashes; rows that share an id are no smaller than one another, so they remove
    nothing from each other. An empty table gives no rows. Other columns are not read."""
    late = F.lit(2 ** 63 - 1) - F.pmod(F.xxhash64(F.col(text_col)), F.lit(2 ** 40))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), late).alias("id"), F.col(text_col).alias("text"))
    cuts = materialize(covered(rows, window, gram, shard))
    joined = rows.select("doc_id", "id", _packed(F.col("text")).alias("packed")).join(cuts, F.col("id") == F.col("id_"), "left")
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>"
    return joined.select("doc_id", "packed", "cuts").mapInArrow(_cut(window, with_text), kind + (", kept string" if with_text else ""))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
SQL = {"op10_substring_dedup": r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^ \t-\r]+'), []) AS words FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
least AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
hit AS (SELECT win.doc_id, win.i FROM win JOIN least USING (h) WHERE least.first < win.doc_id),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
cover AS (
  SELECT word.doc_id, word.i, word.word,
    max(CASE WHEN hit.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM word LEFT JOIN hit ON word.doc_id = hit.doc_id AND word.i = hit.i),
kept AS (
  SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM cover GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""}
