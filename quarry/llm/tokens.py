"""Token ids of documents, written as rANS-coded binary blocks in ascending id order and read back.

Files are Parquet tables below one folder: ``blocks`` (one row per block, parts in id order)
and ``table`` (the shared frequencies). Writing takes two passes: texts to ids with every
task's counts (kept in the shared checkpoint folder), and a range shuffle by document id into
blocks. Any block can be read alone.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, materialize, prepare, release, text_slices
from quarry.llm.rans import BLOCK, Coder, checksum, normalise
from quarry.session import ensure_checkpoint_dir

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Bytes of words and their ids that a worker remembers, and what an entry takes beside its characters and ids.
REMEMBER, ENTRY = 96 << 20, 200
#: Text bytes that are split into words at once.
TEXT_BYTES = 4 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts, each different word of a slice through the tokenizer once.

    Where the tokenizer drops white space (tried on a probe), no piece spans two words: then words
    are encoded one by one, and whole texts elsewhere. Where it also takes runs of letters and of
    full stops and commas as pieces of their own, a plain word goes to its model as lower-case
    letters, and what follows it by itself, so words that differ in case or in what follows are
    looked up once. Plain are only letters that the tokenizer's own normalizer turns into one
    letter, as a piece; any other word is encoded as it stands."""

    PROBE = "The cat's 12th  \n café, naïve. (Straße) x,y a.b zzzyx., 中文\tend"
    #: Letters tried beside A-Z (Latin letters with marks); none of them composes with another.
    TRIED = "".join(map(chr, range(0xC0, 0x250)))

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.model = self.tok.model.tokenize
        self.words: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {"": b""}  # plain ones, with A-Z in lower case
        self.held = 0
        self.by_word = self.one(self.PROBE) == [i for w in self.PROBE.split() for i in self.one(w)]
        good = [c for c in string.ascii_letters + self.TRIED if self.by_word and self._plain(c)]
        self.plain = re.compile(f"([{''.join(good)}]+)([.,]*)").fullmatch if good[:52] == [*string.ascii_letters] else None

    def one(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _plain(self, c: str) -> bool:
        """Whether the letter's normal form is its lower case, one letter that NFC leaves alone, and it
        makes one piece with letters around it and none with a full stop or a comma."""
        low = c.lower()
        if len(low) != 1 or not c.isalpha() or unicodedata.normalize("NFC", c) != c or self.tok.normalizer.normalize_str(c) != low:
            return False
        pieces = [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(f"a{low}b., {low}, {low}{low}")]
        spell = lambda w: self.spelt(w)[0][0]
        return pieces == [spell(f"a{low}b"), ".,", spell(low), ",", spell(low + low)]

    def word(self, w: str) -> bytes:
        """Ids of a word as it stands."""
        ids = self.words.get(w)
        return self._keep(self.words, w, self.one(w)) if ids is None else ids

    def _stem(self, stem: str) -> bytes | None:
        """Ids of a plain word's letters; None if the word is not plain."""
        if not self.plain(stem):
            return None
        low = stem.lower()
        return self._keep(self.stems, stem, [t.id for t in self.model(low if low.isascii() else self.spelt(low)[0][0])])

    def _keep(self, held: dict[str, bytes], key: str, ids: list[int]) -> bytes:
        raw = array("I", ids).tobytes()
        if self.held < REMEMBER:  # the frequent ones come early
            self.held += ENTRY + len(key.encode("utf-8", "surrogatepass")) + len(raw)
            held[key] = raw
        return raw

    def _pieces(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids of pieces, and the two that each word is made of; the last piece is empty."""
        if not self.plain:
            per = [*map(self.word, _strings(words)), b""]
            return per, np.stack([np.arange(len(words)), np.full(len(words), len(words))], 1)
        stem = pc.ascii_rtrim(words, characters=".,")
        more = pc.binary_length(words).to_numpy() - pc.binary_length(stem).to_numpy()
        low = pc.ascii_lower(stem).dictionary_encode()
        names = _strings(low.dictionary)
        per = list(map(self.stems.get, names))
        plain = np.ones(len(per), dtype=bool)
        for k, ids in enumerate(per):
            if ids is None and (ids := self._stem(names[k])) is None:
                ids, plain[k] = b"", False
            per[k] = ids
        first = low.indices.to_numpy()
        whole = ~plain[first]
        as_is = np.flatnonzero(whole)
        first = np.where(whole, len(per) + np.cumsum(whole) - 1, first)
        per += map(self.word, _strings(words.take(pa.array(as_is))))
        ends = np.flatnonzero((more > 0) & ~whole)
        tails = [w[-n:] for w, n in zip(_strings(words.take(pa.array(ends))), more[ends].tolist())]
        place = {t: len(per) + k for k, t in enumerate(dict.fromkeys(tails))}
        per += [*map(self.word, place), b""]
        second = np.full(len(words), len(per) - 1)
        second[ends] = [place[t] for t in tails]
        return per, np.stack([first, second], 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none), one after the other, and how many each has."""
        if not self.by_word:
            each = [np.array(self.one(t or ""), dtype=np.uint32) for t in texts.to_pylist()]
            return np.concatenate(each) if each else np.zeros(0, dtype=np.uint32), np.array([len(e) for e in each], dtype=np.int64)
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = 2 * np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        enc = split.flatten().dictionary_encode()
        del split
        per, pieces = self._pieces(enc.dictionary)
        code = pieces.astype(np.int32)[enc.indices.to_numpy()].reshape(-1)
        del enc, pieces
        size = np.fromiter(map(len, per), dtype=np.int32, count=len(per)) // 4
        flat = np.frombuffer(b"".join(per), dtype=np.uint32)
        del per
        n = size[code]
        at = (np.cumsum(size, dtype=np.int32) - size)[code]
        upto = np.cumsum(n, dtype=np.int32)
        at -= upto
        at += n
        at = np.repeat(at, n)
        del code, n
        at += np.arange(len(at), dtype=np.int32)
        return flat[at], np.diff(np.r_[0, upto][np.r_[0, ends]])


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


#: One encoder per worker and tokenizer, so that what it remembers serves all of the worker's tasks.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _tokenise(path: str, end_id: int):
    """A row per document; a last one per task has how often each id occurs (``counts``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, z = encoder(path), zstandard.ZstdCompressor(level=1)
        total = np.zeros(end_id + 1, dtype=np.int64)
        names = ["doc_id", "ids", "counts"]
        for b in batches:
            for a, e in text_slices(b.column(1), TEXT_BYTES):
                ids, n = enc.encode(b.column(1)[a:e])
                got = np.bincount(ids, minlength=len(total))
                got[:len(total)] += total
                total = got
                total[end_id] += len(n)
                at = np.r_[0, np.cumsum(n)]
                raw = [z.compress(np.append(ids[x:y], np.uint32(end_id)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) for x, y in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0)[a:e], pa.array(raw, pa.binary()), pa.nulls(e - a, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)
        release()

    return run


def _ids(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for b in batches:
        for raw in b.column(0):
            got = np.frombuffer(raw.as_py(), dtype="<i8").astype(np.int64)
            if len(got) > len(total):
                got, total = total, got
            total[:len(got)] += got
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])


BLOCKS = """part int, block int, before long, n long, lanes int, doc_ids array<long>, lens array<long>,
  words binary, states binary, marks array<struct<step:int,at:int,states:binary>>, crc long"""
KINDS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("lanes", pa.int32()),
                   ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("words", pa.binary()), ("states", pa.binary()),
                   ("marks", pa.list_(pa.struct([("step", pa.int32()), ("at", pa.int32()), ("states", pa.binary())]))), ("crc", pa.int64())])


def _write_blocks(held, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(held.value), TaskContext.get().partitionId()
        no, before, size, docs, parts = 0, 0, 0, [], []

        def block() -> pa.RecordBatch:
            got = coder.encode(np.concatenate(parts))
            row = got | {"part": part, "block": no, "before": before, "doc_ids": docs, "lens": [len(p) for p in parts], "crc": checksum(got)}
            return pa.RecordBatch.from_pylist([row], KINDS)

        for b in batches:
            for d, raw in zip(b.column(0), b.column(1)):
                docs.append(d.as_py())
                parts.append(_ids(raw.as_py()))
                size += len(parts[-1])
                if size >= block_ids:
                    yield block()
                    no, before, size, docs, parts = no + 1, before + size, 0, [], []
        if parts:
            yield block()
        release()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text", block_ids: int = BLOCK) -> None:
    """Writes the ids of every text (null: none) and ``end_id`` after each, by ascending document id.

    A null id comes last; rows of one id stand by their ids' hash, repeated rows one after the
    other. An empty table gives empty files. Other columns are not read."""
    spark = docs.sparkSession
    done = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col)
                       .mapInArrow(_tokenise(tokenizer or tokenizer_path(), end_id), "doc_id long, ids binary, counts binary"))
    # one row per different id: at most the vocabulary
    counts = done.where("counts IS NOT NULL").select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max([0, *(r.id + 1 for r in counts)]), dtype=np.int64)
    for r in counts:
        total[r.id] = r.n
    freq = normalise(total)
    rows = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(rows, "id long, freq long").coalesce(1).write.mode("overwrite").parquet(f"{path}/table")
    held = spark.sparkContext.broadcast(freq)
    done = done.where("ids IS NOT NULL").select("doc_id", "ids")
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("ids")]
    ranged = done.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranged.mapInArrow(_write_blocks(held, block_ids), BLOCKS).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")


def _coder(spark: SparkSession, path: str):
    rows = spark.read.schema("id long, freq long").parquet(f"{path}/table").collect()
    freq = np.zeros(max([0, *(r.id + 1 for r in rows)]), dtype=np.int64)
    for r in rows:
        freq[r.id] = r.freq
    return spark.sparkContext.broadcast(freq)


def _read_blocks(held, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                coder = coder or Coder(held.value)
                if checksum(row) != row["crc"]:
                    raise ValueError(f"part {row['part']}, block {row['block']}: its checksum differs")
                ids = coder.decode(row).astype("<u4")
                lens = np.array(row["lens"], dtype=np.int64)
                at = np.r_[0, np.cumsum(lens)]
                raw = ids.tobytes()
                cols = [pa.array([row["part"]] * len(lens), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["before"] + at[:-1]), pa.array(lens),
                        pa.array([zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())]
                names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([ids[x:y].astype(np.int64) for x, y in zip(at[:-1], at[1:])], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` counts the ids of all documents before. A damaged block raises an error."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # one row per part
    upto = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("part").alias("part_"), F.coalesce(upto, F.lit(0)).alias("base"))
    kind = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    docs = blocks.mapInArrow(_read_blocks(_coder(spark, path), with_ids), kind)
    docs = docs.join(F.broadcast(parts), F.col("part") == F.col("part_"))
    cols = ["doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"]
    return docs.select(*cols, *(["ids"] if with_ids else []))


def token_files(docs: DataFrame) -> DataFrame:
    """Writes ``docs`` to a new folder in the shared checkpoint folder and reads it back."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files/{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return read_tokens(spark, path)


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_files(documents(spark, sf_dir))


QUERIES = {"op3_rans_tokens": op3_rans_tokens}
