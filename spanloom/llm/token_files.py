"""Token ids as seekable binary files: independent zstandard frames, a trailing seek table, a checksum per frame.

File format (integers little-endian):
  frames   one zstandard frame for each document: its ids as u32, one after the other
  table    one zstandard frame: per document `offset u64, size u32, crc32-of-its-bytes u32, doc_id i64, n_ids u32,
           no_id u8` (1 where the doc_id is null)
  trailer  `table_offset u64, table_size u32, table_crc u32, n_docs u32, magic "SLT2"`
A reader takes the trailer, the table and then only the frames of the documents that it is asked for. The table is
in the order of doc_id, and `_files` has each file's least and largest doc_id, so a document is found without a scan.

Documents go to files by ranges of doc_id, in ascending order within a file and over the files; a file is closed
when it holds `most_bytes`, which bounds the table that a writer keeps in memory. A task writes to a name of its own
and renames, so a repeated or lost task leaves whole files only.

Defined results: null and empty texts are the end id alone; rows with one doc_id stay separate rows, ordered by
text; a null doc_id comes first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.chunks import MARKS, Chunks, gather
from spanloom.llm.common import partitions, released, scratch

MAGIC = b"SLT2"
TRAILER = struct.Struct("<QIII4s")
DOC = np.dtype([("offset", "<u8"), ("size", "<u4"), ("crc", "<u4"), ("doc_id", "<i8"), ("n", "<u4"), ("no_id", "u1")])
#: Words that the library is given at a time.
JOINED = 256


class Library(Chunks):
    """The tokenizers library over a text's chunks between white space, each distinct chunk encoded once.

    What the vocabulary's own normalizer and pre-tokenizer do allows for that, and is asked of them: where they drop
    white space no token crosses it; where they lower the case, chunks are remembered in lower case; where they part
    a word from marks behind it, both are remembered by themselves; where a word's last token bears a suffix, many
    words are encoded as one text and its ids are parted behind those tokens. Otherwise whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        ids = lambda t: self.lib.encode(t, add_special_tokens=False).ids
        self.by_chunk = not ids(" \n\t\xa0\u2003") and ids("to be\nor\u2003so") == ids("to") + ids("be") + ids("or") + ids("so")
        folds = self.by_chunk and self.lib.normalizer is not None and self.lib.normalizer.normalize_str("AÉ") == "aé"
        parts = self.lib.pre_tokenizer.pre_tokenize_str("é" + MARKS) if self.by_chunk and self.lib.pre_tokenizer is not None else []
        parted = len(parts) == 2 and parts[1][0] == MARKS
        suffix = getattr(self.lib.model, "end_of_word_suffix", None) if parted else None
        self.last = np.zeros(self.lib.get_vocab_size() if suffix else 0, bool)
        for token, i in self.lib.get_vocab().items() if suffix else ():
            self.last[i] = token.endswith(suffix)
        super().__init__(folds, parted)

    def normal(self, word: str) -> str:
        return self.lib.normalizer.normalize_str(word) if self.lib.normalizer is not None else word

    def learn(self, keys: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters many at a time, the others each by itself."""
        plain = plain & bool(len(self.last))
        sizes, at, made, alone = np.zeros(len(keys), np.int64), [], [], [np.flatnonzero(~plain)]
        where, words = np.flatnonzero(plain), keys.filter(pa.array(plain)).to_pylist()
        for i, e in enumerate(self.lib.encode_batch_fast([" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)], add_special_tokens=False)):
            ids, group = np.asarray(e.ids, "<u4"), where[i * JOINED : (i + 1) * JOINED]
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):  # they can't be told apart
                alone.append(group)
                continue
            sizes[group] = np.diff(ends, prepend=0)
            at.append(group)
            made.append(ids)
        rest = np.concatenate(alone)
        for e in self.lib.encode_batch_fast(keys.take(pa.array(rest)).to_pylist(), add_special_tokens=False) if len(rest) else ():
            made.append(np.asarray(e.ids, "<u4"))
        sizes[rest] = [len(m) for m in made[len(made) - len(rest) :]]
        at = np.concatenate([*at, rest])
        flat = np.concatenate([*made, np.zeros(0, "<u4")])
        starts = np.zeros(len(keys), np.int64)
        starts[at] = np.cumsum(sizes[at]) - sizes[at]
        return sizes, gather(flat, starts, sizes)

    def encode_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids, in order."""
        if self.by_chunk:
            yield from super().encode_many(texts)
            return
        for t in texts:
            yield np.asarray(self.lib.encode_batch_fast([t], add_special_tokens=False)[0].ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


class Writer:
    """A file under way: add() documents in the order of doc_id, then close()."""

    def __init__(self, out):
        self.out, self.at, self.docs, self.n_ids = out, 0, [], 0
        self.zip = zstandard.ZstdCompressor(level=1, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        data = self.zip.compress(ids)
        self.docs.append((self.at, len(data), zlib.crc32(data), doc_id or 0, len(ids) // 4, doc_id is None))
        self.out.write(data)
        self.at += len(data)
        self.n_ids += len(ids) // 4

    def close(self) -> None:
        data = self.zip.compress(np.array(self.docs, DOC).tobytes())
        self.out.write(data)
        self.out.write(TRAILER.pack(self.at, len(data), zlib.crc32(data), len(self.docs), MAGIC))
        self.out.close()

    def facts(self) -> tuple:
        """n_docs, n_ids, least and largest doc_id (null if all are)."""
        ids = [d[3] for d in (self.docs[0], self.docs[-1]) if not d[5]]
        first = next((d[3] for d in self.docs if not d[5]), None)
        return len(self.docs), self.n_ids, first, ids[-1] if ids else None


class Reader:
    """documents() streams all; get(doc_id) reads the frames of that document alone."""

    def __init__(self, file):
        self.file, size = file, file.size()
        if size < TRAILER.size:
            raise ValueError("no trailer")
        at, n, crc, docs, magic = TRAILER.unpack(file.read_at(TRAILER.size, size - TRAILER.size))
        data = file.read_at(n, at)
        if magic != MAGIC or zlib.crc32(data) != crc:
            raise ValueError("damaged seek table")
        self.unzip = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(self.unzip.decompress(data), DOC, docs)

    def frame(self, i: int) -> bytes:
        """The ids of the i-th document."""
        d = self.docs[i]
        data = self.file.read_at(int(d["size"]), int(d["offset"]))
        if zlib.crc32(data) != d["crc"]:
            raise ValueError(f"damaged frame {i}")
        return self.unzip.decompress(data)

    def documents(self, near: int = 1 << 22) -> Iterator[tuple[int | None, bytes]]:
        """All documents; frames that follow each other are read together, about `near` bytes at a time."""
        ends = self.docs["offset"].astype(np.int64) + self.docs["size"]
        at = 0
        while at < len(self.docs):
            begin = int(self.docs["offset"][at])
            end = max(at + 1, int(np.searchsorted(ends, begin + near, "right")))
            data = self.file.read_at(int(ends[end - 1]) - begin, begin)
            for i, (offset, size, crc, doc_id, _, no_id) in enumerate(self.docs[at:end].tolist(), at):
                part = data[offset - begin : offset - begin + size]
                if zlib.crc32(part) != crc:
                    raise ValueError(f"damaged frame {i}")
                yield None if no_id else doc_id, self.unzip.decompress(part)
            at = end

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every row with that doc_id."""
        nulls = int(self.docs["no_id"].sum())  # they come first
        own = self.docs["doc_id"][nulls:]
        low, high = np.searchsorted(own, doc_id), np.searchsorted(own, doc_id, "right")
        return [np.frombuffer(self.frame(nulls + i), "<u4") for i in range(int(low), int(high))]


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


FILES = "file int, part int, name string, n_docs long, n_ids long, first_id long, last_id long"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, ranges: int, most_bytes: int = 1 << 28) -> DataFrame:
    """Writes the files below path, at once; returns FILES, a row per file."""
    fs, base = store(path)
    fs.create_dir(base, recursive=True)
    names = [f.split()[0] for f in FILES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(path)
        lib, part = library(tokenizer), TaskContext.get().partitionId()
        out, draft, done, end = None, "", [], int(end_id).to_bytes(4, "little")

        def close() -> None:
            name = f"ids-{part:06d}-{len(done):04d}.slt"
            out.close()
            fs.move(draft, f"{base}/{name}")
            done.append((part, len(done), name, *out.facts()))

        for b in batches:
            texts = (t.as_py() or "" for t in b.column(1))
            for i, ids in zip((i.as_py() for i in b.column(0)), lib.encode_many(texts)):
                if out is None:
                    draft = f"{base}/_draft-{uuid.uuid4().hex}"
                    out = Writer(fs.open_output_stream(draft))
                out.add(i, ids + end)
                if out.at >= most_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n < 2 else pa.string() if n == 2 else pa.int64()) for n, c in enumerate(zip(*done))], names)

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(released(run), FILES).write.parquet(f"{path}/_files")
    return docs.sparkSession.read.schema(FILES).parquet(f"{path}/_files")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in READ.split(", ")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (u32 little-endian) of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(path)
        for b in batches:
            for name, at in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(f"{base}/{name}") as f:
                    rows, held = [], 0
                    for d, ids in Reader(f).documents():
                        rows.append((d, at, len(ids) // 4, zlib.crc32(ids), ids))
                        at, held = at + len(ids) // 4, held + len(ids)
                        if held > 1 << 23:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    table = spark.read.schema(FILES).parquet(f"{path}/_files")
    # one row per file: a running sum over as many rows as there are files
    before = F.sum("n_ids").over(Window.orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1))
    table = table.withColumn("before", F.coalesce(before, F.lit(0)))
    return table.select("name", "before").repartition(partitions(spark)).mapInArrow(released(run), READ)


def fetch(spark: SparkSession, path: str, ids: Sequence[int]) -> dict[int, list[np.ndarray]]:
    """The ids of a few documents: only files whose range has them are opened, only their frames decompressed."""
    wanted, out = sorted(set(ids)), {}
    table = spark.read.schema(FILES).parquet(f"{path}/_files")
    hit = F.exists(F.array(*[F.lit(i) for i in wanted]), lambda i: (i >= F.col("first_id")) & (i <= F.col("last_id")))
    fs, base = store(path)
    for r in table.where(hit).orderBy("file", "part").collect() if wanted else ():
        with fs.open_input_file(f"{base}/{r['name']}") as f:
            reader = Reader(f)
            for i in wanted:
                if r["first_id"] <= i <= r["last_id"] and (found := reader.get(i)):
                    out.setdefault(i, []).extend(found)
    return out


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    path = scratch(spark, "ids")
    write(docs, path, tokenizer, end_id, partitions(spark))
    return read(spark, path).drop("ids")
