"""Flat files of unsigned token ids with 64-bit document offsets, written by ranges of document id and memory-mapped.

Every range partition writes ``.bin`` (little-endian unsigned ids of 16 bits where the vocabulary allows, else of 32), ``.idx`` (offsets of its documents, one more than
documents) and ``.doc`` (document ids as an Arrow file). The manifest row of the attempt that won names its files; the
partitions' bases are prefix sums over the manifest.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib
from array import array
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch
from .pretokens import WordCache

#: Bytes of text that one range of documents holds on average.
RANGE_BYTES = 16 << 20
#: Most ranges, and so rows of the manifest; beyond them ranges grow with the input (100 TB make ranges of 760 MB).
MOST_RANGES = 1 << 17


def tokenizer_file() -> str:
    """The default tokenizer, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


@lru_cache(2)
def _worker(path: str, end_id: int):
    """Ids of a list of texts, one bytes object each, and the kind of the integers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    kind = "<u2" if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    code = "H" if kind == "<u2" else "I"
    letters, tokenize = byte_letters(), tokenizer.model.tokenize

    def encode(words: list[str]) -> list[bytes]:
        # a match is what the library's pre-tokenizer hands to its model, byte by byte as printable characters
        return [array(code, [t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))]).tobytes() for w in words]

    words = WordCache(encode, most=700_000)
    # the library finds the strings of added tokens in a text before it splits the rest
    added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    special = re.compile("|".join(added) or r"(?!)")

    def ids(texts: list[str]):
        plain = words.ids([x for x in texts if not special.search(x)])
        for x in texts:
            yield array(code, tokenizer.encode(x, add_special_tokens=False).ids).tobytes() if special.search(x) else next(plain)

    return ids, kind


def _write(path: str | None, folder: str, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("kind", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches):
        ids_of, kind = _worker(path or tokenizer_file(), end_id)
        width = np.dtype(kind).itemsize
        store, root = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        end, offsets, stream, docs, sink = np.array([end_id], kind).tobytes(), [0], None, None, None
        for batch in batches:
            if not len(batch):
                continue
            if stream is None:
                store.create_dir(root, recursive=True)
                stream, sink = store.open_output_stream(f"{name}.bin"), store.open_output_stream(f"{name}.doc")
                docs = pa.ipc.new_file(sink, pa.schema([("doc_id", pa.int64())]))
            docs.write(pa.record_batch({"doc_id": batch.column(0).cast(pa.int64())}))
            for lo in range(0, len(batch), 256):
                for raw in ids_of([x or "" for x in batch.column(1).slice(lo, 256).to_pylist()]):
                    stream.write(raw + end)
                    offsets.append(offsets[-1] + len(raw) // width + 1)
        if stream is not None:
            stream.close()
            docs.close()
            sink.close()
            with store.open_output_stream(f"{name}.idx") as f:
                f.write(np.array(offsets, "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([kind]), pa.array([len(offsets) - 1], pa.int64()), pa.array([offsets[-1]], pa.int64())], schema=schema)

    return run


@contextmanager
def mapped(store: pafs.FileSystem, path: str, dtype: str):
    """A memory map of a file; one of a remote store is fetched first."""
    if isinstance(store, pafs.LocalFileSystem):
        yield np.memmap(path, dtype, "r")
        return
    with tempfile.NamedTemporaryFile() as local:
        with store.open_input_stream(path) as f:
            while chunk := f.read(1 << 22):
                local.write(chunk)
        local.flush()
        yield np.memmap(local.name, dtype, "r")


def write_token_files(df: DataFrame, key: str, text: str, path: str | None = None, end_id: int = 2) -> tuple[str, DataFrame]:
    """Encode every whole text and write the files; returns their folder and the manifest with bases.

    Ids are those that the tokenizers library's ``encode`` gives with add_special_tokens=False, then ``end_id`` for each
    document. A text that holds the string of an added token, such as an end mark, is encoded by that call, which makes
    the string one id; of all others the pattern's matches are encoded alone, and a match met before in a worker is
    looked up (a bounded number). Documents lie in
    ascending ``key`` order, nulls first; rows of one key are ordered by a hash of their text. A null text is empty and
    gives the end id only; repeated rows all stay; other columns are not read; an empty table writes no files.
    """
    spark = df.sparkSession
    folder = scratch.new_path(spark, "tokens")
    n_bytes = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    ranges = max(1, min(n_bytes // RANGE_BYTES, MOST_RANGES), min(spark.sparkContext.defaultParallelism, n_bytes >> 20))
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    ordered = rows.repartitionByRange(ranges, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    manifest = scratch.materialize(ordered.mapInArrow(_write(path, folder, end_id), "part int, path string, kind string, n_docs long, n_ids long"), "manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a file, MOST_RANGES at most
    return folder, manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, kind, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{name}.doc") as f:
                    docs = pa.ipc.open_file(f).read_all().column(0).combine_chunks()
                with mapped(store, f"{name}.idx", "<i8") as offsets, mapped(store, f"{name}.bin", kind) as ids:
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                    starts = np.asarray(offsets)
                    yield pa.record_batch({"doc_id": docs, "start": pa.array(starts[:-1] + base, pa.int64()), "n_tokens": pa.array(np.diff(starts), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    files = manifest.select("path", "kind", "base", "part")
    n = max(1, min(files.count(), 4 * files.sparkSession.sparkContext.defaultParallelism))
    return files.repartition(n, "part").select("path", "kind", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(*write_token_files(docs, "doc_id", "text"))
