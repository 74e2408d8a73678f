"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but token ids, 16 bits each, most significant byte first, with an
end-of-document id after each document: no index, no header. Documents begin with six ids that hold
the row's key in base 2^12, so that a document names its row wherever it lies.

Files are scanned in byte ranges of Spark's own splitting, so a file of any size is dealt over tasks. A task gets
its range as runs of bytes between separators and joins them to blocks again; in a block, all end-of-document ids are found at once (a vectorised comparison). Two things
about a block are not known there: how many bytes lie before it, so whether ids begin at its even or odd bytes, and where the document began that it
opens with. So a block is searched in both alignments, and a prefix scan over the blocks of each file (running sums of bytes, running counts
of separators) decides the alignment and stitches documents that span blocks. Counts follow as differences of neighbouring separators.

Files are written by Spark's own writer into the folder shared by all executors: a row is a document's ids as raw
bytes, the line separator is the end-of-document id, whose two bytes are valid UTF-8 by choice.

Defined results: null and empty texts count 0 tokens. Null keys come back as null. Ids after a file's last separator belong to no finished
document and are reported with end = false and a null key. Repeated rows give repeated counts. Empty tables and files give no rows; columns but doc_id and text are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from .blocks import fresh, prepare, slices, stored

#: The end-of-document id and its bytes: 0xC480, over every id of the vocabulary.
END, END_TEXT = 0xC480, "Ā"
#: The ids at a document's start that hold its key.
KEY_IDS = 6
_KEY_BITS = 12
_ID = np.dtype(">u2")

_encodings: dict[str, object] = {}


def tokenizer(path: str):
    """The byte-pair encoding of a file of ranks, kept per process."""
    if path not in _encodings:
        import tiktoken

        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        if max(ranks.values()) >= END:
            raise ValueError("the vocabulary reaches the end-of-document id")
        _encodings[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


#: The bit of a key's first id that marks a null key.
_NULL = 1 << 4


def key_ids(keys: list[int | None]) -> np.ndarray:
    """Six ids of 12 bits for each key; the first bit beyond 64 marks a null one."""
    shifts = np.arange(KEY_IDS - 1, -1, -1, dtype=np.uint64) * np.uint64(_KEY_BITS)
    values = np.array([0 if k is None else k for k in keys], np.int64).view(np.uint64)
    out = ((values[:, None] >> shifts) & np.uint64((1 << _KEY_BITS) - 1)).astype(_ID)
    out[[k is None for k in keys], 0] = _NULL
    return out


def keys_of(heads: np.ndarray) -> list[int | None]:
    """Keys from the first six ids of documents."""
    shifts = np.arange(KEY_IDS - 1, -1, -1, dtype=np.uint64) * np.uint64(_KEY_BITS)
    value = (heads.astype(np.uint64) << shifts).sum(1, dtype=np.uint64).view(np.int64)
    return [None if h & _NULL else v for h, v in zip(heads[:, 0].tolist(), value.tolist(), strict=True)]


def write(docs: DataFrame, vocabulary: str, path: str) -> None:
    """Encodes every whole text and writes flat token files."""
    prepare(docs.sparkSession)

    def encoded(batches):
        bpe = tokenizer(vocabulary)
        for part, texts in slices(batches, "text"):
            keys = key_ids(part.column(part.schema.get_field_index("doc_id")).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() + (np.array(bpe.encode_ordinary(t), _ID).tobytes() if t else b"") for k, t in zip(keys, texts, strict=True)], pa.binary())], names=["value"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encoded, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", END_TEXT).option("compression", "none").text(path)


#: Bytes of a block at about which the next one begins.
BLOCK_BYTES = 4 << 20
_SEPARATOR = END_TEXT.encode()
_BLOCK = StructType([StructField(n, t) for n, t in [("file", StringType()), ("range", LongType()), ("seq", LongType()), ("bytes", LongType()), ("align", LongType()), ("first", LongType()), ("last", LongType()), ("head", BinaryType()), ("tail", BinaryType()), ("final", BooleanType()), ("size", LongType()), ("doc_id", LongType()), ("at", LongType()), ("n_tokens", LongType())]])
_WIDTH = 2 * KEY_IDS


def ends_in(block: bytes, align: int) -> np.ndarray:
    """Byte positions of end-of-document ids in a block whose ids begin at its byte `align`."""
    ids = np.frombuffer(block, _ID, (len(block) - align) // 2, align) if len(block) > align else np.zeros(0, _ID)
    return 2 * np.flatnonzero(ids == END) + align


def scan_block(block: bytes) -> Iterator[tuple]:
    """For both alignments: the alignment, where the first separator lies and what comes after the last one (null without any), the first bytes of the block and of that rest, and the documents
    that lie between two separators (their keys, places and tokens)."""
    for align in (0, 1):
        ends = ends_in(block, align)
        if not len(ends):
            yield align, None, None, block[:_WIDTH], None, ([], [], [])
            continue
        starts, stops = ends[:-1] + 2, ends[1:]
        data = np.frombuffer(block, np.uint8)
        at = np.minimum(starts[:, None] + np.arange(_WIDTH), len(data) - 1)
        heads = np.ascontiguousarray(data[at]).view(_ID)
        n = (stops - starts) // 2 - KEY_IDS
        keys = [k if m >= 0 else None for k, m in zip(keys_of(heads), n.tolist(), strict=True)]
        rest = int(ends[-1]) + 2
        yield align, int(ends[0]), rest, block[: min(_WIDTH, int(ends[0]))], block[rest : rest + _WIDTH], (keys, starts.tolist(), np.maximum(n, 0).tolist())


def _blocks(batches) -> Iterator[tuple]:
    """(file, range, size of the file, bytes, final) from rows in order: blocks, each with the separators after its rows. The last row of a file comes alone, and what may follow it, too."""

    def flush(key, rows):
        file, start, length, size = key
        if start + length >= size and rows:  # the last range of a file
            if len(rows) > 1:
                yield file, start, size, b"".join(r + _SEPARATOR for r in rows[:-1]), False
            yield file, start, size, rows[-1], False
            yield file, start, size, _SEPARATOR, True
        elif rows:
            yield file, start, size, b"".join(r + _SEPARATOR for r in rows), False

    key, rows, held = None, [], 0
    for part, values in slices(batches, "value"):
        for new, value in zip(zip(*[part.column(i).to_pylist() for i in range(4)], strict=True), values, strict=True):
            if new != key:
                if key is not None:
                    yield from flush(key, rows)
                key, rows, held = new, [], 0
            elif held > BLOCK_BYTES:
                yield key[0], key[1], key[3], b"".join(r + _SEPARATOR for r in rows), False
                rows, held = [], 0
            rows.append(value)
            held += len(value) + 2
    if key is not None:
        yield from flush(key, rows)


def _scanned(batches):
    counter: dict[tuple, int] = {}
    for file, start, size, block, final in _blocks(batches):
        counter[file, start] = seq = counter.get((file, start), -1) + 1
        rows = []
        for align, first, last, head, tail, (keys, places, tokens) in scan_block(block):
            rows.append((file, start, seq, len(block), align, first, last, head, tail, final, size, None, None, None))
            rows += [(file, start, seq, None, align, None, None, None, None, None, None, k, p, n) for k, p, n in zip(keys, places, tokens, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=_BLOCK.names)


_ARROW = [pa.string(), *[pa.int64()] * 6, pa.binary(), pa.binary(), pa.bool_(), *[pa.int64()] * 4]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """One row (file, doc_id, at, n_tokens, end) for each document of the token files under a path; at counts ids from the file's start."""
    prepare(spark)
    raw = spark.read.option("lineSep", END_TEXT).option("pathGlobFilter", "part-*").text(path)
    raw = raw.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    found = stored(raw.mapInArrow(_scanned, _BLOCK), "blocks")
    # the prefix scan: bytes before each block give its alignment, and separators before it the number of the document that it opens with
    order = Window.partitionBy("file").orderBy("range", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.where("bytes is not null")
    sums = blocks.where("align = 0").select("file", "range", "seq", "bytes", "final", "size")
    sums = sums.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0))).where(~F.col("final") | (F.col("base") + F.col("bytes") <= F.col("size")))
    sums = sums.select("file", "range", "seq", "base", (F.col("base") % 2).alias("align"))
    inner = found.where("bytes is null").join(sums, ["file", "range", "seq", "align"]).select("file", "doc_id", F.expr("(base + at) div 2").alias("at"), "n_tokens", F.lit(True).alias("end"))
    own = blocks.join(sums, ["file", "range", "seq", "align"]).withColumn("g", F.coalesce(F.sum(F.col("first").isNotNull().cast("long")).over(before), F.lit(0)))
    piece = lambda g, at, n, text, closed: F.struct(g.alias("g"), at.alias("at"), n.alias("n"), text.alias("text"), closed.alias("closed"))
    zero = F.lit(0).cast("long")
    opens = piece(F.col("g"), F.col("base"), F.coalesce("first", "bytes"), F.col("head"), F.col("first").isNotNull())
    rest = F.when(F.col("first").isNotNull(), piece(F.col("g") + 1, F.col("base") + F.col("last"), F.col("bytes") - F.col("last"), F.col("tail"), F.lit(False)))
    parts = own.select("file", F.explode(F.filter(F.array(opens, rest), lambda p: p.isNotNull())).alias("p")).select("file", "p.*")
    # a document's first bytes, of which each piece has as many as a key takes
    head = F.when(F.col("at") - F.min("at").over(Window.partitionBy("file", "g")) < _WIDTH, F.when(F.col("n") > zero, F.struct("at", "text")))
    whole = parts.withColumn("h", head).groupBy("file", "g").agg(F.min("at").alias("start"), F.sum("n").alias("n"), F.max("closed").alias("end"), F.array_sort(F.collect_list("h")).alias("h"))
    text = F.substring(F.concat(*[F.coalesce(F.get(F.col("h"), F.lit(i))["text"], F.lit(b"")) for i in range(_WIDTH)]), 1, _WIDTH)
    whole = whole.where((F.col("end") | (F.col("n") > 0)) & ((F.col("g") > 0) | F.col("end") | (F.col("n") > 0))).select("file", "start", "n", "end", text.alias("text"))

    @F.pandas_udf("long")
    def key(text: pd.Series) -> pd.Series:
        heads = np.array([np.frombuffer(t, _ID) if len(t) == _WIDTH else np.full(KEY_IDS, _NULL, _ID) for t in text]).reshape(-1, KEY_IDS)
        return pd.Series(keys_of(heads), dtype="Int64")

    n = F.expr("n div 2")
    stitched = whole.select("file", F.when(F.col("end") & (n >= KEY_IDS), key("text")).alias("doc_id"), F.expr("start div 2").alias("at"), F.when(F.col("end"), F.greatest(n - KEY_IDS, zero)).otherwise(n).alias("n_tokens"), "end")
    return inner.unionByName(stitched)


def counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the texts as token files and counts them by scanning those."""
    path = fresh(docs.sparkSession, "tokens")
    write(docs, vocabulary, path)
    return scan(docs.sparkSession, path)
