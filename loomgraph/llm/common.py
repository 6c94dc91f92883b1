"""Helpers shared by the operators: shared folders, written tables, remote files, and word hashing in numpy."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a text table sent to Python at a time; keeps a batch small even when every text is very long.
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a local one if Spark runs
    in one process (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        base = os.path.dirname(held) if held else local_dir(spark.sparkContext.master)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return base


def local_dir(master: str) -> str:
    """A temporary folder, for Spark in one process only: executors elsewhere would not see it."""
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="loomgraph-")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/loomgraph-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions; set by the cluster in proportion to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def held_out(id_col, parts: int, part: int):
    """True for ids whose crc32 (of the id as text) leaves the remainder `part`; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


@functools.lru_cache(maxsize=8)
def _filesystem(scheme_host: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(scheme_host + "/")[0]


def open_uri(uri: str, mode: str):
    """A file of the shared folder, opened by URI (file, hdfs, s3, gs) in a Python worker."""
    from pyarrow import fs

    if uri.startswith("file:"):
        where, path = fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    else:
        where, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        where.create_dir(os.path.dirname(path), recursive=True)
        return where.open_output_stream(path, compression=None)
    return where.open_input_file(path)


# --- words of UTF-8 texts as 64-bit polynomial (Rabin-Karp) hashes ---------------------------------------------------

_M = (1 << 64) - 1
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SLICE = 2 << 20


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k modulo 2^64 for k < size."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    a, b = _powers(base, size)
    return a[:n], b[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def byte_table(word_bytes: bytes, lower: bool) -> np.ndarray:
    """For each byte its value in a word, or 0 where it separates words."""
    t = np.zeros(256, np.uint8)
    t[list(word_bytes)] = list(word_bytes)
    if lower:
        t[65:91] = np.arange(97, 123) if t[97] else 0
    return t


#: Words are runs of all but space and \x09-\x0D.
PLAIN = byte_table(bytes(b for b in range(1, 256) if b != 0x20 and not 9 <= b <= 13), lower=False)
#: A-Z count as a-z; words are runs of digits, letters and all beyond ASCII.
FOLDED = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]), lower=True)

#: Words are runs of a-z and all beyond ASCII, in texts that are lower-cased already.
LETTERS = byte_table(bytes([*range(0x61, 0x7B), *range(0x80, 0x100)]), lower=False)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings data[start:end]."""
    p, inv = powers(_BYTE_BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p, out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def _slice_words(buf: np.ndarray, cuts: np.ndarray, table: np.ndarray, prefixes: tuple) -> tuple[np.ndarray, np.ndarray]:
    n = len(buf)
    vals = table[buf]
    inside = vals > 0
    if table is PLAIN:
        inside |= buf == 0  # NUL is an ordinary character of such words
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    spans = [(starts, ends, 0)] + [(starts[k], starts[k] + n, n) for n in prefixes for k in [ends - starts > n]]
    starts = np.concatenate([s for s, _, _ in spans])
    salt = np.repeat(np.array([n for _, _, n in spans], np.uint64), [len(s) for s, _, _ in spans])
    return hash_spans(vals, starts, np.concatenate([e for _, e, _ in spans])) ^ salt, starts


def hash_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, prefixes: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie end to end in `data`, and for each word the index of its text; then, in each
    slice, the same for the beginnings of `prefixes` bytes of longer words.

    Works in slices of about 2 MB, so memory is bounded by the number of words whatever a text's length.
    """
    hashes, docs, at, end = [], [], int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + _SLICE, end)
        if to < end:  # cut between texts, or else between words
            k = int(np.searchsorted(offsets, to, side="right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:
                stop = int(offsets[k + 1])
                while to < stop and (table[data[to]] or (table is PLAIN and data[to] == 0)):
                    to += 1
        h, starts = _slice_words(data[at:to], offsets - at, table, prefixes)
        hashes.append(h)
        docs.append((np.searchsorted(offsets, starts + at, side="right") - 1).astype(np.int64))
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(docs)


def text_buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; nulls count as empty."""
    import pyarrow as pa

    if array.null_count:
        array = array.fill_null("")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(array.type)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets
