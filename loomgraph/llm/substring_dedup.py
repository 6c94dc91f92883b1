"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Each task hashes all windows of its texts with prefix sums of a polynomial modulo 2^64, combines equal hashes of one
chunk (only the smallest id of a chunk travels, so a passage that a third of all texts share costs one entry a chunk),
and deals them to buckets by the smallest hash of their short grams, which neighbouring windows mostly share: a text's
windows reach few buckets, so flags return in few rows. A first pass finds the grams that would fill a bucket by
themselves; windows round those are dealt by their own hashes over several buckets. The number of buckets grows with the windows,
so that a bucket holds about a million. For each hash the smallest id over
the whole corpus is found; every other text that holds the window gets it back as a flag. Flagged windows of a text
merge into maximal removal intervals.

Only packed hashes (about 8 bytes a window), flags, and each text once are shuffled. Two different windows of the corpus
are taken for equal if their 64-bit hashes and their grams' buckets are: under one in a thousand for a whole corpus of
10^8 windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import _WORD_BASE, PLAIN, hash_words, mix, partitions, powers, small_batches, text_buffers, written

#: Windows sorted together in a worker, and windows of a bucket; both bound a task whatever the input.
_CHUNK, _BUCKET = 1_000_000, 1_000_000


#: Words of the short grams whose smallest hash decides where a window is dealt.
_GRAM = 8


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` consecutive values, by doubling."""
    m, p = a, 1
    while 2 * p <= width:
        m, p = np.minimum(m[:-p], m[p:]), 2 * p
    n = len(a) - width + 1
    return np.minimum(m[:n], m[width - p : width - p + n])


def window_hashes(words: np.ndarray, docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every `size` consecutive words of one text: rolling hash, smallest hash of its short grams, and the word index at
    which it begins."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p, inv = powers(_WORD_BASE, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * p, out=total[1:])
    gram = min(_GRAM, size)
    least = _sliding_min(mix((total[gram:] - total[: n - gram + 1]) * inv[: n - gram + 1]), size - gram + 1)
    at = np.flatnonzero(docs[: n - size + 1] == docs[size - 1 :])
    return mix((total[at + size] - total[at]) * inv[at]), least[at], at


class Dealing:
    """Buckets of windows: by gram, and for grams that hold too many windows by the window's own hash as well."""

    def __init__(self, buckets: int, hot: list[tuple[int, int]]):
        """hot: (gram as a signed integer, buckets to spread it over)."""
        self.buckets, hot = buckets, sorted((g % (1 << 64), n) for g, n in hot)
        self.grams, self.spread = np.array([g for g, _ in hot], np.uint64), np.array([n for _, n in hot], np.uint64)

    def bucket(self, h: np.ndarray, gram: np.ndarray) -> np.ndarray:
        out = mix(gram) % np.uint64(self.buckets)
        if len(self.grams):
            k = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            at = np.flatnonzero(self.grams[k] == gram)
            out[at] = (out[at] + (h[at] >> np.uint64(20)) % self.spread[k[at]]) % np.uint64(self.buckets)
        return out.astype(np.int64)


def _planes(a: np.ndarray) -> bytes:
    """Byte planes: equal leading bytes of sorted values lie together, where the shuffle's compression removes them."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _pack(bucket: int, flag: bool, keys: np.ndarray, none: int, hashes: np.ndarray, index: np.ndarray) -> tuple:
    """A row: distinct keys (ids, ascending, then those of texts without id, from number `none` on), hashes (of flags as
    they are, else ascending, as differences), and for each hash the number of its key."""
    used, small = np.unique(index, return_inverse=True)
    small = small.astype(np.uint16 if len(used) <= 65536 else np.uint32)
    held = hashes if flag else np.diff(hashes, prepend=np.uint64(0))
    return bucket, flag, _planes(np.diff(keys[used], prepend=0)), int((used < none).sum()), _planes(held), _planes(small), small.itemsize


def _unpack(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, whether they are of texts without id, and hashes."""
    index = _unplanes(r["idx"], np.uint16 if r["width"] == 2 else np.uint32)
    h = _unplanes(r["hashes"], np.uint64)
    return np.cumsum(_unplanes(r["keys"], np.int64))[index], index >= r["ids"], h if r["flag"] else np.cumsum(h, dtype=np.uint64)


_PACKED = "bucket int, flag boolean, keys binary, ids int, hashes binary, idx binary, width int"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("flag", pa.bool_()), ("keys", pa.binary()), ("ids", pa.int32()), ("hashes", pa.binary()), ("idx", pa.binary()), ("width", pa.int32())])
_FLAGS = "none boolean, key long, hashes binary"


def _chunks(batches, size: int):
    """(hashes, grams, keys, whether without id) of the windows of some millions of words at a time."""
    held, n = [], 0
    for batch in batches:
        key, none = np.array(batch.column(0), np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        words, docs = hash_words(*text_buffers(batch.column(2)), PLAIN)
        h, gram, at = window_hashes(words, docs, size)
        if len(h):
            held.append((h, gram, key[docs[at]], none[docs[at]]))
            n += len(h)
        if n >= _CHUNK:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held)))


def _full_grams(size: int, share: float):
    """Grams that hold more than `share` of the windows of a chunk, with their number; gram null: windows of the chunk."""

    def run(batches):
        for h, gram, _, _ in _chunks(batches, size):
            gram, n = np.unique(gram, return_counts=True)
            much = n > share * len(h)
            yield pa.RecordBatch.from_arrays([pa.array([*gram[much].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[much].tolist(), len(h)], pa.int64())], names=["gram", "n"])

    return run


def _windows(dealing: Dealing, size: int):
    def run(batches):
        for h, gram, key, none in _chunks(batches, size):
            ids, lost = np.unique(key[~none]), np.unique(key[none])
            keys = np.concatenate([ids, lost])
            rank = np.where(none, len(ids) + np.searchsorted(lost, key), np.searchsorted(ids, key))
            order = np.lexsort((rank, h))
            h, gram, rank = h[order], gram[order], rank[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (rank[1:] != rank[:-1])])
            h, gram, rank = h[once], gram[once], rank[once]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            least = np.repeat(np.minimum(rank[first], len(ids)), np.diff(np.append(first, len(h))))
            later = np.minimum(rank, len(ids)) > least  # texts without id come last, none before another
            rows = []
            sure = np.flatnonzero(later)
            sure = sure[np.argsort(rank[sure], kind="stable")]
            for i in range(0, len(sure), 1 << 18):  # already certain: these only pass through, dealt evenly
                k = sure[i : i + (1 << 18)]
                rows.append(_pack(int(h[k[0]] % np.uint64(dealing.buckets)), True, keys, len(ids), h[k], rank[k]))
            h, gram, rank = h[~later], gram[~later], rank[~later]
            bucket = dealing.bucket(h, gram)
            order = np.argsort(bucket, kind="stable")
            h, rank, bucket = h[order], rank[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows.append(_pack(int(bucket[a]), False, keys, len(ids), h[a:b], rank[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PACKED_ARROW.types)], schema=_PACKED_ARROW)

    return run


def _first_holders(table: pa.Table) -> pa.Table:
    """Of one bucket: every (text, hash) whose hash a text with a smaller id holds too."""
    sure, open_ = [], []
    for r in table.to_pylist():
        (sure if r["flag"] else open_).append(_unpack(r))
    if open_:
        k, none, h = map(np.concatenate, zip(*open_))
        order = np.lexsort((k, none, h))
        k, none, h = k[order], none[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        later = np.where(none, ~np.repeat(none[first], size), k > np.repeat(k[first], size))
        sure.append((k[later], none[later], h[later]))
    k, none, h = map(np.concatenate, zip(*sure))
    order = np.lexsort((h, k, none))
    k, none, h = k[order], none[order], h[order]
    same = (k[1:] == k[:-1]) & (none[1:] == none[:-1])
    once = np.concatenate([[True], ~same | (h[1:] != h[:-1])]) if len(k) else np.zeros(0, bool)
    k, none, h = k[once], none[once], h[once]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (none[1:] != none[:-1])])) if len(k) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(k))
    return pa.table({"none": pa.array(none[first]), "key": pa.array(k[first], pa.int64()), "hashes": pa.array([h[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())})


_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _removed(size: int):
    def run(batches):
        for batch in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for text, flags in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode()
                words = raw.split()
                n_words.append(len(words))
                gone: list = []
                if flags:
                    h, docs = hash_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), PLAIN)
                    w, _, at = window_hashes(h, docs, size)
                    hit = at[np.isin(w, np.frombuffer(b"".join(flags), np.uint64))]
                    if len(hit):
                        edge = np.flatnonzero(np.diff(hit) > size)
                        first, last = hit[np.append(0, edge + 1)], hit[np.append(edge, len(hit) - 1)] + size
                        gone = list(zip(first.tolist(), last.tolist()))
                n_removed.append(sum(b - a for a, b in gone))
                for a, b in reversed(gone):
                    del words[a:b]
                kept.append(b" ".join(words).decode())
                spans.append([{"first": a, "last": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, _SPAN)],
                names=["doc_id", "n_words", "n_removed", "kept_text", "spans"],
            )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Remove every word covered by a `window` of words that also starts in a text with a smaller id.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space) and spans (maximal removal
    intervals [first, last) of word positions). Null and empty texts have no words and keep the empty text; a null id
    counts as larger than all others; rows that share an id never remove each other's words; an empty table gives no
    rows; columns other than the two named are ignored. Windows are judged on the input, not on what is left.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # flags of texts without id return by the text, so that no row gets those of all the others
    own = [F.coalesce("doc_id", F.xxhash64("text")).alias("key"), F.col("doc_id").isNull().alias("none")]
    keyed = docs.select(*own, "text")
    counts = keyed.mapInArrow(_full_grams(window, 1 / (8 * partitions(spark))), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    total = counts.where("gram is null").agg(F.sum("n")).first()[0] or 0
    buckets = max(2 * partitions(spark), -(-total // _BUCKET))
    much = max(1, total // (4 * buckets))
    full = counts.where("gram is not null").where(F.col("n") > much).collect()  # at most 4 a bucket
    dealing = Dealing(buckets, [(r.gram, min(buckets, 1 + 2 * r.n // much)) for r in full])
    packed = keyed.mapInArrow(_windows(dealing, window), _PACKED).repartition(buckets, "bucket")
    flags = packed.groupBy("bucket").applyInArrow(_first_holders, _FLAGS)
    flags = flags.groupBy("key", "none").agg(F.collect_list("hashes").alias("hashes"))
    joined = docs.select(*own, "doc_id", "text").join(flags, ["key", "none"], "left").select("doc_id", "text", "hashes")
    return joined.mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<first:long,last:long>>")
