"""Benchmark decontamination by suffix arrays of the training texts.

Every shard of training texts (an Arrow batch) gets a suffix array over its words, ordered as deep as one window and
restricted to suffixes that begin with a benchmark word (no other suffix can match). Each test suffix is binary-searched
in it: the range found holds all verbatim occurrences with their locations. Occurrences that follow each other form
passages; equal passages of a shard are compared with the items once, where windows on one diagonal join into longest
matches, so a passage's repeats are never multiplied by the items that hold it. The training texts never move; only the index of the test items is broadcast, in
blocks of a checked size, and further blocks are tried in further passes over a written table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import FOLDED, fresh, hash_words, small_batches, text_buffers, written

_SHARD_BYTES, _SHARD_SUFFIXES = 4 << 20, 1 << 20
_MATCH = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<first:long,last:long>>,matches:array<struct<item_id:string,item_start:long,doc_start:long,n_words:long>>>"
_SPAN_T = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_MATCH_T = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())]))


class TestIndex:
    """The distinct windows of some benchmark items, as padded rows of word numbers, and where each occurs."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        offsets = np.cumsum([0] + [len(t.encode()) for _, t in items])
        hashes, item = hash_words(np.frombuffer("".join(t for _, t in items).encode(), np.uint8), offsets, FOLDED)
        self.vocab, ids = np.unique(hashes, return_inverse=True)
        self.names = [i for i, _ in items]
        self.bits = max(1, int(len(self.vocab) + 1).bit_length())
        words = np.bincount(item, minlength=len(items))
        many = np.where(words > 0, np.maximum(words - window + 1, 1), 0)  # windows of each item
        place_item = np.repeat(np.arange(len(items)), many)
        place_start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        base, length = (np.cumsum(words) - words)[place_item] + place_start, np.minimum(words[place_item], window)
        last = max(0, len(ids) - 1)
        column = lambda d, beyond: np.where(d < length, ids[np.minimum(base + d, last)] + 1 if len(ids) else 0, beyond).astype(np.uint64)
        low = self.pack(column(d, 0) for d in range(window))
        order = np.lexsort([place_start, place_item, *low[::-1]])
        low = [k[order] for k in low]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), np.logical_or.reduce([k[1:] != k[:-1] for k in low])]))
        self.at, self.length = np.append(first, len(order)), length[order][first]
        self.place_item, self.place_start = place_item[order], place_start[order]
        self.low = [k[first] for k in low]
        base, length = base[order][first], self.length
        self.high = self.pack(column(d, (1 << self.bits) - 1) for d in range(window))

    def pack(self, columns) -> list[np.ndarray]:
        """Word numbers, one column a depth, as few 64-bit keys that compare like the words in order."""
        each, keys = 64 // self.bits, []
        for k, c in enumerate(columns):
            if k % each == 0:
                keys.append(np.zeros(len(c), np.uint64))
            keys[-1] = (keys[-1] << np.uint64(self.bits)) | c
        return keys

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 1; 0 for words that no item has."""
        if not len(self.vocab):
            return np.zeros(len(hashes), np.uint64)
        k = np.searchsorted(self.vocab, hashes)
        k[k == len(self.vocab)] = 0
        return np.where(self.vocab[k] == hashes, k + 1, 0).astype(np.uint64)


def _bound(keys: list[np.ndarray], probes: list[np.ndarray], upper: bool) -> np.ndarray:
    """For each probe the first row of the sorted keys that isn't below it (upper: that is above it)."""
    lo, hi = np.zeros(len(probes[0]), np.int64), np.full(len(probes[0]), len(keys[0]), np.int64)
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(mid, len(keys[0]) - 1)
        below = np.full(len(mid), upper)
        for k, p in zip(reversed(keys), reversed(probes)):
            x = k[at]
            below = (x < p) | ((x == p) & below)
        below &= lo < hi
        lo, hi = np.where(below, mid + 1, lo), np.where(below, hi, np.minimum(hi, mid))
    return lo


def _occurrences(padded: np.ndarray, index: TestIndex) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of every verbatim occurrence, from suffix arrays of shards of the padded word numbers."""
    suffixes, found_w, found_p = np.flatnonzero(padded[: len(padded) - index.window]), [], []
    for k in range(0, len(suffixes), _SHARD_SUFFIXES):
        p = suffixes[k : k + _SHARD_SUFFIXES]
        keys = index.pack(padded[p + d] for d in range(index.window))
        order = np.lexsort(keys[::-1])  # the suffix array
        keys = [x[order] for x in keys]
        lo, hi = _bound(keys, index.low, False), _bound(keys, index.high, True)
        n = hi - lo
        w = np.repeat(np.arange(len(n)), n)
        found_w.append(w)
        found_p.append(p[order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(w))]])
    if not found_w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_w), np.concatenate(found_p)


def _shard(data: np.ndarray, offsets: np.ndarray, index: TestIndex) -> list[dict]:
    """n_words of each text, and for those with hits also n_hit, items, spans and matches."""
    hashes, doc = hash_words(data, offsets, FOLDED)
    n_docs, size = len(offsets) - 1, index.window
    words = np.bincount(doc, minlength=n_docs)
    out = [{"n_words": n} for n in words.tolist()]
    if not len(index.length) or not len(hashes):
        return out
    place = np.arange(len(doc)) + doc * size  # each text is followed by a window of zeros
    padded = np.zeros(len(doc) + (n_docs + 1) * size, np.uint64)
    padded[place] = index.number(hashes)
    w, p = _occurrences(padded, index)
    if not len(w):
        return out
    depth = np.zeros(len(padded) + 1, np.int64)
    np.add.at(depth, p, 1)
    np.add.at(depth, p + index.length[w], -1)
    covered = np.cumsum(depth) > 0
    first, last = np.flatnonzero(covered[:-1] & ~np.append(False, covered[:-2])), np.flatnonzero(covered[:-1] & ~covered[1:]) + 1
    start_of = np.searchsorted(doc, np.arange(n_docs)) + np.arange(n_docs) * size
    owner = np.searchsorted(start_of, first, side="right") - 1
    while (empty := words[owner] == 0).any():  # texts without words share their place with the next
        owner = owner - empty
    for d, a, b in zip(owner.tolist(), first.tolist(), last.tolist()):
        out[d].setdefault("spans", []).append({"first": a - int(start_of[d]), "last": b - int(start_of[d])})
    order = np.argsort(p, kind="stable")
    w, p = w[order], p[order]
    own = np.searchsorted(start_of, p, side="right") - 1
    while (empty := words[own] == 0).any():
        own = own - empty
    run, where, of = _passages(w, p, index)
    found: dict[int, list] = {}
    for r, i, s, at, n in _longest(run, index):
        found.setdefault(r, []).append((index.names[i], s, at, n))
    for r, at, d in zip(of.tolist(), p[where].tolist(), own[where].tolist()):
        seen = out[d].setdefault("passages", set())
        if r not in seen:  # a text's repeats of a passage are reported once, where the first stands
            seen.add(r)
            for name, s, k, n in found[r]:
                out[d].setdefault("matches", []).append({"item_id": name, "item_start": s, "doc_start": at + k - int(start_of[d]), "n_words": n})
    return out


def _passages(w: np.ndarray, p: np.ndarray, index: TestIndex) -> tuple[list, np.ndarray, np.ndarray]:
    """Distinct passages, each as (windows, their positions from its start), and for each passage found in occurrences
    ordered by position its first occurrence and the number of the distinct one that it equals. Passages end where no
    window stands at the next position."""
    where = np.flatnonzero(np.concatenate([[True], p[1:] > p[:-1] + 1]))
    ends = np.append(where[1:], len(p))
    known: dict[tuple, int] = {}
    distinct, of = [], []
    for a, b in zip(where.tolist(), ends.tolist()):
        key = (w[a:b].tobytes(), (p[a:b] - p[a]).tobytes())
        if key not in known:
            known[key] = len(distinct)
            distinct.append((w[a:b], p[a:b] - p[a]))
        of.append(known[key])
    return distinct, where, np.array(of, np.int64)


def _longest(passages: list, index: TestIndex):
    """(passage, item, start in the item, start in the passage, words) of the longest matches of each passage."""
    for r, (w, p) in enumerate(passages):
        many = index.at[w + 1] - index.at[w]
        k = np.repeat(index.at[w] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pos, item, start, length = np.repeat(p, many), index.place_item[k], index.place_start[k], np.repeat(index.length[w], many)
        order = np.lexsort((pos, pos - start, item))
        pos, item, start, length = pos[order], item[order], start[order], length[order]
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (pos[1:] != pos[:-1] + 1) | (start[1:] != start[:-1] + 1)])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(pos)) - 1
        for x in zip(item[a].tolist(), start[a].tolist(), pos[a].tolist(), (pos[b] + length[b] - pos[a]).tolist()):
            yield r, *x


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
        if out and s["first"] <= out[-1]["last"]:
            out[-1]["last"] = max(out[-1]["last"], s["last"])
        else:
            out.append(dict(s))
    return out


def _matches(texts: pa.Array, before: list | None, index: TestIndex) -> pa.Array:
    data, offsets = text_buffers(texts)
    rows, k = [], 0
    while k < len(texts):
        to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + _SHARD_BYTES, side="right")) - 1)
        rows += _shard(data, offsets[k : to + 1], index)
        k = to
    if before is not None:
        for r, b in zip(rows, before):
            r["spans"] = (r.get("spans") or []) + b["spans"]
            r["matches"] = (r.get("matches") or []) + b["matches"]
    spans = [_merged(r.get("spans") or []) for r in rows]
    matches = [sorted(r.get("matches") or [], key=lambda m: (m["doc_start"], m["item_id"], m["item_start"])) for r in rows]
    return pa.StructArray.from_arrays(
        [
            pa.array([r["n_words"] for r in rows], pa.int64()),
            pa.array([sum(s["last"] - s["first"] for s in x) for x in spans], pa.int64()),
            pa.array([sorted({m["item_id"] for m in x}) for x in matches], pa.list_(pa.string())),
            pa.array(spans, _SPAN_T),
            pa.array(matches, _MATCH_T),
        ],
        names=["n_words", "n_hit", "items", "spans", "matches"],
    )


def with_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, into: str = "match", block_words: int = 1_000_000) -> DataFrame:
    """docs with a struct column `into`: n_words, n_hit, items (sorted strings), spans and longest matches.

    Words: A-Z lower-cased, then runs of digits, letters and all beyond ASCII. A window is `window` consecutive words of
    an item; an item of fewer words, but not none, is one window. Items with null id or text take no part; repeated
    items count once by id; null and empty texts have no words and no hits; all rows and columns of docs are kept; an
    empty table of either kind works. A passage that a text repeats is matched where it stands first (n_hit and spans count
    all its places). Blocks of about `block_words` benchmark words are broadcast at a time, with the table written in
    between. A column of docs named `into` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null")
    blocks = 1 + int(items.agg(F.sum(F.length("text") / 2)).first()[0] or 0) // block_words
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text", "item"), F.lit(blocks)) == k)
        index = spark.sparkContext.broadcast(TestIndex([(r.item, r.text) for r in part.collect()], window))
        if k == 0:
            match: Column = F.arrow_udf(_one(index), _MATCH)(F.col(text_col).cast("string"))
        else:
            docs = written(docs, "match")
            match = F.arrow_udf(_next(index), _MATCH)(F.col(text_col).cast("string"), F.col(into))
        docs = docs.withColumn(into, match)
    return docs


def _one(index):
    def find(texts: pa.Array) -> pa.Array:
        return _matches(texts, None, index.value)

    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return find


def _next(index):
    def find(texts: pa.Array, before: pa.Array) -> pa.Array:
        return _matches(texts, before.to_pylist(), index.value)

    find.__annotations__ = {"texts": pa.Array, "before": pa.Array, "return": pa.Array}
    return find


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those that hold a window of a benchmark item; see with_matches. All columns are kept, whatever their
    names."""
    match = fresh(docs, "match")
    return with_matches(docs, benchmark, into=match, **how).where(F.col(match)["n_hit"] == 0).select(*docs.columns)
