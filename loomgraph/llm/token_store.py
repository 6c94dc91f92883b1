"""Token-ID output as wavelet matrices: one compressed file per shard, with access, counting and occurrence lookup.

Texts are dealt by ranges of ids and sorted, encoded, and cut into shards. A shard's ids become one succinct bit-plane
a level, each with its rank directory; a plane is decompressed when it is first asked. Files have names of their own for each attempt of a task and are
found through the written index table, so a repeated or lost task leaves at most an unused file.

File: b"LGWM", then a little-endian unsigned 32-bit header length, the header (JSON: n, bits, nulls, docs, and the length
of each section), and the sections, each compressed by zstd: deltas of the ids of documents, tokens of each document,
ones of each 512 bits of all planes, and the bit-planes from the highest bit down.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import hash_spans, new_path, open_uri, partitions, small_batches, written

_MAGIC = b"LGWM"
SHARD_TOKENS = 2_000_000
#: Pieces whose ids a worker keeps.
_CACHE = 500_000


class WaveletMatrix:
    """A sequence of unsigned integers as bit-planes from the highest bit down, each stably split by the one above.

    planes: bytes of each plane, or functions that give them when first asked; ranks: of each plane the ones before each
    512 bits, and their number last.
    """

    def __init__(self, planes: list, n: int, ranks: np.ndarray):
        self._planes, self.n, self.bits, self.ranks = list(planes), n, len(planes), ranks

    def plane(self, level: int) -> np.ndarray:
        if callable(self._planes[level]):
            self._planes[level] = np.frombuffer(self._planes[level](), np.uint8)
        return self._planes[level]

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        values = values.astype(np.uint16 if values.size == 0 or values.max() < 65536 else np.uint32)
        bits = max(1, int(values.max()).bit_length()) if values.size else 1
        planes = []
        for k in range(bits - 1, -1, -1):
            bit = (values & values.dtype.type(1 << k)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            values = np.concatenate([values[~bit], values[bit]])
        ones = np.zeros((bits, -(-len(planes[0]) // 64) * 64), np.uint8)
        ones[:, : len(planes[0])] = np.bitwise_count(np.stack(planes))
        ranks = np.zeros((bits, ones.shape[1] // 64 + 1), np.uint32)
        np.cumsum(ones.reshape(bits, -1, 64).sum(2, dtype=np.uint32), axis=1, out=ranks[:, 1:])
        return cls(planes, values.size, ranks)

    def values(self) -> np.ndarray:
        """The whole sequence, by undoing the splits from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for k in range(self.bits):
            bit = np.unpackbits(self.plane(self.bits - 1 - k), count=self.n, bitorder="little").view(bool)
            ones = np.flatnonzero(bit)
            zeros = self.n - len(ones)
            back = np.empty(self.n, kind)
            back[~bit] = out[:zeros]
            back[ones] = out[zeros:] | kind(1 << k)
            out = back
        return out

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane: the directory's, and those of at most 512 bits more."""
        plane, block, byte = self.plane(level), i >> 9, i >> 3
        count = int(self.ranks[level, block]) + int(np.bitwise_count(plane[block << 6 : byte]).sum(dtype=np.int64))
        return count + (int(plane[byte]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else count

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th such bit (from 0) of a plane: its 512 bits by the directory, and its place in them."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones), dtype=np.int64) * 512 - ones
        block = int(np.searchsorted(before[:-1], k, side="right")) - 1
        inside = np.unpackbits(self.plane(level)[block << 6 : (block + 1) << 6], bitorder="little") == bit
        return (block << 9) + int(np.flatnonzero(inside)[k - int(before[block])])

    def _zeros(self, level: int) -> int:
        return self.n - int(self.ranks[level, -1])

    def access(self, i: int) -> int:
        """The value at position i."""
        out = 0
        for level in range(self.bits):
            bit = int(self.plane(level)[i >> 3]) >> (i & 7) & 1
            ones = self._rank1(level, i)
            i = self._zeros(level) + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, value: int, i: int) -> tuple[int, int]:
        lo = 0
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, i)
            lo, i = (self._zeros(level) + a, self._zeros(level) + b) if value >> (self.bits - 1 - level) & 1 else (lo - a, i - b)
        return lo, i

    def rank(self, value: int, i: int) -> int:
        """How often value occurs before position i."""
        if value >> self.bits:
            return 0
        lo, hi = self._range(value, i)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0)."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        i = self._range(value, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit, zeros = value >> (self.bits - 1 - level) & 1, self._zeros(level)
            i = self._select(level, bit, i - zeros if bit else i)
        return i

    def find(self, value: int) -> list[int]:
        """All positions of a value."""
        return [self.select(value, k) for k in range(self.count(value))]


def shard_bytes(ids: np.ndarray, docs: np.ndarray, nulls: int, lengths: np.ndarray) -> bytes:
    """A shard file: token ids, document ids (ascending; the first `nulls` are null) and tokens of each document."""
    wm = WaveletMatrix.build(ids)
    press = zstandard.ZstdCompressor(level=1)
    sections = [press.compress(x) for x in (np.diff(docs, prepend=0).astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), np.diff(wm.ranks, axis=1).astype("<u2").tobytes(), *(wm.plane(k).tobytes() for k in range(wm.bits)))]
    head = json.dumps({"n": wm.n, "bits": wm.bits, "nulls": nulls, "docs": len(docs), "sections": [len(s) for s in sections]}).encode()
    return b"".join([_MAGIC, struct.pack("<I", len(head)), head, *sections])


class TokenShard:
    """A shard file opened for reading."""

    def __init__(self, raw: bytes):
        if raw[:4] != _MAGIC:
            raise ValueError("not a token shard")
        size = struct.unpack("<I", raw[4:8])[0]
        head, at, sections = json.loads(raw[8 : 8 + size]), 8 + size, []
        for n in head["sections"]:
            sections.append(functools.partial(zstandard.ZstdDecompressor().decompress, raw[at : at + n]))
            at += n
        self.docs, self.nulls = np.cumsum(np.frombuffer(sections[0](), "<i8")), head["nulls"]
        self.lengths = np.frombuffer(sections[1](), "<i8")
        self.tokens = WaveletMatrix(sections[3:], head["n"], np.cumsum(np.pad(np.frombuffer(sections[2](), "<u2").reshape(head["bits"], -1), ((0, 0), (1, 0))), axis=1, dtype=np.uint32))

    def doc_ids(self) -> list:
        return [None] * self.nulls + self.docs[self.nulls :].tolist()


def _classes() -> np.ndarray:
    """Of each byte: 0 white space, 1 letter (and all beyond ASCII), 2 digit, 3 other."""
    out = np.full(256, 3, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    out[48:58] = 2
    return out


_CLASS = _classes()


@functools.lru_cache(maxsize=1 << 16)
def _simple(c: str) -> bool:
    """A character that pieces can be cut at by its class alone: printable ASCII, white space, or a letter that is in
    composed form by itself, can't compose with others, and is lower-cased to one letter wherever it stands."""
    if c < "\x80":
        return " " <= c <= "~" or "\t" <= c <= "\r"
    low, o = c.lower(), ord(c)
    jamo = 0x1100 <= o < 0x1200 or 0xA960 <= o < 0xA980 or 0xD7B0 <= o < 0xD800
    return c not in "Σς" and not jamo and len(low) == 1 and unicodedata.category(c)[0] == "L" == unicodedata.category(low)[0] and unicodedata.is_normalized("NFC", c)


class Encoder:
    """Ids of whole texts.

    Where the tokenizer's own file says that it composes and lower-cases, drops white space, and cuts words into runs of
    letters, digits and runs of other characters (and English contractions), texts are cut here, vectorised, and only
    pieces not met before are encoded by the library, many in one call; the mark on each piece's last token tells their
    ids apart. Words with an apostrophe are encoded whole; so are texts with anything unusual in them, and all texts if
    the file says anything else. Pieces are known by 64-bit hashes.
    """

    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(), end_id + 1)
        self.kind = np.dtype("<u2" if size <= 65536 else "<u4")
        self.end = np.array([end_id], self.kind)
        spec = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        suffix = spec["model"].get("end_of_word_suffix")
        self.cuts = steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in cut] == ["Split", "ByteLevel"] and bool(suffix)
        self.cuts = self.cuts and bool(cut[0].get("invert")) and cut[0].get("behavior") == "Removed" and cut[0]["pattern"].get("Regex") == self.PATTERN and not cut[1].get("add_prefix_space")
        self.cuts = self.cuts and spec.get("post_processor") is None and all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))
        if self.cuts:
            self.last = np.zeros(size, bool)
            self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
            # for pieces that are cut, composed and lower-cased already: the same model without those steps
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self._forget()

    def _forget(self) -> None:
        self.row: dict[int, int] = {}
        self.start, self.length, self.ids, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.kind), 0

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        """Encode pieces, a hundred in one string, and words with an apostrophe by themselves."""
        whole = [i for i, t in enumerate(texts) if "'" in t]
        found: dict[int, np.ndarray] = dict(zip(whole, self._alone([texts[i] for i in whole])))
        rest = [i for i in range(len(texts)) if i not in found]
        parts = [rest[k : k + 100] for k in range(0, len(rest), 100)]
        flat, size = [], []
        for part, got in zip(parts, self.plain.encode_batch_fast([" ".join([texts[i] for i in p]) for p in parts], add_special_tokens=False)):
            ids = np.array(got.ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                each = self._alone([texts[i] for i in part])
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            flat.append(ids)
            size.append(np.diff(ends, prepend=0))
        for x in found.values():
            flat.append(x)
            size.append(np.array([len(x)]))
        ids, size = np.concatenate(flat), np.concatenate(size)
        n, m = len(self.row), len(size)
        while len(self.start) < n + m:
            self.start, self.length = np.append(self.start, np.zeros_like(self.start)), np.append(self.length, np.zeros_like(self.length))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.length[n : n + m] = size
        self.start[n : n + m] = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.row.update(zip([hashes[i] for i in (*rest, *whole)], range(n, n + m)))

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        raws = [t.lower().encode() for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raws])
        raw = b" ".join(raws) + b" "
        data = np.frombuffer(raw, np.uint8)
        kind = _CLASS[data]
        inside = kind > 0
        before, after = np.append(np.uint8(0), kind[:-1]), np.append(kind[1:], np.uint8(0))
        first = inside & ((kind != before) | (kind == 2))
        last = inside & ((kind != after) | (kind == 2))
        quotes = np.flatnonzero(data == 39)
        if len(quotes):  # words with an apostrophe stay whole
            spaces = np.flatnonzero(~inside)
            k = np.unique(np.searchsorted(spaces, quotes))
            for a, b in zip((np.append(-1, spaces)[k] + 1).tolist(), spaces[k].tolist()):
                first[a + 1 : b], last[a : b - 1] = False, False
                first[a] = last[b - 1] = True
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(starts):
            return [self.end] * len(texts)
        uniq, where, back = np.unique(hash_spans(data, starts, stops), return_index=True, return_inverse=True)
        keys = uniq.tolist()
        if len(self.row) > _CACHE:
            self._forget()
        row = np.fromiter(map(self.row.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(row < 0)
        if len(new):
            at, hashes = where[new], [keys[i] for i in new.tolist()]
            self._learn(hashes, [raw[a:b].decode() for a, b in zip(starts[at].tolist(), stops[at].tolist())])
            row[new] = np.fromiter(map(self.row.__getitem__, hashes), np.int64, len(new))
        row = row[back]
        size = self.length[row]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[row] - upto + size, size) + np.arange(upto[-1])]
        cuts = np.append(0, upto)[np.searchsorted(starts, ends)]
        return [np.append(ids[a:b], self.end) for a, b in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist())]

    def encode(self, texts: list) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        simple = [self.cuts and "<|" not in t and all(map(_simple, set(t))) for t in texts]
        cut = iter(self._cut([t for t, s in zip(texts, simple) if s]) if any(simple) else ())
        whole = iter(self._alone([t for t, s in zip(texts, simple) if not s]))
        return [next(cut) if s else np.append(next(whole), self.end) for s in simple]


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    """One for each worker process: its pieces serve all tasks that the process runs."""
    return Encoder(path, end_id)


_INDEX = "part int, seq int, file string, n_docs long, n_tokens long, n_bytes long"


def _write_shards(folder: str, tokenizer: str, end_id: int, limit: int):
    def run(batches):
        coder, part, seq = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        ids, docs, n = [], [], 0

        def flush():
            nonlocal ids, docs, n, seq
            file = f"{folder}/{part:06d}-{seq:05d}-{uuid.uuid4().hex[:8]}.lgwm"
            raw = shard_bytes(np.concatenate(ids), np.array([d or 0 for d in docs], np.int64), sum(d is None for d in docs), np.array([len(x) for x in ids]))
            with open_uri(file, "w") as f:
                f.write(raw)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([file]), pa.array([len(docs)], pa.int64()), pa.array([n], pa.int64()), pa.array([len(raw)], pa.int64())], names=["part", "seq", "file", "n_docs", "n_tokens", "n_bytes"])
            ids, docs, n, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(0, len(texts), 200):
                for key, x in zip(keys[k : k + 200], coder.encode(texts[k : k + 200])):
                    ids.append(x)
                    docs.append(key)
                    n += len(x)
                    if n >= limit:
                        yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write shard files in ascending id order; returns the written index (part, seq, file, n_docs, n_tokens, n_bytes).

    Null texts count as empty and give the end id alone; null ids come first; rows that share an id keep one entry each,
    ordered by the first 32 characters of their texts and dealt to several tasks if they are many; an empty table writes no
    file; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "tokens")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = docs.withColumns({"head": F.substring("text", 1, 32), "row": F.monotonically_increasing_id()}).repartitionByRange(partitions(spark), "doc_id", "head", "row")
    dealt = dealt.sortWithinPartitions("doc_id", "head", "text").select("doc_id", "text")
    return written(dealt.mapInArrow(_write_shards(folder, tokenizer, end_id, shard_tokens), _INDEX), "token-index")


def _read_shards(batches):
    for batch in batches:
        for r in batch.to_pylist():
            with open_uri(r["file"], "r") as f:
                shard = TokenShard(f.read())
            ids = shard.tokens.values().astype("<u4")
            ends = np.cumsum(shard.lengths)
            starts = ends - shard.lengths
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard.doc_ids(), pa.int64()),
                    pa.array(r["offset"] + starts, pa.int64()),
                    pa.array(shard.lengths, pa.int64()),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files of an index."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("all")).withColumn("before", F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    placed = index.withColumn("inside", inside).join(totals, "part").select("file", (F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("offset"))
    return placed.repartition(partitions(index.sparkSession), "file").mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")
