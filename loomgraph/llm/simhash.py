"""SimHash near-duplicates with pivot distance tables.

Equal fingerprints collapse first. A pivot table alone would have to try every pair, so distinct fingerprints meet in
pigeonhole groups: of six bit blocks, any two fingerprints at three or fewer differing bits agree on three, so each is
dealt to twenty groups, one for each choice of three blocks. Within a group, Hamming distances to reference
fingerprints are tabulated once. Rows lie in the order of their distance to the first, so only neighbours on that line
are proposed; a pair is discarded as soon as one further coordinate differs by more than the threshold (triangle
inequality), and survivors are verified. A group that is one component already needs no further pairs, and leaves the
kernel as a spanning star, never as all its pairs. A group beyond `_GROUP` rows is put off and tried in a second pass as blocks against blocks, each a
task of its own, so nothing is capped.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh, partitions, small_batches, written
from loomgraph.operators.components import components

_BLOCKS = (11, 11, 11, 11, 10, 10)
_GROUP = 8192
#: Reference fingerprints; any set is valid, these are fixed so that runs agree.
PIVOTS = np.random.default_rng(20240607).integers(0, 1 << 64, 16, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text's 3-word shingles (repeats included), as an unsigned integer."""
    words = (text or "").encode().translate(None).lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - 2)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(2, len(words) - 1) :].tolist()
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # long texts in pieces
        h = np.fromiter((hashed(flat[a:b], 42) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)])), "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


def _keys(fp: str):
    """The twenty group keys of a fingerprint: the number of the choice above the 30 to 33 bits of its three blocks."""
    shift, parts = 0, []
    for width in _BLOCKS:
        parts.append(F.shiftrightunsigned(F.col(fp), shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        shift += width
    out = []
    for k, chosen in enumerate(itertools.combinations(range(len(_BLOCKS)), 3)):
        key = F.lit(k).cast("long")
        for c in chosen:
            key = F.shiftleft(key, _BLOCKS[c]).bitwiseOR(parts[c])
        out.append(key)
    return F.array(*out)


def _star_edges(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each row to the smallest row of its component, for pairs (a, b) of rows below n."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
        if not keep.any() and (label == before).all():
            break
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


#: Pairs tried at a time, and verified pairs held before they are folded into a spanning forest; both bound a worker.
_TRIED, _HELD = 1 << 17, 250_000


class _Pairs:
    """Verified pairs among rows of fingerprints, kept as a spanning forest; counts the pairs that it saw."""

    def __init__(self, fp: np.ndarray, bits: int, pivots: np.ndarray):
        self.fp, self.bits = fp, bits
        self.table = [np.bitwise_count(fp ^ p).astype(np.int8) for p in pivots]
        self.a, self.b = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.proposed = self.survived = self.verified = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.proposed += len(i)
        for column in self.table:
            near = np.abs(column[i] - column[j]) <= self.bits
            i, j = i[near], j[near]
        self.survived += len(i)
        near = np.bitwise_count(self.fp[i] ^ self.fp[j]) <= self.bits
        i, j = i[near].astype(np.int32), j[near].astype(np.int32)
        self.verified += len(i)
        self.a, self.b = np.concatenate([self.a, i]), np.concatenate([self.b, j])
        if len(self.a) > _HELD:
            self.fold()

    def fold(self) -> None:
        self.a, self.b = (x.astype(np.int32) for x in _star_edges(len(self.fp), self.a, self.b))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        return self.a, self.b

    def whole(self, group: np.ndarray) -> np.ndarray:
        """For each row whether its group (numbers that don't fall) is one component already, so needs no more pairs."""
        self.fold()
        label = np.arange(len(self.fp))
        label[self.a] = self.b
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(group)))
        return np.repeat(np.minimum.reduceat(label, first) == np.maximum.reduceat(label, first), size)


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("part", pa.int32())])


def _out(a, b, key=None, part=None) -> pa.RecordBatch:
    n = len(a)
    none = lambda t: pa.nulls(n, t)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()) if b is not None else none(pa.int64()), pa.array(key, pa.int64()) if key is not None else none(pa.int64()), pa.array(part, pa.int32()) if part is not None else none(pa.int32())],
        schema=_OUT,
    )


def _near_in_groups(bits: int, limit: int):
    """Rows (key, fp) sorted by key -> spanning edges (a, b), and for groups beyond `limit` rows (a = fp, key, part)."""

    def solve(key, fp):
        # rows of a group in the order of their distance to the first pivot: partners lie at most `bits` further on
        ring = np.bitwise_count(fp.view(np.uint64) ^ PIVOTS[0]).astype(np.int8)
        order = np.lexsort((ring, key))
        key, fp, ring = key[order], fp[order], ring[order]
        pairs, at, step = _Pairs(fp.view(np.uint64), bits, PIVOTS[1:]), np.arange(len(key), dtype=np.int32), 1
        while True:
            at = at[: np.searchsorted(at, len(key) - step)]
            at = at[(key[at] == key[at + step]) & (ring[at + step] - ring[at] <= bits)]
            if not len(at):
                break
            for k in range(0, len(at), _TRIED):
                pairs.add(at[k : k + _TRIED], at[k : k + _TRIED] + step)
            if step & (step - 1) == 0 and step >= 16:
                at = at[~pairs.whole(key)[at]]
            step += 1
        a, b = pairs.edges()
        return _out(fp[a], fp[b])

    def run(batches):
        held: list = []
        rows, open_key, put_off = 0, None, 0

        def take(last: bool):
            """Solve whole groups; the last group stays open unless it is final or too large."""
            nonlocal held, rows, open_key, put_off
            key, fp = np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            big = size > limit
            if open_key is not None and key[0] == open_key:
                big[0] = True
            open_key = None
            end = len(key) if last or big[-1] else first[-1]
            in_big = np.repeat(big, size)
            for g in np.flatnonzero(big):
                a, n = first[g], size[g]
                base = put_off if g == 0 else 0
                yield _out(fp[a : a + n], None, key[a : a + n], ((base + np.arange(n)) // limit).astype(np.int32))
                if g == len(size) - 1 and not last:
                    open_key, put_off = key[a], base + n
            if not big[-1] or last:
                put_off = 0
            shared = np.repeat(size > 1, size) & ~in_big
            shared[end:] = False
            if shared.any():
                yield solve(key[shared], fp[shared])
            held, rows = ([(key[end:], fp[end:])] if end < len(key) else []), len(key) - end

        for batch in batches:
            if len(batch):
                held.append((np.array(batch.column(0), np.int64), np.array(batch.column(1), np.int64)))
                rows += len(batch)
            if rows > 2 * limit:
                yield from take(False)
        if rows:
            yield from take(True)

    return run


def _near_in_blocks(bits: int):
    """One pair of blocks of a large group: rows (part, fp) -> spanning edges between (or within) the two blocks."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table["part"]), kind="stable")
        part, fp = np.array(table["part"])[order], np.array(table["fp"])[order]
        n = int((part == part[0]).sum())
        left, right = (np.arange(n), np.arange(n, len(fp))) if n < len(fp) else (np.arange(n), np.arange(n))
        pairs = _Pairs(fp.view(np.uint64), bits, PIVOTS)
        if len(right) and table["i"][0].as_py() != table["j"][0].as_py() and n == len(fp):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        step = max(1, _TRIED // max(1, len(right)))
        for k in range(0, len(left), step):
            i, j = (x.ravel() for x in np.meshgrid(left[k : k + step], right, indexing="ij"))
            keep = i < j
            pairs.add(i[keep], j[keep])
        a, b = pairs.edges()
        return pa.table({"a": pa.array(fp[a], pa.int64()), "b": pa.array(fp[b], pa.int64())})

    return run


def near_fingerprints(prints: DataFrame, bits: int = 3, limit: int = _GROUP) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column fp) exactly as all links of `bits` or fewer bits do."""
    if bits > 3:
        raise ValueError("six blocks prove links of at most three differing bits")
    spark = prints.sparkSession
    dealt = prints.select(F.explode(_keys("fp")).alias("key"), "fp").repartition(partitions(spark), "key").sortWithinPartitions("key")
    found = written(dealt.mapInArrow(_near_in_groups(bits, limit), "a long, b long, key long, part int"), "near")
    edges = found.where("b is not null").select("a", "b")
    late = found.where("b is null").select("key", "part", F.col("a").alias("fp"))
    parts = late.groupBy("key").agg(F.max("part").alias("parts"))
    late = late.join(parts, "key").select(
        "key", "part", "fp",
        F.explode(F.sequence(F.lit(0), F.col("parts"))).alias("other"),
    ).select("key", "part", "fp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return edges.union(late.groupBy("key", "i", "j").applyInArrow(_near_in_blocks(bits), "a long, b long"))


def near_classes(prints: DataFrame, bits: int = 3) -> DataFrame:
    """The class of each distinct fingerprint (column fp): the smallest fingerprint that links reach from it."""
    linked = components(near_fingerprints(prints.select("fp"), bits), "a", "b")
    return prints.join(linked, prints.fp == linked.node, "left").select(*prints.columns, F.coalesce("component", "fp").alias("class"))


def _print_of(text_col: str):
    return F.arrow_udf(_fingerprints, "long")(F.col(text_col).cast("string"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3) -> DataFrame:
    """Near-duplicate components of texts by SimHash fingerprints that differ in `bits` (at most 3) or fewer bits.

    Returns doc_id, fingerprint (16 lower-case hex digits) and component_id (smallest id reachable), one row per input
    row. Null and texts without words have fingerprint zero and link like any other; null ids get the component of
    their fingerprint (null if no member has an id); repeated rows keep one row each; an empty table gives no rows;
    columns other than the two named are ignored.
    """
    small_batches(docs.sparkSession)
    docs = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), _print_of(text_col).alias("fp")), "fingerprints")
    classes = near_classes(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), bits)
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    found = docs.join(classes.join(least, "class").select("fp", "component_id"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3) -> DataFrame:
    """docs with one row of each component: that with the smallest id, rows without id last, ties to any one of them.

    Null and empty texts are one component, like any other; rows that share an id are rows of their own, so they go only
    if their texts are near copies; an empty table gives no rows; all columns are kept, whatever their names.
    """
    small_batches(docs.sparkSession)
    row, fp = fresh(docs, "row"), fresh(docs, "fp")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(fp, _print_of(text_col)), "near-rows")
    rows = keyed.select(F.col(fp).alias("fp"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), F.col(row).alias("row")).alias("first"))
    classes = near_classes(rows.groupBy("fp").agg(F.min("first").alias("first")), bits)
    kept = classes.groupBy("class").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return keyed.join(kept, row).select(*docs.columns)
