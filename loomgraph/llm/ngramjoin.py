"""Jaccard similarity join on word shingles by vertical partitioning.

The n-grams of all sets have one global order (rare before frequent), which is cut into fragments; a set's n-grams in one
fragment are a segment. Overlaps of two segments are counted apart, one lane of fragments a row, and summed per pair.

Before that, equal sets become one, and sets that can have no partner leave: a partner holds at least four fifths of a
set's n-grams, so n-grams that no other set holds may be a fifth at most. That is counted on a part of the n-grams first
(those with small hashes), which most sets don't survive, and on all n-grams of the survivors then.

Which pairs are counted: two sets that link share an n-gram among the first floor(n / 5) + 1 of each in the global order.
Of all sets that hold one such n-gram (a posting), each is first paired with a leader only, the set with the fewest
n-grams of its own; links merge sets into components, and a posting that is one component needs no more pairs. Of the
others all pairs between different components are tried, in blocks, against an upper bound of their overlap: the sum over
fragments of the smaller segment's length. So a large group of near copies never emits all its pairs, and no link
between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import byte_table, hash_words, mix, partitions, small_batches, text_buffers, written
from loomgraph.operators.components import components

#: Words are runs of all but space and \x09-\x0D, A-Z as a-z; NUL is an ordinary character and takes the value of A.
WORDS = byte_table(bytes(b for b in range(1, 256) if b != 0x20 and not 9 <= b <= 13), lower=True)
WORDS[0] = 65
#: Words of a shingle.
WIDTH = 5
#: Fragments of the global order, and lanes of fragments that are counted apart.
FRAGMENTS, LANES = 64, 8
#: The n-grams counted first: those with hashes in this share of their range.
FIRST = np.uint64(3 * ((1 << 64) // 10))
#: N-grams that a task holds before it deals them out, and members of a posting tried in one block.
_CHUNK, _BLOCK = 1_000_000, 2048
#: Bits of the filter of surviving sets.
_BITS = 1 << 26
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; of fewer words than WIDTH, of the whole sequence."""
    words, docs = hash_words(data, offsets, WORDS)
    n = len(offsets) - 1
    first = np.searchsorted(docs, np.arange(n + 1))
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
        for k in range(WIDTH):
            full = full * _STEP + words[k : k + len(full)]
        full = mix(full)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= WIDTH:
                out.append(np.unique(full[a : b - WIDTH + 1]))
            elif b > a:
                h = np.zeros(1, np.uint64)
                for w in words[a:b]:
                    h = h * _STEP + w
                out.append(mix(h + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """A 64-bit key of a set of hashes."""
    with np.errstate(over="ignore"):
        return int(mix(mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s))).view(np.int64)[0])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (doc_id, key, n, n_first)."""
    for batch in batches:
        sets = shingle_sets(*text_buffers(batch.column(1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(np.searchsorted(s, FIRST)) for s in sets], pa.int64())], names=["doc_id", "key", "n", "n_first"]
        )


def _new_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Keys and sets of texts (the last column), each set once a task."""
    seen: set[int] = set()
    for batch in batches:
        for s in shingle_sets(*text_buffers(batch.column(batch.num_columns - 1))):
            if len(s) and (key := set_key(s)) not in seen:
                seen.add(key)
                yield key, s


def _dealt(parts: int):
    """Texts -> for each part of the n-grams (part, grams, owners, tallies). Grams that several sets of a chunk hold are sent
    once, without an owner, and counted for their owners here; such counts have no gram."""

    def flush(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        grams = np.concatenate([s for _, s in held])
        owners = np.repeat(np.array([k for k, _ in held], np.int64), [len(s) for _, s in held])
        order = np.argsort(grams, kind="stable")
        grams, owners = grams[order], owners[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        size = np.diff(np.append(first, len(grams)))
        again = np.repeat(size > 1, size)
        known, tally = np.unique(owners[again], return_counts=True)
        grams, owners = grams[first], np.where(size > 1, 0, owners[first])
        part, to = (grams % np.uint64(parts)).astype(np.int64), known % parts
        a, b = np.argsort(part, kind="stable"), np.argsort(to, kind="stable")
        cuts, ends = np.searchsorted(part[a], np.arange(parts + 1)), np.searchsorted(to[b], np.arange(parts + 1))
        for p in range(parts):
            g, k = a[cuts[p] : cuts[p + 1]], b[ends[p] : ends[p + 1]]
            if len(g) or len(k):
                blobs = [x.tobytes() for x in (grams[g], owners[g], known[k], tally[k])]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], names=["part", "grams", "owners", "known", "tally"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for key, s in _new_sets(batches):
            s = s[: np.searchsorted(s, FIRST)]
            if len(s):
                held.append((key, s))
                n += len(s)
            if n > _CHUNK:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _blobs(table: pa.Table):
    return lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)


def _shared(parts: int):
    """One part -> rows (part, keys, tallies), one for each part of the keys: how many of a set's grams another set holds
    too. A row for each (part of the grams, key) would be more than one for each set."""

    def run(table: pa.Table) -> pa.Table:
        keys, tally = _held_twice(table)
        u, at = np.unique(keys, return_inverse=True)
        n, to = np.bincount(at, tally, len(u)).astype(np.int64), u % parts
        order = np.argsort(to, kind="stable")
        u, n, cuts = u[order], n[order], np.searchsorted(to[order], np.arange(parts + 1))
        full = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        blob = lambda x: pa.array([x[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary())
        return pa.table({"part": pa.array(full, pa.int32()), "keys": blob(u), "tallies": blob(n)})

    return run


def _summed(table: pa.Table) -> pa.Table:
    """One part of the keys -> (key, tally)."""
    blob = _blobs(table)
    u, at = np.unique(blob("keys", np.int64), return_inverse=True)
    return pa.table({"key": pa.array(u, pa.int64()), "tally": pa.array(np.bincount(at, blob("tallies", np.int64), len(u)).astype(np.int64))})


def _held_twice(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of their grams that another set holds; a key may come again."""
    blob = _blobs(table)
    grams, owners = blob("grams", np.uint64), blob("owners", np.int64)
    order = np.argsort(grams, kind="stable")
    grams, owners = grams[order], owners[order]
    keys, tally = blob("known", np.int64), blob("tally", np.int64)
    if len(grams):
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        several = (np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first)) | (np.minimum.reduceat(np.abs(np.sign(owners)), first) == 0)
        found = owners[np.repeat(several, np.diff(np.append(first, len(grams)))) & (owners != 0)]
        keys, tally = np.concatenate([keys, found]), np.concatenate([tally, np.ones(len(found), np.int64)])
    return keys, tally


def _places_of(key: int) -> tuple[int, int]:
    return key & (_BITS - 1), (key >> 26) & (_BITS - 1)


def _bitmap(table: pa.Table) -> pa.Table:
    """Places of one chunk of the filter -> the chunk."""
    bits = np.zeros(1 << 16, np.uint8)
    bits[np.asarray(table["place"]) & 0xFFFF] = 1
    return pa.table({"chunk": pa.array([table["place"][0].as_py() >> 16], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of keys in _BITS bits (8 MB, whatever their number): with very many keys it lets more pass."""
    place = F.explode(F.array(F.col("key").bitwiseAND(_BITS - 1), F.shiftright("key", 26).bitwiseAND(_BITS - 1))).alias("place")
    places = keys.select(place).distinct().withColumn("chunk", F.shiftright("place", 16))
    bits = np.zeros(_BITS // 8, np.uint8)
    for r in places.groupBy("chunk").applyInArrow(_bitmap, "chunk long, bits binary").collect():  # at most _BITS / 2^16 rows
        bits[r.chunk << 13 : (r.chunk + 1) << 13] = np.frombuffer(r.bits, np.uint8)
    return bits


def _grams(held):
    """Texts -> (key, n, grams) of the sets whose keys the filter lets pass, each set once a task."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for key, s in _new_sets(batches):
            if all(bits[p >> 3] >> (p & 7) & 1 for p in _places_of(key)):
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([len(s)], pa.int64()), pa.array([s.view(np.int64)], kind)], names=["key", "n", "grams"])

    return run


def suspects(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, n, grams) of the sets (key, n, n_first) that may have a partner, by the n-grams counted first.

    docs (doc_id, text) is read twice: to count, and for the n-grams of the surviving sets. A filter of fixed size lets
    their texts' n-grams and few others leave the second pass; the join by key decides.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    dealt = docs.select("text").mapInArrow(_dealt(parts), "part int, grams binary, owners binary, known binary, tally binary")
    tallies = dealt.groupBy("part").applyInArrow(_shared(parts), "part int, keys binary, tallies binary")
    tallies = tallies.groupBy("part").applyInArrow(_summed, "key long, tally long")
    left = sets.join(tallies, "key", "left").where(5 * (F.col("n_first") - F.coalesce("tally", F.lit(0))) <= F.col("n")).select("key")
    left = written(left, "survivors")
    held = spark.sparkContext.broadcast(key_filter(left))
    found = docs.select("text").mapInArrow(_grams(held), "key long, n long, grams array<long>")
    out = written(found.join(left, "key", "left_semi").dropDuplicates(["key"]), "suspects")
    held.unpersist()
    return out


def _place(df_col: str, gram: str) -> Column:
    """A double that ascends along the global order: by the number of sets that hold an n-gram, then by its hash."""
    return F.col(df_col) + (F.col(gram).cast("double") / float(1 << 64) + 0.5)


def _cut(pivots: list[float]):
    """(key, n, grams (held, gram) in global order) -> its prefix, its n-grams and the lengths of its segments."""
    edges = np.array(pivots)
    many, each = pa.list_(pa.int64()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, rows = np.asarray(batch["grams"].offsets), batch["grams"].flatten()
            base = offsets[0]
            held, gram = np.asarray(rows.field("held")), np.asarray(rows.field("gram"))
            frag = np.searchsorted(edges, held + (gram / float(1 << 64) + 0.5), side="right")
            prefix, grams, lens = [], [], []
            for n, a, b in zip(batch["n"].to_pylist(), (offsets[:-1] - base).tolist(), (offsets[1:] - base).tolist()):
                own = n - (b - a)  # its n-grams that no other set holds come first in the order
                prefix.append(gram[a : min(b, a + n // 5 + 1 - own)])
                grams.append(gram[a:b])
                lens.append(np.bincount(frag[a:b], minlength=FRAGMENTS).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["n"], pa.array(prefix, many), pa.array(grams, many), pa.array(lens, each)], names=["key", "n", "prefix", "grams", "lens"])

    return run


def segmented(found: DataFrame) -> DataFrame:
    """(key, n, prefix, grams, lens): of the sets (key, n, grams) that share enough n-grams, those n-grams in the global
    order, the first of them, and how many lie in each fragment."""
    spark = found.sparkSession
    rows = found.select("key", F.explode("grams").alias("gram"))
    held = rows.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1")
    shared = written(rows.join(held, "gram"), "shared-grams")
    pivots = shared.select(_place("held", "gram").alias("p")).approxQuantile("p", [k / FRAGMENTS for k in range(1, FRAGMENTS)], 0.002)
    lists = shared.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("held", "gram"))).alias("grams"))
    lists = lists.join(found.select("key", "n"), "key").where(5 * (F.col("n") - F.size("grams")) <= F.col("n"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    out = written(lists.select("key", "n", "grams").mapInArrow(_cut(sorted(pivots)), "key long, n long, prefix array<long>, grams array<long>, lens array<int>"), "segments")
    small_batches(spark)
    return out


def _possible(a: str, b: str) -> Column:
    """Whether sets of these sizes can link at all: the larger is at most 5 / 4 of the smaller."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of keys those whose sets link. Each lane of fragments is counted in a row of its own."""
    per = FRAGMENTS // LANES
    ahead = F.transform(F.sequence(F.lit(0), F.lit(LANES)), lambda k: F.aggregate(F.slice("lens", 1, k * per), F.lit(0), lambda x, y: x + y))
    lanes = sets.withColumn("_at", ahead).select(
        "key", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: F.slice("grams", F.get("_at", k) + 1, F.get("_at", k + 1) - F.get("_at", k)))).alias("lane", "part")
    )
    left = pairs.join(lanes.select(F.col("key").alias("a"), F.col("n").alias("na"), "lane", F.col("part").alias("pa")), "a")
    both = left.join(lanes.select(F.col("key").alias("b"), F.col("n").alias("nb"), "lane", F.col("part").alias("pb")), ["b", "lane"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("c"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    return total.where(100 * F.col("c") >= 80 * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")


_POSTING = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, i, j, block, key, n, component, lens) sorted by their block pair -> pairs that the bound lets pass."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        group = np.stack([np.asarray(rows[c]).astype(np.int64) for c in ("gram", "i", "j")])
        new = np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)])
        group = np.cumsum(new)
        block, key, n, comp = (np.asarray(rows[c]).astype(np.int64) for c in ("block", "key", "n", "component"))
        alone = np.asarray(rows["i"]) == np.asarray(rows["j"])
        lens = np.asarray(rows["lens"].combine_chunks().flatten()).reshape(-1, FRAGMENTS)
        left, right, at, step = [], [], np.arange(len(key)), 1
        while True:
            at = at[: np.searchsorted(at, len(key) - step)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            a, b = at, at + step
            low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            ok = (comp[a] != comp[b]) & (5 * low >= 4 * high) & (alone[a] | (block[a] != block[b]))
            a, b = a[ok], b[ok]
            for k in range(0, len(a), 1 << 15):
                x, y = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
                most = np.minimum(lens[x], lens[y]).sum(axis=1, dtype=np.int64)
                ok = 180 * most >= 80 * (n[x] + n[y])
                left.append(np.minimum(key[x[ok]], key[y[ok]]))
                right.append(np.maximum(key[x[ok]], key[y[ok]]))
            step += 1
        pairs = np.unique(np.stack([np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=_POSTING)

    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if len(held) > 4 * _BLOCK:
            whole = np.stack([np.asarray(held[c]).astype(np.int64) for c in ("gram", "i", "j")])
            cut = int(np.flatnonzero((whole != whole[:, -1:]).any(axis=0))[-1:].sum() + 1) if (whole != whole[:, -1:]).any() else 0
            if cut:
                yield solve(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None and len(held):
        yield solve(held)


def _postings(sets: DataFrame, component: DataFrame) -> DataFrame:
    """(gram, key, n, component) of prefixes."""
    rows = sets.join(component, "key", "left").select("key", "n", F.coalesce("component", "key").alias("component"), "prefix", (F.col("n") - F.size("grams")).alias("own"))
    return rows.select(F.explode("prefix").alias("gram"), "key", "n", "component", "own")


def _open(postings: DataFrame, *rank: Column) -> DataFrame:
    """Postings of more than one component: their size and their leader, the first by `rank`."""
    by = postings.groupBy("gram").agg(F.count("*").alias("size"), F.min("component").alias("_low"), F.max("component").alias("_high"), F.min(F.struct(*rank, "key", "n", "component")).alias("lead"))
    return by.where("_low <> _high").select("gram", "size", "lead")


def _with_leaders(postings: DataFrame, leaders: DataFrame) -> DataFrame:
    x = postings.join(leaders, "gram").where((F.col("component") != F.col("lead.component")) & _possible("n", "lead.n"))
    return x.select(F.least("key", "lead.key").alias("a"), F.greatest("key", "lead.key").alias("b")).distinct()


def _between_components(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of open postings between different components that the bound lets pass."""
    spark = sets.sparkSession
    rows = postings.join(_open(postings, F.lit(0)).select("gram", "size"), "gram").withColumn("_blocks", F.ceil(F.col("size") / _BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), "_blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rows = rows.select("gram", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "n", "component").join(sets.select("key", "lens"), "key")
    order = ["gram", "i", "j"]
    dealt = rows.select(*order, "block", "key", "n", "component", "lens").repartition(partitions(spark), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_tries, "a long, b long").distinct()


def set_components(sets: DataFrame) -> DataFrame:
    """(key, component) of the segmented sets that link to another."""
    none = sets.sparkSession.createDataFrame([], "key long, component long")
    links, found, step = None, none, 0
    while True:
        postings = _postings(sets, found)
        rank = [(F.col("own") / F.col("n")).alias("own")] if step == 0 else [F.xxhash64(F.lit(step), "key").alias("draw")]
        pairs = written(_with_leaders(postings, _open(postings, *rank)), f"led-{step}")
        new = written(linked_pairs(pairs, sets), f"links-{step}")
        links, step = new if links is None else links.union(new), step + 1
        found = written(components(links, "a", "b").withColumnRenamed("node", "key"), f"components-{step}")
        if 4 * new.count() < pairs.count() or pairs.isEmpty():
            break  # leaders no longer merge much: the rest is tried between components
    rest = written(_between_components(_postings(sets, found), sets), "rest")
    links = links.union(written(linked_pairs(rest, sets), "links-rest"))
    return written(components(links, "a", "b").withColumnRenamed("node", "key"), "components")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of distinct 5-word shingles have a Jaccard index of 0.8 or more.

    Returns doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included), one row an input row.
    Null texts and texts without words have no shingles and are their own components; texts of fewer words than five have
    one shingle, their words. Equal sets are one class, however many documents hold it. Null ids get the smallest id of
    their component, null if it has none; rows that share an id are linked by their texts only; an empty table gives no
    rows; a text may be as long as a task's memory holds its hashes; columns other than the two are ignored. Shingles and
    sets are compared by 64-bit hashes, which are not verified by text.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(docs.mapInArrow(_profiles, "doc_id long, key long, n long, n_first long"), "profiles")
    sets = rows.where("n > 0").groupBy("key", "n", "n_first").agg(F.min("doc_id").alias("least"))
    found = set_components(segmented(suspects(docs, sets)))
    owner = sets.join(found, "key", "left").select("key", "least", F.coalesce("component", "key").alias("component"))
    least = owner.groupBy("component").agg(F.min("least").alias("component_id"))
    named = owner.join(least, "component").select("key", "component_id")
    out = rows.where("n > 0").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(rows.where("n = 0").select("doc_id", "n", "doc_id"))


JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(ws[p + 1 : p + 5], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(GREATEST(len(ws) - 4, 1))) AS p FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
k AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(id, x) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.x),
m AS (SELECT id, MIN(x) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.id = w.doc_id"""
