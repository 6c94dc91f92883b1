"""Merkle manifest of a dataset: a leaf a row, a tree a group, one root; inclusion proofs and their verification.

Leaves are hashed by Spark. Nodes of a group are cut into aligned blocks of 2^BLOCK consecutive places, whose levels an
embedded DuckDB computes in the task that holds the block: ordered string_agg and sha256 on the block's Arrow table. The
blocks' roots are the nodes of the next layer, until each group has one node; the groups' roots are one more tree. Proofs
go down again: a layer's proofs are joined to the blocks below as what lies outside of them. So a task holds one block,
whatever the size of a group, and layers grow with the logarithm of the table.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import partitions, written

#: Levels of a block: 4,096 nodes, about half a MB, are hashed at a time.
BLOCK = 12
#: Memory that the block engine of one worker may use.
ENGINE_MEMORY = "256MB"


@functools.lru_cache(maxsize=1)
def _engine():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": ENGINE_MEMORY})
    con.execute("SET enable_progress_bar = false")
    return con


def field(value: Column) -> Column:
    """A value as part of a leaf: `-` if null, else its length in UTF-8 bytes, `:` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values).cast("binary"), 256)


def _levels(size: int, block: int) -> int:
    """Levels that a block has: all up to one node in a group of one block, else those of a full block."""
    return (size - 1).bit_length() if size <= 1 << block else block


def _climb(con, levels: int) -> None:
    """Tables lv0 (from `block`: pos, node) to lv<levels>, each level from the one below."""
    con.execute("CREATE OR REPLACE TEMP TABLE lv0 AS SELECT pos, node FROM block")
    for k in range(levels):
        con.execute(f"CREATE OR REPLACE TEMP TABLE lv{k + 1} AS SELECT pos // 2 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM lv{k} GROUP BY 1")


_ROOTS = "grp string, pos long, size long, node string"


def _roots(block: int):
    def run(table: pa.Table) -> pa.Table:
        con, grp, size = _engine(), table["grp"][0].as_py(), table["size"][0].as_py()
        con.register("block", table.select(["pos", "node"]))
        levels = _levels(size, block)
        _climb(con, levels)
        pos, node = con.execute(f"SELECT pos, node FROM lv{levels}").fetchall()[0]
        con.unregister("block")
        return pa.table({"grp": [grp], "pos": pa.array([pos], pa.int64()), "size": pa.array([-(-size >> levels) if size > 1 << block else 1], pa.int64()), "node": [node]})

    return run


#: Of each node: the digests beside its way to the root, in order, for each step on which side of it they lie (L, R, or -
#: where its run has no other node), its group's root, and what its claim folds to.
_PROOFS = "grp string, pos long, id long, node string, sides string, beside string, subroot string, folded string"


def _proofs(block: int):
    """A block's nodes (pos, id, node, claim) and the proof of its root outside (sides, beside) -> their proofs, and what
    their claims fold to."""

    def run(table: pa.Table, outside: pa.Table) -> pa.Table:
        con, grp = _engine(), table["grp"][0].as_py()
        con.register("block", table.select(["pos", "id", "node", "claim"]))
        levels = _levels(table["size"][0].as_py(), block)
        _climb(con, levels)
        con.execute("CREATE OR REPLACE TEMP TABLE f AS SELECT pos, id, node, pos AS up, claim AS now, '' AS sides, '' AS beside FROM block")
        for k in range(levels):
            con.execute(
                f"CREATE OR REPLACE TEMP TABLE f AS SELECT f.pos, f.id, f.node, up // 2 AS up, sides || CASE WHEN s.node IS NULL THEN '-' WHEN up % 2 = 1 THEN 'L' ELSE 'R' END AS sides, beside || COALESCE(s.node, '') AS beside,"
                f" sha256(CASE WHEN up % 2 = 1 THEN COALESCE(s.node, '') || now ELSE now || COALESCE(s.node, '') END) AS now FROM f LEFT JOIN lv{k} s ON s.pos = xor(f.up, 1)"
            )
        sides, beside, subroot = (outside[c][0].as_py() for c in ("sides", "beside", "subroot")) if outside.num_rows else ("", "", None)
        at = 0
        for side in sides:
            other = f"'{beside[at : at + 64]}'" if side != "-" else "''"
            at += 64 * (side != "-")
            con.execute(f"CREATE OR REPLACE TEMP TABLE f AS SELECT * REPLACE (sha256({f'{other} || now' if side == 'L' else f'now || {other}'}) AS now) FROM f")
        out = con.sql(f"SELECT pos, id, node, sides || '{sides}' AS sides, beside || '{beside}' AS beside, now AS folded FROM f").to_arrow_table()
        con.unregister("block")
        same = lambda x: pa.array([x] * out.num_rows, pa.string())
        return pa.table({"grp": same(grp), "pos": out["pos"].cast("int64"), "id": out["id"].cast("int64"), **{c: out[c].cast("string") for c in ("node", "sides", "beside")}, "subroot": same(subroot), "folded": out["folded"].cast("string")})

    return run


def placed(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows (with a string grp) with pos, the place from 0 in its group by `order`, and size, the group's number of rows.

    Rows are dealt by ranges of (grp, order), so a large group lies in many partitions; one row a (partition, group)
    carries its count to the others.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), "grp", *order).sortWithinPartitions("grp", *order)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), name)
    by = dealt.groupBy("grp", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ahead = W.partitionBy("grp").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    by = by.select("grp", "_part", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(W.partitionBy("grp")).alias("size"))
    return dealt.join(by, ["grp", "_part"]).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_ahead")).alias("pos"), "size")


def _block_of(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("blk", F.shiftright("pos", block))


def _layer(nodes: DataFrame, block: int, name: str) -> DataFrame:
    """The roots of the blocks: (grp, pos, size, node), size now being the number of blocks of the group."""
    return written(_block_of(nodes.select("grp", "pos", "size", "node"), block).groupBy("grp", "blk").applyInArrow(_roots(block), _ROOTS), name)


def _layers(nodes: DataFrame, block: int, name: str) -> list[DataFrame]:
    """The layers above nodes, up to one node a group."""
    out = [_layer(nodes, block, name)]
    while not out[-1].where("size > 1").isEmpty():
        out.append(_layer(out[-1], block, name))
    return out


def _prove(nodes: DataFrame, outside: DataFrame, block: int) -> DataFrame:
    """Proofs of nodes, given those of their blocks' roots (grp, pos, sides, beside, subroot)."""
    extra = [F.col(c) if c in nodes.columns else F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("claim", "string"))]
    held = nodes.select("grp", "pos", "size", "node", *extra).withColumn("claim", F.coalesce("claim", "node"))
    above = outside.select("grp", F.col("pos").alias("blk"), "sides", "beside", "subroot")
    return _block_of(held, block).groupBy("grp", "blk").cogroup(above.groupBy("grp", "blk")).applyInArrow(_proofs(block), _PROOFS)


def manifest(leaves: DataFrame, block: int = BLOCK) -> DataFrame:
    """leaves (grp string, id long, leaf, claim) -> id, leaf, subroot, root, beside (the digests of its inclusion proof) and
    folded (what the claimed leaf, or the leaf where that is null, and the proof give).

    Groups are trees of their own, ordered by UTF-8 bytes under the root; in a group leaves ascend by id, null first, ties
    by leaf; equal leaves of one id keep a place each. An empty table gives no rows.
    """
    leaves = written(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves = written(placed(leaves, "leaves-dealt", F.asc_nulls_first("id"), "leaf", "row").withColumnRenamed("leaf", "node"), "leaves-placed")
    layers = _layers(leaves, block, "layer")
    groups = placed(layers[-1].select(F.lit("").alias("grp"), F.col("grp").alias("owner"), "node"), "groups-dealt", "owner")
    groups = written(groups, "groups-placed")
    tops = _layers(groups, block, "top")
    outside = leaves.sparkSession.createDataFrame([], "grp string, pos long, sides string, beside string, subroot string")
    for nodes in [*reversed(tops[:-1]), groups]:
        outside = written(_prove(nodes, outside, block), "top-proofs")
    outside = outside.join(groups.select("owner", "pos"), "pos").select(F.col("owner").alias("grp"), F.lit(0).cast("long").alias("pos"), "sides", "beside", F.col("node").alias("subroot"))
    for nodes in reversed(layers[:-1]):
        outside = written(_prove(nodes, outside, block), "proofs")
    root = tops[-1].select(F.col("node").alias("root"))  # one row
    return _prove(leaves, outside, block).crossJoin(F.broadcast(root)).select("id", F.col("node").alias("leaf"), "subroot", "root", "beside", "folded")


def dataset_manifest(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The Merkle manifest of documents by language, and a check of its proofs against tampered rows.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, one row an input row. A leaf is the digest of
    doc_id, source, lang, n_chars and text; nulls in any of them count as `-` (a null lang is a group of its own, the
    first). Rows whose crc32 of the id is divisible by 7 claim one more in n_chars; null n_chars and rows without id claim
    what they are. Within a language null ids come first, rows that share an id are ordered by leaf, and equal rows keep a
    leaf each. Empty and very long texts are leaves like others; an empty table gives no rows; columns other than the five
    are ignored.
    """

    def leaf(n_chars: Column) -> Column:
        return digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang")], field(n_chars), field(F.col("text")))

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("grp"), F.col("doc_id").cast("long").alias("id"), leaf(F.col("n_chars")).alias("leaf"),
        F.when(tampered & F.col("n_chars").isNotNull(), leaf(F.col("n_chars") + 1)).alias("claim"),
    )
    out = manifest(rows, block)
    proof = F.sha2(F.col("beside").cast("binary"), 256).alias("proof_sha256")
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof, F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _sql_field(name: str) -> str:
    return f"COALESCE(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def _sql_tree(name: str, source: str) -> str:
    """Levels k of the trees over source (grp, pos, node), up to one node a group."""
    return (
        f"{name}(k, grp, pos, n, node) AS (SELECT 0, grp, pos, COUNT(*) OVER (PARTITION BY grp), node FROM {source}"
        f" UNION ALL SELECT k + 1, grp, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY k, grp, pos // 2, n)"
    )


def _sql_fold(name: str, tree: str, source: str) -> str:
    """What claims in source (pk, grp, pos, now) fold to, step by step, and the digests beside the way."""
    both = "CASE WHEN w.pos % 2 = 1 THEN COALESCE(s.node, '') || now ELSE now || COALESCE(s.node, '') END"
    return (
        f"{name}(k, pk, grp, pos, now, beside) AS (SELECT 0, pk, grp, pos, now, '' FROM {source}"
        f" UNION ALL SELECT w.k + 1, pk, w.grp, w.pos // 2, sha256({both}), beside || COALESCE(s.node, '') FROM {name} w JOIN {tree} t ON t.k = w.k AND t.grp = w.grp AND t.pos = w.pos AND t.n > 1 LEFT JOIN {tree} s ON s.k = w.k AND s.grp = w.grp AND s.pos = xor(w.pos, 1))"
    )


#: CRC-32 of a decimal number, bit by bit.
_CRC = (
    "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT), lambda a, b:"
    " list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), 4294967295), 4294967295)"
)
_HEAD, _TAIL = " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang")), _sql_field("text")
MANIFEST_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, COALESCE('=' || lang, '-') AS grp, sha256({_HEAD} || {_sql_field("n_chars")} || {_TAIL}) AS leaf,
  CASE WHEN {_CRC} % 7 = 0 AND n_chars IS NOT NULL THEN sha256({_HEAD} || {_sql_field("(n_chars + 1)")} || {_TAIL}) END AS claim FROM documents),
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY grp, doc_id NULLS FIRST, leaf) AS pk, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, * FROM d),
l AS MATERIALIZED (SELECT grp, pos, leaf AS node FROM o),
{_sql_tree("t", "l")},
g AS MATERIALIZED (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, node, grp AS owner FROM t WHERE n = 1),
{_sql_tree("u", "g")},
c AS MATERIALIZED (SELECT pk, grp, pos, COALESCE(claim, leaf) AS now FROM o),
{_sql_fold("f", "t", "c")},
m AS MATERIALIZED (SELECT pk, f.grp AS lang_grp, now, beside FROM f WHERE k = (SELECT MAX(t.k) FROM t WHERE t.grp = f.grp)),
c2 AS MATERIALIZED (SELECT pk, '' AS grp, g.pos, now FROM m JOIN g ON owner = lang_grp),
{_sql_fold("h", "u", "c2")},
e AS (SELECT pk, now, beside FROM h WHERE k = (SELECT MAX(k) FROM u))
SELECT doc_id, leaf, g.node AS subroot, r.node AS root, sha256(m.beside || e.beside) AS proof_sha256, e.now AS folded_root, e.now = r.node AS verified
FROM o JOIN m USING (pk) JOIN e USING (pk) JOIN g ON g.owner = o.grp, (SELECT node FROM u WHERE n = 1) r"""
