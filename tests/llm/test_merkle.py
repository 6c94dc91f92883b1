"""The manifest against a plain tree, with blocks so small that every group has several layers."""

import zlib
from hashlib import sha256

import pytest

from loomgraph.llm.merkle import dataset_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(i, source, lang, n, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k : k + 2]) for k in range(0, len(last), 2)])
    return levels


def way(levels, k):
    """(digests on the left, on the right) of each step."""
    out = []
    for level in levels[:-1]:
        run = level[k // 2 * 2 : k // 2 * 2 + 2]
        out.append((run[0] if k % 2 else "", run[1] if k % 2 == 0 and len(run) == 2 else ""))
        k //= 2
    return out


def plain_manifest(rows):
    leaves = [(leaf_of(i, s, g, n, t), (i, t, g, s, n)) for i, t, g, s, n in rows]
    langs = sorted({r[2] for _, r in leaves}, key=lambda g: (g is not None, (g or "").encode()))
    groups = {g: sorted([x for x in leaves if x[1][2] == g], key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])) for g in langs}
    trees = {g: tree([x for x, _ in groups[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for j, g in enumerate(langs):
        for k, (leaf, (i, t, _, s, n)) in enumerate(groups[g]):
            steps = way(trees[g], k) + way(top, j)
            bad = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
            now = leaf_of(i, s, g, n + 1, t) if bad else leaf
            for left, right in steps:
                now = h(left, now, right)
            root = top[-1][0]
            out.append((i, leaf, trees[g][-1][0], root, h(*[a + b for a, b in steps]), now, now == root))
    return sorted(out, key=str)


ROWS = [(k * 3 % 211, f"Text {k} ä\U0001f600", ("en", "de", "en", None, "en")[k % 5], None if k % 11 == 0 else f"s{k % 3}", None if k % 4 == 0 else k) for k in range(150)]
ROWS += [(None, None, None, None, None)] * 3 + [(7, "", "fr", "", 0)] * 4 + [(7, "x", "fr", "", 0), (9, "word " * 300_000, "x-lone", "a", 1)]


@pytest.mark.parametrize("block", [2, 12])
def test_manifest_equals_plain_trees(spark, block):
    rows = ROWS if block < 12 else ROWS[-40:]
    got = dataset_manifest(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA), block)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain_manifest(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_small_tables(spark):
    empty = dataset_manifest(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    one = dataset_manifest(spark.createDataFrame([(1, "a", "en", "s", 5, "", 0)], SCHEMA)).collect()[0]
    assert one.root == one.subroot == one.leaf and one.proof_sha256 == h("") and one.verified
