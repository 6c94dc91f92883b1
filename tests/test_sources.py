"""Readers and writers on small files."""

import zipfile

import pytest

from loomgraph.sources import readers as R


def test_roster_keeps_quotes_and_skips_comments(spark, tmp_path):
    p = tmp_path / "nodes.tsv"
    p.write_text('# frozen snapshot 2024\nnode_id\tname\tdescription\nA_b\tA b\tsaid "hi\nC\tC\t\n')
    rows = {r.node_id: r for r in R.read_nodes(spark, str(p)).collect()}
    assert rows["A_b"].description == 'said "hi' and rows["C"].description is None
    assert R.snapshot_line(spark, str(p)) == "frozen snapshot 2024"
    with pytest.raises(ValueError, match="era"):
        R.read_nodes(spark, str(p), ("node_id", "era"))


def test_edges(spark, tmp_path):
    p = tmp_path / "edges.tsv"
    p.write_text("source\ttarget\tweight\na\tb\t3\n# note\nb\tc\t1\n")
    assert [tuple(r) for r in R.read_weighted_edges(spark, str(p)).collect()] == [("a", "b", 3), ("b", "c", 1)]
    q = tmp_path / "plain.tsv"
    q.write_text("a\tb\nb\tc\n")
    assert R.read_edges(spark, str(q)).count() == 2


def test_corpus_folder_and_zip(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for name in ("A%2Fb.txt", "README.txt", "C.txt"):
        (tmp_path / "c" / name).write_text(f"text of {name}\nline")
    got = {r.doc_id: r.text for r in R.read_corpus(spark, str(tmp_path / "c")).collect()}
    assert got == {"A/b": "text of A%2Fb.txt\nline", "C": "text of C.txt\nline"}
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        for f in (tmp_path / "c").iterdir():
            z.write(f, f.name)
    assert {r.doc_id: r.text for r in R.read_corpus_zip(spark, str(tmp_path / "c.zip")).collect()} == got


def test_attribute_maps_and_artefacts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"note": 1,\n "teamOf": {"x": "T1", "y": "T2"}, "movements": {"q": ["m1", "m2"]}}')
    assert {tuple(r) for r in R.read_attr_map(spark, str(tmp_path / "a.json"), "teamOf").collect()} == {("x", "T1"), ("y", "T2")}
    assert {tuple(r) for r in R.read_attr_multimap(spark, str(tmp_path / "a.json"), "movements").collect()} == {("q", "m1"), ("q", "m2")}
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for fresh in (False, False, True):
        assert R.artefact(spark, str(tmp_path), "n", "k", make, fresh).count() == 3
    assert len(made) == 2
    R.write_json(spark.createDataFrame([("é", 1)], "a string, b int"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":"é","b":1}'


def test_archives_grow_in_number_with_the_corpus(spark, tmp_path, monkeypatch):
    """A task holds an archive: with twice the text there are twice as many, none is larger."""
    monkeypatch.setattr(R, "ARCHIVE_CHARS", 1000)
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('word ', 20) as text")
    R.write_corpus_zip(docs, f"file://{tmp_path}/zips")
    assert 30 <= len(list((tmp_path / "zips").glob("*.zip"))) <= 40
    assert {(x.doc_id, x.text) for x in R.read_corpus_zip(spark, f"file://{tmp_path}/zips/*.zip").collect()} == {(str(i), "word " * 20) for i in range(400)}
