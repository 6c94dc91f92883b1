"""Readers and writers: node rosters, edge lists, corpora, attribute maps, JSON results and written artefacts."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from collections.abc import Callable
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, or a ValueError that lists the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df


def _tsv(spark: SparkSession):
    """Tab-separated, lines that begin with # are comments, quotes are ordinary characters."""
    return spark.read.option("sep", "\t").option("comment", "#").option("quote", "").option("escape", "")


def read_nodes(spark: SparkSession, path: str, required: tuple[str, ...] = ("node_id", "name")) -> DataFrame:
    """A roster with a header line."""
    return require_columns(_tsv(spark).option("header", True).csv(path), *required)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Two columns without header."""
    return _tsv(spark).schema("source string, target string").csv(path)


def read_weighted_edges(spark: SparkSession, path: str) -> DataFrame:
    """Three columns; a header line is known by its first value and dropped."""
    return _tsv(spark).schema("source string, target string, weight string").csv(path).where("source <> 'source'").withColumn("weight", F.col("weight").cast("int"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of a folder of .txt files whose names are URL-encoded ids; a README is left out."""
    name = F.regexp_extract("_metadata.file_name", r"(.*)\.txt$", 1)
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(name.alias("name"), F.col("value").alias("text"))
    # file_name is itself URL-encoded, so an encoded id is encoded twice
    return files.select(F.url_decode(F.url_decode("name")).alias("doc_id"), "text").where("lower(doc_id) <> 'readme'")


def read_corpus_zip(spark: SparkSession, path: str) -> DataFrame:
    """The same from zip archives; each archive is opened where it is read."""

    def entries(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    names = [n for n in z.namelist() if n.endswith(".txt") and not n.split("/")[-1].lower().startswith("readme")]
                    for n in names:
                        yield pa.RecordBatch.from_arrays([pa.array([unquote(n.split("/")[-1][:-4])]), pa.array([z.read(n).decode("utf-8", "replace")])], names=["doc_id", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(entries, "doc_id string, text string")


#: Characters of text to an archive, on average: a task holds one archive whole.
ARCHIVE_CHARS = 16_000_000


def write_corpus_zip(docs: DataFrame, folder: str, archives: int | None = None) -> None:
    """Write (doc_id, text) as zip archives of .txt files named by URL-encoded ids, in a folder that workers and driver
    share; null texts are empty files. Unless their number is given, archives are as many as ARCHIVE_CHARS asks for, 8 at
    least. Each attempt of a task writes a file of its own under a hidden name, which takes its place when it is whole."""
    if archives is None:
        archives = max(8, -(-(docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0) // ARCHIVE_CHARS))

    def pack(key, table):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist()):
                z.writestr(f"{quote(str(i), safe='')}.txt", (t or "").encode())
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        name = f"{path.rstrip('/')}/{key[0].as_py():05d}.zip"
        with where.open_output_stream(hidden := f"{path.rstrip('/')}/.{uuid.uuid4().hex}", compression=None) as f:
            f.write(out.getvalue())
        where.move(hidden, name)
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    dealt = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(archives)).cast("int").alias("archive"))
    dealt.groupBy("archive").applyInArrow(pack, "n long").agg(F.sum("n")).collect()


def read_attr_map(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(key, label) from a JSON document with one object of single labels."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json(F.get_json_object("value", f"$.{field}"), "map<string,string>")).alias("key", "label"))


def read_attr_multimap(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(key, label) from a JSON document with one object of label lists."""
    text = spark.read.text(path, wholetext=True)
    lists = text.select(F.explode(F.from_json(F.get_json_object("value", f"$.{field}"), "map<string,array<string>>")).alias("key", "labels"))
    return lists.select("key", F.explode("labels").alias("label"))


def snapshot_line(spark: SparkSession, path: str) -> str | None:
    """The first comment line of a file, without its mark."""
    row = spark.read.text(path).where("value like '#%'").first()
    return row.value.lstrip("# ").strip() if row else None


def write_json(df: DataFrame, path: str) -> None:
    """One compact JSON document a row, characters as they are."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def content_hash(df: DataFrame) -> str:
    """A name for the rows of df, whatever their order: their number and the sum of their hashes, in one aggregation."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return f"{','.join(df.columns)}:{row.n}:{row.h}"


def artefact(spark: SparkSession, folder: str, name: str, inputs: str, make: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
    """A Parquet artefact named by a hash of its inputs: made once, then read; fresh makes it anew."""
    path = f"{folder.rstrip('/')}/{name}-{hashlib.sha1(inputs.encode()).hexdigest()[:16]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if fresh or not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
