"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled rows gives the examples. Every word of theirs, and every beginning of a word, is a term: the
vocabulary is not cut. A term's inverse document frequency is scaled by how far its share differs between the labels
(the root of the chi-square statistic), since plain TF-IDF neighbours hardly tell the labels apart. Texts are scored where
they are read, by distance-weighted votes of their nearest examples, calibrated on the examples scored by each other.
The index is built by one task and written to the shared folder, where each task opens it; it holds one posting
for each distinct term of each sampled example, and never passes through the driver.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import LETTERS, hash_words, new_path, open_uri, partitions, small_batches, written

#: Texts searched together, and postings of theirs read together; both bound a worker.
_GROUP, _POSTINGS = 128, 1 << 18


@dataclass(frozen=True)
class Knn:
    """per_class: examples of each label at most; prefixes: bytes of word beginnings that are terms too; contrast and
    doubt: how much a term's weight grows with the difference of its share between the labels, and in how many examples
    such a difference counts half; k: neighbours; power: of the similarity in votes; prior: weight of the sample's label
    share in a vote; block: examples a block; often: terms in more than this share of a block are stored there as rows,
    others as postings."""

    per_class: int = 2000
    prefixes: tuple = (5,)
    contrast: float = 1.5
    doubt: float = 4.0
    k: int = 15
    power: float = 2.0
    prior: float = 0.002
    block: int = 1024
    often: float = 0.0625
    seed: int = 5


def term_counts(texts: list, prefixes: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, count) of some texts, ordered by text. Words are runs of letters of the lower-cased text (all
    beyond ASCII count as letters)."""
    raws = [(t or "").lower().encode() for t in texts]
    hashes, doc = hash_words(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]), LETTERS, prefixes)
    terms, back = np.unique(hashes, return_inverse=True)
    code, count = np.unique(doc * len(terms) + back, return_counts=True)
    return code // max(1, len(terms)), terms[code % max(1, len(terms))], count


class BlockMaxIndex:
    """Examples by term, in blocks with the largest weight of each term, for exact top-k cosine.

    owner, term, weight: the weights of all examples, ordered by example. Within a block, frequent terms are rows over its
    examples and all others are postings.
    """

    def __init__(self, n: int, n_terms: int, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, block: int, often: float = 0.125):
        self.n, self.n_terms, self.block = n, n_terms, block
        self.n_blocks = -(-max(1, n) // block)
        self.most = np.zeros((n_terms, self.n_blocks))
        np.maximum.at(self.most, (term, owner // block), weight)
        self.parts = []
        for b in range(self.n_blocks):
            k = np.flatnonzero(owner // block == b)
            k = k[np.argsort(term[k], kind="stable")]
            size = np.bincount(term[k], minlength=n_terms)
            frequent = np.flatnonzero(size > often * block)
            row = np.full(n_terms, -1, np.int32)
            row[frequent] = np.arange(len(frequent))
            common = row[term[k]] >= 0
            size[frequent] = 0
            full, rest = k[common], k[~common]
            cells = (len(frequent), row[term[full]], (owner[full] - b * block).astype(np.int16), weight[full])
            self.parts.append((row, cells, np.concatenate([[0], np.cumsum(size)]).astype(np.int32), (owner[rest] - b * block).astype(np.int16), weight[rest]))
        self.rows: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return {**self.__dict__, "rows": {}}

    def _rows(self, b: int) -> np.ndarray:
        """The rows of a block's frequent terms, laid out once in each process that searches."""
        if b not in self.rows:
            n, at, doc, weight = self.parts[b][1]
            self.rows[b] = np.zeros((n, self.block))
            self.rows[b][at, doc] = weight
        return self.rows[b]

    def _scores(self, b: int, rows: np.ndarray, at: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Cosines of some queries (rows; their terms lie from at[row] to at[row + 1]) with all examples of a block."""
        row, _, start, doc, w = self.parts[b]
        dense = self._rows(b)
        size = at[rows + 1] - at[rows]
        k = np.repeat(at[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        who, t, q = np.repeat(np.arange(len(rows)), size), term[k], weight[k]
        common = row[t] >= 0
        flat = np.zeros((len(rows), len(dense)))
        flat[who[common], row[t[common]]] = q[common]
        out = flat @ dense
        who, t, q = who[~common], t[~common], q[~common]
        n = start[t + 1] - start[t]
        upto, i = np.cumsum(n, dtype=np.int64), 0
        while i < len(n):  # some postings at a time, whatever the texts hold
            j = max(i + 1, int(np.searchsorted(upto, upto[i] - n[i] + _POSTINGS, side="right")))
            c = n[i:j]
            p = np.repeat(start[t[i:j]] - np.cumsum(c) + c, c) + np.arange(c.sum())
            lo, hi = who[i], who[j - 1] + 1
            part = np.bincount(np.repeat((who[i:j] - lo) * self.block, c) + doc[p], w[p] * np.repeat(q[i:j], c), (hi - lo) * self.block)
            out[lo:hi] += part.reshape(hi - lo, self.block)
            i = j
        return out

    def search(self, at: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, example, cosine) of each query's k nearest examples of positive cosine, nearest first, ties to smaller
        numbers; the terms of query i lie from at[i] to at[i + 1].

        Each query's block of the largest bound comes first; of the others, those whose bound is below the k-th cosine
        found there can't hold a better one and are left out.
        """
        m = len(at) - 1
        score = np.full((m, self.n_blocks, self.block), -1.0)
        if not m or not self.n_terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bound = np.zeros((m, self.n_blocks))
        full = np.flatnonzero(at[1:] > at[:-1])
        if len(full):
            bound[full] = np.add.reduceat(self.most[term] * weight[:, None], at[full], axis=0)
        best = bound.argmax(1)
        tried = bound <= 0
        for first in (True, False):
            if first:
                todo = (best[:, None] == np.arange(self.n_blocks)) & ~tried
            else:
                kth = np.partition(score[np.arange(m), best], self.block - min(k, self.block), axis=1)[:, self.block - min(k, self.block)]
                todo = ~tried & (bound >= kth[:, None] - 1e-9)
            for b in range(self.n_blocks):
                rows = np.flatnonzero(todo[:, b])
                if len(rows):
                    score[rows, b] = self._scores(b, rows, at, term, weight)
                    if without is not None:
                        own = rows[without[rows] // self.block == b]
                        score[own, b, without[own] % self.block] = -1.0
            tried |= todo
        score = np.round(score.reshape(m, -1), 12)
        kth = np.partition(score, score.shape[1] - min(k, score.shape[1]), axis=1)[:, score.shape[1] - min(k, score.shape[1])]
        q, d = np.nonzero((score >= kth[:, None]) & (score > 0))
        s = score[q, d]
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], d[keep], s[keep]


def probability(votes: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * votes + offset, -30, 30)))


class KnnModel:
    """Examples, term weights and calibration; score() gives votes and the evidence for them. A fitted model on the driver
    has the calibration and the file of the examples only."""

    def __init__(self, how: Knn, examples: list[tuple]):
        """examples: (label, id, row, term hashes, counts)."""
        self.how = how
        examples = sorted(examples, key=lambda e: e[:3])
        self.labels, self.ids = np.array([e[0] for e in examples], np.float64), np.array([e[1] for e in examples], np.int64)
        n, n1 = len(examples), self.labels.sum()
        owner = np.repeat(np.arange(n), [len(e[3]) for e in examples])
        self.vocab, term = np.unique(np.concatenate([np.zeros(0, np.uint64), *(e[3] for e in examples)]), return_inverse=True)
        count = np.concatenate([np.zeros(0), *(e[4] for e in examples)])
        df = np.bincount(term, minlength=len(self.vocab)).astype(np.float64)
        a = np.bincount(term, self.labels[owner], len(self.vocab))
        apart = np.abs(n * a - n1 * df) / np.sqrt(np.maximum(n1 * (n - n1) * df * np.maximum(n - df, 1) / max(1, n), 1e-9))
        self.weight = np.log((n + 1) / np.maximum(df, 1)) * (0.05 + apart * df / (df + how.doubt)) ** how.contrast
        self.share = (n1 + 0.5) / (n + 1) if n1 else 0.0
        self.index = BlockMaxIndex(n, len(self.vocab), owner, term, self._unit(owner, term, count, n), how.block, how.often)
        self.place = {e[2]: i for i, e in enumerate(examples)}
        self.slope, self.offset, self.file = 8.0, -4.0, None

    def _unit(self, owner, term, count, n):
        """Weights of length 1 for each owner."""
        w = (1 + np.log(count)) * self.weight[term]
        return w / np.maximum(np.sqrt(np.bincount(owner, w * w, n)), 1e-300)[owner]

    def votes(self, at, term, w, without=None):
        """Each query's share of label 1 among its neighbours, and the neighbours (query, example, cosine)."""
        q, d, s = self.index.search(at, term, w, self.how.k, without)
        m, v = len(at) - 1, s**self.how.power
        prior = self.how.prior
        return (np.bincount(q, v * self.labels[d], m) + prior * self.share) / (np.bincount(q, v, m) + prior), q, d, s

    def calibrate(self, votes: np.ndarray, y: np.ndarray) -> None:
        """Logistic calibration of votes (Newton's method with a weak prior on the slope)."""
        if len(y) < 10 or y.min() == y.max():
            return
        b = np.array([8.0, -4.0])
        for _ in range(30):
            p = probability(votes, *b)
            x = np.stack([votes, np.ones_like(votes)], 1)
            grad = x.T @ (p - y) + 0.05 * (b - [8.0, -4.0])
            b = b - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), grad)
        if np.isfinite(b).all() and b[0] > 0:
            self.slope, self.offset = map(float, b)

    def vectors(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """at, term, weight of some texts: their terms that an example has too, at length 1."""
        return self.known(len(texts), *term_counts(texts, self.how.prefixes))

    def known(self, n: int, owner: np.ndarray, hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from the term counts of n texts."""
        if not len(self.vocab):
            return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
        k = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        met = self.vocab[k] == hashes
        owner, term = owner[met], k[met]
        return np.searchsorted(owner, np.arange(n + 1)), term, self._unit(owner, term, count[met].astype(np.float64), n)

    def score(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Votes of some texts, and as evidence (text, id of the example, cosine), nearest first."""
        out, seen, ids, sims = np.zeros(len(texts)), [], [], []
        for i in range(0, len(texts), _GROUP):
            vote, q, d, s = self.votes(*self.vectors(texts[i : i + _GROUP]))
            out[i : i + len(vote)] = vote
            seen.append(q + i)
            ids.append(self.ids[d])
            sims.append(s)
        return out, *(np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.int64, seen), (np.int64, ids), (np.float64, sims)))


def fit(docs: DataFrame, labels: DataFrame, how: Knn = Knn(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> KnnModel:
    """Fit on at most how.per_class rows of each label, picked by a hash of the id; all of them are examples.

    Rows with null id or label and labels other than 0 and 1 are left out; a null text is an example without terms; an id
    with several texts gives an example each; no usable row gives a model that scores under one half.
    """
    labels = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    order = [F.xxhash64(F.lit(how.seed), "id"), F.col("id")]
    picked = labels.where("y = 1").orderBy(*order).limit(how.per_class).union(labels.where("y = 0").orderBy(*order).limit(how.per_class))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")

    def terms(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            _, h, n = term_counts([t], how.prefixes)
            out.append({"h": h.tobytes(), "n": n.astype("<u4").tobytes()})
        return pa.array(out, pa.struct([("h", pa.binary()), ("n", pa.binary())]))

    terms.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    spark = docs.sparkSession
    rows = texts.select("y", "id", F.monotonically_increasing_id().alias("row"), F.arrow_udf(terms, "struct<h:binary,n:binary>")("text").alias("t"))
    rows, folder = written(rows, "labelled-terms"), new_path(spark, "toxicity-index")

    def build(batches):
        held = [(r["y"], r["id"], r["row"], *counted(r["t"])) for batch in batches for r in batch.to_pylist()]
        if held:
            with open_uri(file := f"{folder}/{uuid.uuid4().hex}", "w") as f:
                pickle.dump(KnnModel(how, held), f)
            yield pa.RecordBatch.from_arrays([pa.array([file])], names=["file"])

    model = KnnModel(how, [])
    for r in rows.coalesce(1).mapInArrow(build, "file string").collect():
        model.file = r.file

    def votes(batches):
        index = opened(model)
        for batch in batches:
            for y, row, t in zip(*(c.to_pylist() for c in batch.columns)):
                h, n = counted(t)
                vote = index.votes(*index.known(1, np.zeros(len(h), np.int64), h, n), np.array([index.place[row]]))[0]
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([row], pa.int64()), pa.array(vote)], names=["y", "row", "vote"])

    # each example is scored by the others, spread over tasks; sorted here, as sorting in Spark would compute them twice
    found = sorted(rows.select("y", "row", "t").repartition(partitions(spark), "row").mapInArrow(votes, "y int, row long, vote double").collect())
    model.calibrate(np.array([r.vote for r in found]), np.array([r.y for r in found], np.float64))
    return model


def counted(t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes and counts of a row of the written examples."""
    return np.frombuffer(t["h"], np.uint64), np.frombuffer(t["n"], "<u4").astype(np.float64)


def opened(model: KnnModel) -> KnnModel:
    """The examples behind a fitted model; itself where there are none. A task opens them once and drops them at its end."""
    if not model.file:
        return model
    with open_uri(model.file, "r") as f:
        return pickle.loads(f.read())


def with_toxicity(docs: DataFrame, model: KnnModel, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a struct column `into`: score (0 to 1), and as evidence the nearest examples' ids and cosines.

    Texts that share no term with the examples (null and empty ones too) are scored by the share of label 1 among the
    examples. All rows are kept, and all columns but one of the name `into`.
    """
    small_batches(docs.sparkSession)

    def score(batches):
        index = opened(model)
        for texts in batches:
            once = texts.dictionary_encode()  # equal texts of a batch are scored once
            votes, q, ids, sims = index.score(once.dictionary.to_pylist() + [None])
            at = pa.array(np.searchsorted(q, np.arange(len(votes) + 1)), pa.int32())
            evidence = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (ids, sims)]
            found = pa.StructArray.from_arrays([pa.array(probability(votes, model.slope, model.offset)), *evidence], names=["score", "examples", "cosines"])
            yield found.take(once.indices.fill_null(len(votes) - 1))

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(into, F.arrow_udf(score, "struct<score:double,examples:array<long>,cosines:array<double>>")(F.col(text_col).cast("string")))
