"""Language of texts by a linear-chain conditional random field over words.

Each word has hashed features (lexicon entry, beginnings, endings, letter n-grams); learned transitions tie neighbours,
so code-switched text is labelled word by word. Training sequences are cut from a bounded sample of labelled texts and
alternate between languages. Marginals come from exact forward-backward over whole texts, computed for all texts of a
batch together: segment products first, then segment boundaries, then the words inside. A text's language has the
largest expected number of words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import hash_spans, mix, small_batches

_WORD, _GAP = re.compile(r"[^\W\d_]{1,40}"), re.compile(r"[\x20\x09-\x0D]")
UNKNOWN = "und"
_SEGMENT, _PIECE, _KNOWN, _GROUP, _CUT = 64, 1 << 18, 400_000, 100, 1 << 20


@dataclass(frozen=True)
class Crf:
    """texts: sampled at most in all, and per_lang of one language; dims: feature hash slots; lexicon: least count of a
    word in the sample to be a feature of its own."""

    texts: int = 4000
    per_lang: int = 200
    dims: int = 1 << 17
    lexicon: int = 3
    epochs: int = 6
    batch: int = 256
    rate: float = 0.25
    decay: float = 1e-6
    seed: int = 3


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; longer ones, as of scripts without spaces, in consecutive pieces of 40 characters."""
    return _WORD.findall((text or "").lower())


def _slices(text: str | None):
    """A text in slices of about a million characters that begin and end between runs of letters."""
    at = 0
    while text and at < len(text):
        end = _GAP.search(text, at + _CUT) if at + _CUT < len(text) else None
        to = end.end() if end else len(text)
        yield text[at:to] if (at, to) != (0, len(text)) else text
        at = to


def features(words: list[str], lexicon: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs of some words, by numbers: all UTF-8 n-grams of 2 to 4 bytes of the marked word, its
    beginnings and endings, a bias, and the word itself if its hash is in the sorted lexicon."""
    raw = "".join(f"<{w}>" for w in words).encode()
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    starts = np.flatnonzero(data == ord("<"))
    ends = np.append(starts[1:], len(data))
    owner = np.repeat(np.arange(len(words)), ends - starts)
    left = np.repeat(ends, ends - starts) - np.arange(len(data))
    who, what = [np.arange(len(words))], [np.zeros(len(words), np.int64)]

    def add(at: np.ndarray, own: np.ndarray, n: int, salt: int) -> None:
        code = np.full(len(at), n << 8 | salt, np.uint64)
        for j in range(n):
            code = code * np.uint64(0x100000001B3) + data[at + j]
        who.append(own)
        what.append((mix(code) % np.uint64(dims)).astype(np.int64))

    for n in (2, 3, 4):
        at = np.flatnonzero(left >= n)
        add(at, owner[at], n, 0)
    for n in (3, 4, 5, 6):
        k = np.flatnonzero(ends - starts >= n)
        add(starts[k], k, n, 1)
        add(ends[k] - n, k, n, 2)
    h = hash_spans(np.frombuffer(raw, np.uint8), starts, ends)
    k = np.flatnonzero(np.isin(h, lexicon))
    return np.concatenate([*who, k]), np.concatenate([*what, (h[k] % np.uint64(dims)).astype(np.int64)])


class CrfModel:
    def __init__(self, langs: list[str], how: Crf):
        self.langs, self.how = langs, how
        self.lexicon = np.zeros(0, np.uint64)
        self.weights = np.zeros((how.dims, len(langs)), np.float32)
        self.transitions = np.zeros((len(langs), len(langs)))
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.used = 0
        self.scores = np.zeros((1024, max(1, len(self.langs))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "scores", "used")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    def _learn(self, words: list[str]) -> None:
        """Give words a row of exponentials of emission scores; runs without a letter get -1."""
        self.number.update((w, -1) for w in words if not (w.isalpha() or any(map(str.isalpha, w))))
        words = [w for w in words if w not in self.number]
        if not words:
            return
        who, what = features(words, self.lexicon, self.how.dims)
        x = np.stack([np.bincount(who, self.weights[what, c], len(words)) for c in range(len(self.langs))], 1)
        while len(self.scores) < self.used + len(words):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[self.used : self.used + len(words)] = np.exp(x - x.max(1, keepdims=True))
        self.number.update(zip(words, range(self.used, self.used + len(words))))
        self.used += len(words)

    def _rows(self, words: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return rows[rows >= 0]

    def _chains(self, scores: np.ndarray, rows: np.ndarray, lengths: np.ndarray):
        """Marginals of every word, for sequences of words (rows of scores) that lie end to end, some segments at a time:
        (sequence of each word, marginals). scores: exp of emission scores, at most 1.

        First the product of each segment, then the vectors at all segment boundaries, then the words inside: a chain is
        never cut, and only its boundaries are held whole.
        """
        L, S = scores.shape[1], _SEGMENT
        segs = -(-lengths // S)
        n, first = int(segs.sum()), np.cumsum(segs) - segs
        owner = np.repeat(np.arange(len(lengths)), segs)
        size = np.minimum(S, lengths[owner] - (np.arange(n) - first[owner]) * S)
        word = np.cumsum(size) - size
        a = np.exp(self.transitions - self.transitions.max())

        def emit(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
            mask = np.arange(S) < size[lo:hi, None]
            e = np.ones((hi - lo, S, L))
            e[mask] = np.maximum(scores[rows[word[lo] : word[hi - 1] + size[hi - 1]]], 1e-30)
            return e, mask

        prod = np.broadcast_to(np.eye(L), (n, L, L)).copy()
        blocks = [(k, min(n, k + _PIECE // S)) for k in range(0, n, _PIECE // S)]
        for lo, hi in blocks:
            e, mask = emit(lo, hi)
            part = prod[lo:hi]
            for t in range(S):
                m = mask[:, t]
                step = (part[m] @ a) * e[m, t, None, :]
                part[m] = step / step.sum((1, 2), keepdims=True)
        left, right = np.full((n, L), 1 / L), np.full((n, L), 1 / L)
        order = np.argsort(-segs, kind="stable")
        live = np.searchsorted(-segs[order], -np.arange(1, int(segs.max(initial=0)) + 1), side="right")
        for k in range(1, len(live)):  # boundaries, a segment of all texts at a time
            at = first[order[: live[k]]] + k
            x = (left[at - 1][:, None, :] @ prod[at - 1])[:, 0]
            left[at] = x / x.sum(1, keepdims=True)
        for k in range(len(live) - 1, 0, -1):
            at = first[order[: live[k]]] + k
            x = (prod[at] @ right[at][:, :, None])[:, :, 0]
            right[at - 1] = x / x.sum(1, keepdims=True)
        for lo, hi in blocks:
            e, mask = emit(lo, hi)
            alpha, x = np.empty((hi - lo, S, L)), left[lo:hi]
            for t in range(S):
                step = (x @ a) * e[:, t]
                x = np.where(mask[:, t, None], step / step.sum(1, keepdims=True), x)
                alpha[:, t] = x
            x = right[lo:hi]
            for t in range(S - 1, -1, -1):
                alpha[:, t] *= x
                step = (e[:, t] * x) @ a.T
                x = np.where(mask[:, t, None], step / step.sum(1, keepdims=True), x)
            out = alpha[mask]
            yield np.repeat(owner[lo:hi], size[lo:hi]), out / out.sum(1, keepdims=True)

    def marginals(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Marginals of every word, for sequences that lie end to end; emit: exp of emission scores, at most 1."""
        parts = [m for _, m in self._chains(emit, np.arange(len(emit)), lengths)]
        return np.concatenate(parts) if parts else np.zeros_like(emit)

    def label_words(self, texts: list) -> list[list[tuple[str, str]]]:
        """Most probable language of each word of some texts, ties to the first; null texts and texts without letters have
        no words. A text is labelled as one chain, however long."""
        out = []
        for t in texts:
            words = words_of(t)
            if self.langs:
                self._learn(list(set(words).difference(self.number)))
                words = [w for w in words if self.number[w] >= 0]
            best = self.marginals(self.scores[self._rows(words)], np.array([len(words)])).argmax(1) if words and self.langs else []
            out.append([(w, self.langs[b]) for w, b in zip(words, best)])
        return out

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        """Language and its expected share of the words, for each text; each text is one chain, however long."""
        sums, held, owner, n = np.zeros((len(texts), max(1, len(self.langs)))), [], [], 0

        def flush():
            nonlocal n
            lengths = np.array([len(r) for r in held])
            for who, m in self._chains(self.scores, np.concatenate(held), lengths):
                for c in range(m.shape[1]):
                    sums[owner, c] += np.bincount(who, m[:, c], len(owner))
            held.clear(), owner.clear()
            n = 0

        for g in range(0, len(texts) if self.langs else 0, _GROUP):
            if len(self.number) > _KNOWN:
                if held:
                    flush()  # rows of words that are about to be forgotten
                self.reset()
            found: list[list] = [[] for _ in texts[g : g + _GROUP]]
            waiting: list = []

            def learn():
                self._learn(list(set().union(*(w for _, w in waiting)).difference(self.number)))
                for k, words in waiting:
                    found[k].append(self._rows(words))
                waiting.clear()

            for k, text in enumerate(texts[g : g + _GROUP]):
                for part in _slices(text):
                    waiting.append((k, words_of(part)))
                    if len(part) == len(text):
                        continue
                    learn()  # a slice of a long text: its words are kept as numbers alone
            learn()
            for k, rows in enumerate(found, g):
                rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                if len(rows):
                    held.append(rows)
                    owner.append(k)
                    n += len(rows)
                if n >= _PIECE:
                    flush()
        if held:
            flush()
        total = sums.sum(1)
        best = sums.argmax(1)
        return [self.langs[b] if n > 0 else UNKNOWN for b, n in zip(best, total)], [float(s[b] / n) if n > 0 else 0.0 for s, b, n in zip(sums, best, total)]

    def train(self, texts: list[tuple[str, str]]) -> None:
        """Fit to (text, language) pairs: conditional likelihood of alternating sequences, by adaptive gradient steps."""
        how, L = self.how, len(self.langs)
        if not L:
            return
        rng = np.random.default_rng(how.seed)
        numbers: dict[str, int] = {}
        docs = []
        for text, lang in texts:
            w = [x for x in words_of(text) if x.isalpha()]
            docs.append((np.fromiter((numbers.setdefault(x, len(numbers)) for x in w), np.int64, len(w)), self.langs.index(lang)))
        counts = np.bincount(np.concatenate([d for d, _ in docs]), minlength=len(numbers)) if numbers else np.zeros(0)
        if not len(counts):
            return
        names = list(numbers)
        often = [names[i] for i in np.flatnonzero(counts >= how.lexicon).tolist()]
        marked = [f"<{w}>".encode() for w in often]
        ends = np.cumsum([len(x) for x in marked])
        self.lexicon = np.sort(hash_spans(np.frombuffer(b"".join(marked), np.uint8), ends - [len(x) for x in marked], ends)) if often else self.lexicon
        who, what = features(names, self.lexicon, how.dims)
        flat, size = what[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(names))
        start = np.cumsum(size) - size
        parts = []
        for ids, y in docs:
            cuts = np.cumsum(rng.integers(8, 48, max(1, len(ids) // 8)))
            parts += [(p, y) for p in np.split(ids, cuts[cuts < len(ids)]) if len(p)]
        order = rng.permutation(len(parts))
        word = np.concatenate([parts[i][0] for i in order])
        gold = np.concatenate([np.full(len(parts[i][0]), parts[i][1]) for i in order])
        S = _SEGMENT
        rows = -(-len(word) // S)
        word, gold = np.resize(word, (rows, S)), np.resize(gold, (rows, S))  # the last row is filled from the start
        g2, t2 = np.full(self.weights.shape, 1e-8, np.float32), np.full((L, L), 1e-8)
        for _ in range(how.epochs):
            for rows in np.array_split(rng.permutation(len(word)), max(1, len(word) // how.batch)):
                w, y = word[rows], gold[rows]
                used, back = np.unique(w, return_inverse=True)
                k = np.repeat(start[used] - np.cumsum(size[used]) + size[used], size[used]) + np.arange(size[used].sum())
                owner, feature = np.repeat(np.arange(len(used)), size[used]), flat[k]
                x = np.stack([np.bincount(owner, self.weights[feature, c], len(used)) for c in range(L)], 1)
                e = np.exp(x - x.max(1, keepdims=True))[back.reshape(w.shape)]
                gamma, pairs = self._expect(e)
                one = np.eye(L)[y]
                diff = (gamma - one).reshape(-1, L)
                per_word = np.stack([np.bincount(back.ravel(), diff[:, c], len(used)) for c in range(L)], 1)
                at, inverse = np.unique(feature, return_inverse=True)
                grad = np.stack([np.bincount(inverse, per_word[owner, c], len(at)) for c in range(L)], 1) / len(rows) + how.decay * self.weights[at]
                g2[at] += grad * grad
                self.weights[at] -= (how.rate * grad / np.sqrt(g2[at])).astype(np.float32)
                seen = np.zeros((L, L))
                np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
                grad = (pairs - seen) / len(rows)
                t2 += grad * grad
                self.transitions -= how.rate * grad / np.sqrt(t2)

    def _expect(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals and expected transitions of sequences of equal length."""
        n, S, L = e.shape
        a = np.exp(self.transitions - self.transitions.max())
        alpha, beta = np.empty_like(e), np.empty_like(e)
        x = np.full((n, L), 1 / L)
        for t in range(S):
            x = (x @ a) * e[:, t]
            x = alpha[:, t] = x / x.sum(1, keepdims=True)
        x = np.ones((n, L))
        for t in range(S - 1, -1, -1):
            beta[:, t] = x
            x = (e[:, t] * x) @ a.T
            x = x / x.sum(1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(2, keepdims=True)
        pair = alpha[:, :-1, :, None] * a * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        return gamma, pair.sum((0, 1))


def fit(docs: DataFrame, how: Crf = Crf(), text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> CrfModel:
    """Fit on a sample, picked by a hash of the id, of rows whose text and language are not null: at most how.per_lang of a
    language and how.texts in all, but at least one of each language. Rows with a null id or a shared id take part like
    others; no usable row gives a model without languages."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(how.seed), F.col(id_col)).alias("h"), F.col(id_col).alias("id")).where("text is not null and lang is not null")
    n = rows.select("lang").distinct().count()
    first = W.partitionBy("lang").orderBy("h", "id")
    ids = rows.select("lang", "h", "id").withColumn("r", F.row_number().over(first)).where(F.col("r") <= min(how.per_lang, how.texts // max(1, n) + 1)).select("lang", "h", "id")
    sample = rows.join(F.broadcast(ids.distinct()), ["lang", "h", "id"]).orderBy("lang", "h", "id").collect()
    model = CrfModel(sorted({r.lang for r in sample}), how)
    model.train([(r.text, r.lang) for r in sample])
    return model


def with_language(docs: DataFrame, model: CrfModel, text_col: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct column `into`: lang ('und' where the text is null or has no letter, or no language was
    learned) and score (expected share of its words, 0 for 'und'). All rows are kept, and all columns but one of the name
    `into`; ids are not looked at; ties go to the first language in order; an empty table stays empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(texts: pa.Array) -> pa.Array:
        lang, score = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])

    label.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(into, F.arrow_udf(label, "struct<lang:string,score:double>")(F.col(text_col).cast("string")))
