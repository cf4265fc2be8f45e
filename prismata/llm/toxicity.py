"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings, all that the examples hold. A term weighs by its inverse document frequency,
raised by its chi-square with the label over the drawn labelled rows. The k nearest examples, with all that tie with
the last, vote by the square of their similarity. Votes become scores through a monotone table fitted on leave-one-out votes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prismata.llm.kernels import NOT_ALNUM, SHORT_SLICE, mix, pack, ragged, text_slices, unpack, word_bounds, word_hashes
from prismata.llm.scratch import Scratch, small_batches
from prismata.llm.shared_files import map_arrays, write_arrays

BEGIN = 5  # bytes of a word's beginning
BLOCK = 2048  # examples in a block of the index
WIDE = 16  # a term that one in so many examples hold is a dense column, the others are postings
GROUP, FEW = 64, 8  # texts that are searched together, and whose postings are added up together
SLACK = 1e-5  # more than single precision loses in a similarity
NEAR = 25
CHI = 3.0  # the chi-square that doubles a term's weight
POWER = 2  # of the similarity in a vote
_OTHER = np.uint64(0x51ED270B35A1C9E7)


def text_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of the beginnings of longer ones, and the text of each."""
    starts, ends, first = word_bounds(data, offsets, NOT_ALNUM)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    long = ends - starts > BEGIN
    heads = mix(word_hashes(data, starts[long], starts[long] + BEGIN) ^ _OTHER)
    return np.concatenate([word_hashes(data, starts, ends), heads]), np.concatenate([text, text[long]])


def _texts_with(term: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms and the sums of their counts."""
    u, inverse = np.unique(term, return_inverse=True)
    return u, np.bincount(inverse, n, len(u)).astype(np.uint32), np.bincount(inverse, pos, len(u)).astype(np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label that hold a term, summed over a task, a million new counts at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    fresh = 0
    for batch in batches:
        y = np.asarray(batch.column("toxic"))
        for a, _, data, offsets in text_slices(batch.column("text"), SHORT_SLICE):
            term, text = text_terms(data, offsets)
            order = np.lexsort((term, text))
            term, text = term[order], text[order]
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
            term, label = term[new], y[a + text[new]]
            held.append(_texts_with(term, np.ones(len(term)), label))
            fresh += len(held[-1][0])
            if fresh > 1_000_000:
                held, fresh = [_texts_with(*[np.concatenate(x) for x in zip(*held, strict=True)])], 0
    if held:
        u, n, pos = _texts_with(*[np.concatenate(x) for x in zip(*held, strict=True)])
        block = (u >> np.uint64(58)).astype(np.int64)
        for b in np.unique(block):
            m = block == b
            yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), *[pa.array([pack(x[m])], pa.binary()) for x in (u, n, pos)]], names=["block", "u", "n", "pos"])


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    """The counts of all tasks for the terms of one block."""
    u, n, pos = _texts_with(*[np.concatenate([unpack(x) for x in pdf[c]]) for c in ("u", "n", "pos")])
    return pd.DataFrame({"u": [pack(u)], "n": [pack(n)], "pos": [pack(pos)]})


def term_weights(n: np.ndarray, pos: np.ndarray, rows: int, toxic: int) -> np.ndarray:
    """Inverse document frequency, raised by the chi-square of a term with the label. No term weighs 0.

    The chi-square has Yates' correction, without which a term of one or two texts would seem to go with their label.
    """
    p = toxic / rows
    rest = np.maximum(rows - n, 1e-9)
    gap = np.maximum(np.abs(pos - n * p) - 0.5, 0) ** 2 * (1 / n + 1 / rest) / (p * (1 - p))
    return (np.log((1 + rows) / (1 + n)) + 0.1) * (1 + gap / CHI)


class Index:
    """Examples over all their terms, in blocks; per term its weights, or postings, and its largest weight in each block.

    Terms of no example are not kept: they would add nothing to any product and change a text's length only.
    """

    def __init__(self, terms: np.ndarray, weight: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.weight = terms[order], weight[order]
        self.ids = np.zeros(0, np.int64)
        self.labels = np.zeros(0)
        self.blank = 0.0  # score of a text that shares no term with any example
        self.cuts, self.levels = np.zeros(0), np.zeros(1)
        self.uri: str | None = None

    def save(self, uri: str) -> None:
        arrays = {k: v.ravel() for k, v in self.__dict__.items() if isinstance(v, np.ndarray)}
        write_arrays(uri, arrays | {"blank": np.array([self.blank])})

    @staticmethod
    @functools.lru_cache(4)
    def load(uri: str) -> Index:
        """The index in the shared folder, memory-mapped: tasks on one machine share its pages."""
        out = Index(np.zeros(0, np.uint64), np.zeros(0))
        out.__dict__.update(map_arrays(uri))
        out.uri, out.blank = uri, float(out.blank[0])
        out.n_blocks = -(-len(out.ids) // BLOCK)
        out.dense = out.dense.reshape(len(out.ids), -1)
        out.dense_most = out.dense_most.reshape(out.n_blocks, -1)
        return out

    def __reduce__(self):
        return (Index.load, (self.uri,)) if self.uri else super().__reduce__()

    def weigh(self, text: np.ndarray, at: np.ndarray, times: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms by index, weights of unit length) of each of ``n`` texts, from entries that are ordered by text."""
        weight = (1 + np.log(times)) * self.weight[at]
        weight = weight / np.sqrt(np.bincount(text, weight**2, n))[text]
        cut = np.searchsorted(text, np.arange(n + 1))
        return [(at[a:b], weight[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The vector of each text; an empty one where it has no term of any example."""
        n = len(offsets) - 1
        if not len(self.terms):
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        term, text = text_terms(data, offsets)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        ok = self.terms[at] == term
        pair, times = np.unique(text[ok] * len(self.terms) + at[ok], return_counts=True)
        return self.weigh(pair // len(self.terms), pair % len(self.terms), times, n)

    def fill(self, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Store the examples and say where each went; those with the same heaviest term lie together, which keeps block bounds tight."""
        order = sorted(range(len(ids)), key=lambda k: (int(vectors[k][0][np.argmax(vectors[k][1])]), len(vectors[k][0]), int(ids[k])))
        self.ids, self.labels = ids[order], labels[order].astype(float)
        term = np.concatenate([vectors[k][0] for k in order]).astype(np.int32)
        by = np.argsort(term, kind="stable")
        value = np.concatenate([vectors[k][1] for k in order]).astype(np.float32)[by]
        example = np.repeat(np.arange(len(order), dtype=np.int32), [len(vectors[k][0]) for k in order])[by]
        self._lay_out(term[by], example, value)
        place = np.zeros(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place

    def _lay_out(self, term: np.ndarray, example: np.ndarray, value: np.ndarray) -> None:
        n, n_terms = len(self.ids), len(self.terms)
        self.n_blocks = -(-n // BLOCK)
        wide = np.flatnonzero(np.bincount(term, minlength=n_terms) * WIDE >= max(n, 1))
        self.column = np.full(n_terms, -1, np.int32)
        self.column[wide] = np.arange(len(wide))
        column = self.column[term]
        dense = column >= 0
        self.dense = np.zeros((n, len(wide)), np.float32)
        self.dense[example[dense], column[dense]] = value[dense]
        self.dense_most = np.maximum.reduceat(self.dense, np.arange(0, n, BLOCK), axis=0)
        term, example, value = term[~dense], example[~dense], value[~dense]
        self.posting = np.stack([example, value.view(np.int32)], axis=1).view(np.int64).ravel()  # both in one word, for one gather
        block = example // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(block) != 0)])) if len(term) else np.zeros(0, np.int64)
        self.start = np.append(new, len(term))  # the postings of an entry, which is a term in a block
        self.block, self.most = block[new], np.maximum.reduceat(value, new) if len(new) else value
        self.first = np.searchsorted(term[new], np.arange(n_terms + 1))  # the entries of a term

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], near: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the ``near`` most similar examples and all that tie with the last of them, with their similarities.

        Never those at similarity 0, nor the one example that ``skip`` names for each text. A text opens the
        block of its highest bound, then those whose bound reaches the similarity that is last so far.
        """
        if not len(self.ids):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        out = []
        for a in range(0, len(vectors), GROUP):
            out += self._nearest(vectors[a : a + GROUP], near, skip and skip[a : a + GROUP])
        return out

    def _nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], near: int, skip: list[int] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        n, size, blocks = len(vectors), len(self.ids), self.n_blocks
        at, weight = (np.concatenate([v[k] for v in vectors]) for k in (0, 1))
        text = np.repeat(np.arange(n), [len(v[0]) for v in vectors])
        column = self.column[at]
        wide = column >= 0
        exact = np.zeros((n, self.dense.shape[1]))
        exact[text[wide], column[wide]] = weight[wide]
        query = exact.astype(np.float32)
        at, weight, text = at[~wide], weight[~wide], text[~wide]
        many = self.first[at + 1] - self.first[at]
        entry, weight, text = ragged(self.first[at], many), np.repeat(weight, many), np.repeat(text, many)
        key = text * blocks + self.block[entry]
        bound = query @ self.dense_most.T + np.bincount(key, weight * self.most[entry], n * blocks).reshape(n, blocks)
        best = bound.argmax(1)
        first = np.arange(blocks) == best[:, None]
        sums, sparse, least = np.zeros((n, size), np.float32), np.zeros((n, size)), np.zeros(n)
        for todo in (first, None):
            if todo is None:
                todo = (bound > 0) & (bound >= least[:, None] - SLACK) & ~first
            pick = todo.ravel()[key]
            self._add_postings(text[pick], entry[pick], weight[pick], sparse)
            for b in np.flatnonzero(todo.any(0)):
                rows, its = np.flatnonzero(todo[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                one = query[rows] @ self.dense[its].T
                one += sparse[rows, its]
                sums[rows, its] = one
                if todo is first and one.shape[1] > near:
                    least[rows] = np.partition(one, -near - 1, axis=1)[:, -near - 1]  # one example may be skipped
        if skip:
            sums[np.arange(n), skip] = 0
        out = []
        for t in range(n):
            k = np.flatnonzero(sums[t] >= max(least[t] - SLACK, 1e-12))
            if len(k) > near:
                one = sums[t, k]
                k = k[one >= np.partition(one, -near)[-near] - SLACK]
            s = np.round(sparse[t, k] + self.dense[k].astype(float) @ exact[t], 9)
            ok = s >= np.partition(s, -near)[-near] if len(s) > near else np.ones(len(s), bool)
            order = np.lexsort((self.ids[k[ok]], -s[ok]))
            out.append((k[ok][order], s[ok][order]))
        return out

    def _add_postings(self, text: np.ndarray, entry: np.ndarray, weight: np.ndarray, sums: np.ndarray) -> None:
        """Add the products of the entries' postings to the sums of the texts, which are in order."""
        n, size = sums.shape
        cuts = np.searchsorted(text, np.arange(0, n + FEW, FEW))
        for low, a, b in zip(range(0, n, FEW), cuts[:-1], cuts[1:], strict=False):
            start = self.start[entry[a:b]]
            many = self.start[entry[a:b] + 1] - start
            got = self.posting[ragged(start, many)]
            place = np.repeat((text[a:b] - low) * size, many)
            place += got.view(np.int32)[::2]
            product = np.repeat(weight[a:b], many)
            product *= got.view(np.float32)[1::2]
            own = sums[low : low + FEW]
            own += np.bincount(place, product, own.size).reshape(own.shape)

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], near: int, skip: list[int] | None = None) -> list[tuple[float, np.ndarray] | None]:
        """The share of label 1 among the nearest by their similarity, and the three nearest; None for a text that has none."""
        out: list[tuple[float, np.ndarray] | None] = []
        for k, s in self.nearest(vectors, near, skip):
            s = s**POWER
            out.append((float((s * self.labels[k]).sum() / s.sum()), k[:3]) if len(k) else None)
        return out

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Pool adjacent violators over the leave-one-out votes; a level is the smoothed share of label 1."""
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []
        for v, y in zip(votes[order], labels[order], strict=True):
            if pools and pools[-1][3] == v:
                pools[-1][0] += y
                pools[-1][1] += 1
            else:
                pools.append([float(y), 1.0, float(v), float(v)])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                y, n, _, high = pools.pop()
                pools[-1][0] += y
                pools[-1][1] += n
                pools[-1][3] = high
        if pools:
            self.cuts = np.array([p[2] for p in pools[1:]])
            self.levels = np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]], near: int) -> list[tuple[float, list[int]]]:
        return [(self.blank, []) if got is None else (float(self.levels[np.searchsorted(self.cuts, got[0], "right")]), [int(x) for x in self.ids[got[1]]]) for got in self.votes(vectors, near)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", drawn: int = 40_000, examples: int = 6_000, near: int = NEAR) -> Index:
    """Fit on about ``drawn`` labelled rows, taken by a hash of the id; about ``examples`` of them make the index, with all their terms.

    Both numbers are the documented bounds of what is fitted on and of the index, which lies in the shared folder.
    Of rows with the same words in the same order and the same label the one of the smallest id stays; all others
    stay, near copies and copies with another label too. An id labelled more than once counts by its largest
    label; null labels and ids are left out. Without labelled rows every score is the prior, 0.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    n_marks = marks.count()
    share = min(1.0, drawn / max(n_marks, 1))
    marks = marks.where(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = texts.join(F.broadcast(marks), "id")  # about ``drawn`` rows of an id and a label
    words = F.trim(F.regexp_replace(F.lower("text"), r"[^0-9a-z\x{80}-\x{10FFFF}]+", " "))
    single = marked.groupBy(F.sha2(words, 256), "toxic").agg(F.min(F.struct(F.col("id").cast("long").alias("id"), "text", "toxic")).alias("r")).select("r.*")
    scratch = Scratch(spark, "toxicity")
    single = scratch.write(single, "drawn")
    rows, toxic = single.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not rows or not 0 < toxic < rows:
        index = Index(np.zeros(0, np.uint64), np.zeros(0))
        index.blank = float(toxic > 0)
        return index

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for _, _, data, offsets in text_slices(batch.column("text"), SHORT_SLICE):
                term, text = text_terms(data, offsets)
                by = np.argsort(text, kind="stable")
                cut = np.searchsorted(text[by], np.arange(len(offsets)))
                held += [np.unique(term[by[a:b]], return_counts=True) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), *[pa.array([pack(x) for x in c], pa.binary()) for c in ([u for u, _ in held], [n.astype(np.uint32) for _, n in held])]], names=["id", "toxic", "u", "times"])

    full = F.col("text").rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]")
    n_blank, t_blank = single.where(~full).agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    blank = float((t_blank + 0.5) / (n_blank + 1)) if n_blank else float(toxic / rows)
    part = min(1.0, examples / max(rows - n_blank, 1))
    chosen = single.where(full).where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    vectors = chosen.mapInArrow(terms, "id long, toxic int, u binary, times binary")
    counted = single.select("text", "toxic").mapInArrow(_count, "block int, u binary, n binary, pos binary").groupBy("block").applyInPandas(_sum, "u binary, n binary, pos binary")
    both = vectors.unionByName(counted, allowMissingColumns=True)  # about ``examples`` rows and at most 64
    uri = f"{scratch.top}/index"
    if not both.repartition(1).mapInArrow(_build(uri, rows, toxic, blank, near), "n long").first()[0]:
        index = Index(np.zeros(0, np.uint64), np.zeros(0))
        index.blank = blank
        return index
    scratch.drop("drawn")
    return Index.load(uri)


def _build(uri: str, rows: int, toxic: int, blank: float, near: int):
    """Make the index from the examples and the counts of all terms, in one task; both are bounded by what was drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, counts = [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["times"] is None:
                    counts.append((r["u"], r["n"], r["pos"]))
                else:
                    got.append((r["id"], r["toxic"], r["u"], r["times"]))
        got.sort()
        ids, y = np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got])
        sets = [unpack(r[2]) for r in got]
        size = np.array([len(u) for u in sets], np.int64)
        terms = np.concatenate([*sets, np.zeros(0, np.uint64)])
        times = np.concatenate([*[unpack(r[3]) for r in got], np.zeros(0, np.uint32)])
        del got, sets
        if len(ids):
            known, terms = np.unique(terms, return_inverse=True)
            n, pos = np.zeros(len(known)), np.zeros(len(known))
            for u, with_it, with_it_toxic in counts:
                u = unpack(u)
                here = np.flatnonzero(np.isin(known, u))
                at = np.searchsorted(u, known[here])
                n[here], pos[here] = unpack(with_it)[at], unpack(with_it_toxic)[at]
            index = Index(known, term_weights(n, pos, rows, toxic))
            index.blank = blank
            own = index.weigh(np.repeat(np.arange(len(ids)), size), terms, times, len(ids))
            del terms, times, counts
            place = index.fill(ids, y, own)
            votes = [(vote[0], label) for vote, label in zip(index.votes(own, near, place.tolist()), y, strict=True) if vote]
            if votes:
                index.calibrate(np.array([v for v, _ in votes]), np.array([t for _, t in votes]))
            index.save(uri)
        yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64())], names=["n"])

    return run


class _Scored:
    """Scores and evidence of a column of texts; equal vectors are scored once."""

    def __init__(self, index: Index, near: int):
        self.index, self.near = index, near
        self.seen: dict[bytes, tuple[float, list[int]]] = {}

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[float, list[int]]]]]:
        """(first row, end row, score and evidence of each) of runs of rows."""
        for a, b, data, offsets in text_slices(texts, SHORT_SLICE):
            vectors = self.index.vectors(data, offsets)
            keys = [hashlib.blake2b(v[0].tobytes() + v[1].tobytes(), digest_size=16).digest() for v in vectors]
            if len(self.seen) > 50_000:
                self.seen.clear()
            new = {k: v for k, v in zip(keys, vectors, strict=True) if k not in self.seen}
            self.seen.update(zip(new, self.index.scores(list(new.values()), self.near), strict=True))
            yield a, b, [self.seen[k] for k in keys]


def score_toxicity(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR) -> DataFrame:
    """Returns per row: ``id_col``, score (0 to 1) and evidence (ids of the three nearest examples).

    A text that shares no term with any example, null and empty ones too, gets the share of label 1 among
    the drawn texts without words (of all drawn ones where there are none) and no evidence. Equal similarities are all counted. Null and repeated ids pass through;
    other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _Scored(index, near)
        for batch in batches:
            for a, b, out in scored(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, evidence array<long>").withColumnRenamed("doc_id", id_col)


def drop_toxic(docs: DataFrame, index: Index, threshold: float = 0.3, text_col: str = "text", near: int = NEAR) -> DataFrame:
    """The rows of ``docs``, whole, whose own text scores below ``threshold``; ids decide nothing. Null and empty texts score as in ``score_toxicity``."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _Scored(index, near)
        for batch in batches:
            for a, b, out in scored(batch.column(place).cast(pa.string())):
                yield batch.slice(a, b - a).filter(pa.array([x[0] < threshold for x in out], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
