"""N-gram language model in an Elias-Fano trie, trained and stored in shards, queried by memory map.

Level one is the vocabulary: sorted 64-bit word hashes (a word's id is its place) with exact counts.
Level two has, for every context word, its successors; level three has those of every pair of words.
Child pointers and children are monotone sequences in Elias-Fano form, children relative to where their
context's range starts. A child of level two is a word id; a child of level three is the place of its
word among the successors of the word before it, a small number. Each child has an 8-bit code of its
smoothed log probability, each context an 8-bit code of its back-off weight. Probabilities are
Witten-Bell interpolated with the level below, the lowest being add-one unigrams. A shard holds a range
of contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prismata.llm.elias_fano import EliasFano
from prismata.llm.kernels import HELD, WIDE, Tally, dealt, hash_edges, merge_counts, mix, pack, text_slices, unpack, word_bounds, word_hashes
from prismata.llm.scratch import Scratch
from prismata.llm.shared_files import kept_arrays, write_arrays

END = mix(np.array([0x454E44], np.uint64))[0]  # the hash of the end of a text
SLICE = 8 << 20
THIRD = 4  # shards of level three for each of level two


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text's words, and for each text the index past its end."""
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    stop = first[1:] + np.arange(1, len(first))
    out = np.empty(len(words) + len(stop), np.uint64)
    inside = np.ones(len(out), bool)
    inside[stop - 1] = False
    out[inside], out[~inside] = words, END
    return out, stop


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes below 256 and the mean of the values under each; bins hold about equally many values."""
    if not len(v):
        return np.zeros(0, np.uint8), np.zeros(1, np.float32)
    cuts = np.unique(np.quantile(v, np.arange(1, 256) / 256))
    code = np.searchsorted(cuts, v, "right").astype(np.uint8)
    n = np.bincount(code, minlength=len(cuts) + 1)
    return code, (np.bincount(code, v, len(cuts) + 1) / np.maximum(n, 1)).astype(np.float32)


def _merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return merge_counts(np.concatenate([unpack(x, delta=True) for x in pdf["k"]]), np.concatenate([unpack(x) for x in pdf["c"]]).astype(np.int64))


def _count_words(edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Tally()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                counted.add(token_stream(data, offsets)[0])
                if counted.n > HELD:
                    yield from counted.flush(edges)
        yield from counted.flush(edges)

    return run


def _vocabulary_block(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, c = _merged(pdf)
        block = int(pdf["block"].iloc[0])
        size = write_arrays(f"{folder}/words-{block}", {"k": k, "c": c.astype(np.uint32 if c.max() < 2**32 else np.uint64)})
        return pd.DataFrame([(block, len(k), int(c.sum()), size)], columns=["block", "n", "tokens", "bytes"])

    return run


class Vocabulary:
    """Word ids and counts over the memory-mapped blocks of level one."""

    def __init__(self, folder: str, sizes: dict[int, int], blocks: int):
        self.folder, self.blocks = folder, blocks
        starts = np.concatenate([[0], np.cumsum([sizes.get(b, 0) for b in range(blocks)])]).astype(np.int64)
        write_arrays(f"{folder}/words-index", {"starts": starts})
        self.size = int(starts[-1])

    @property
    def starts(self) -> np.ndarray:
        """The first id of each block, and the end; tasks map them too."""
        return self._block("index")["starts"]

    def _block(self, b: int | str) -> dict[str, np.ndarray]:
        return kept_arrays(f"{self.folder}/words-{b}")

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count or 0) of each of the sorted hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cut = [*np.searchsorted(hashes, hash_edges(self.blocks)), len(hashes)]
        starts = self.starts
        for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if y > x and starts[b + 1] > starts[b]:
                a = self._block(b)
                at = np.minimum(np.searchsorted(a["k"], hashes[x:y]), len(a["k"]) - 1)
                ok = a["k"][at] == hashes[x:y]
                ids[x:y] = np.where(ok, at + starts[b], -1)
                counts[x:y] = np.where(ok, a["c"][at], 0)
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        block = np.searchsorted(self.starts, ids, "right") - 1
        for b in np.unique(block):
            m = block == b
            out[m] = self._block(int(b))["c"][ids[m] - self.starts[b]]
        return out


class _Triples:
    """Sums counts of (pair id, place of the word) and deals them to ranges of pairs; keys are local to a range, so that they fit 64 bits."""

    def __init__(self, edges: np.ndarray, size: int, first: int = 0):
        self.edges, self.size, self.first = edges, size, first
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, pairs: np.ndarray, places: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.held.append((pairs, places, np.ones(len(pairs), np.int64) if counts is None else counts))
        self.n += len(pairs)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            x, place, n = (np.concatenate(v) for v in zip(*self.held, strict=True))
            self.held, self.n = [], 0
            order = np.argsort(x)
            x, place, n = x[order], place[order], n[order]
            cut = [*np.searchsorted(x, self.edges), len(x)]
            out = []
            for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if b > a:
                    k, c = merge_counts((x[a:b] - self.edges[s]) * (self.size + 1) + place[a:b], n[a:b])
                    out.append((self.first + s, pack(k.astype(np.uint64), delta=True), pack(c.astype(np.uint32 if c.max() < 2**32 else np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "k", "c"])


def pair_keys(ids: np.ndarray, stop: np.ndarray, size: int) -> np.ndarray:
    """context * (size + 1) + word for each token; a text's first context is the id ``size``; -1 where either is unknown."""
    context = np.empty_like(ids)
    context[1:] = ids[:-1]
    context[0:1] = size
    context[stop[:-1]] = size
    return np.where((ids < 0) | (context < 0), -1, context * (size + 1) + ids)


def _shard_edges(shards: int, size: int) -> np.ndarray:
    """The first context of each shard."""
    return np.array([(size + 1) * s // shards for s in range(shards)], np.int64)


def _shard_range(s: int, shards: int, size: int) -> tuple[int, int]:
    """The contexts of a shard: its first, and the next shard's."""
    return (size + 1) * s // shards, (size + 1) * (s + 1) // shards


def _count_pairs(words: Vocabulary, edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Tally()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                tokens, stop = token_stream(data, offsets)
                u, inverse = np.unique(tokens, return_inverse=True)
                counted.add(pair_keys(words.lookup(u)[0][inverse], stop, words.size))
                if counted.n > HELD:
                    yield from counted.flush(edges)
        yield from counted.flush(edges)

    return run


def build_level(context: np.ndarray, child: np.ndarray, counts: np.ndarray, lower: np.ndarray, low: int, high: int) -> dict[str, np.ndarray]:
    """The arrays of a shard for the contexts from ``low`` to ``high`` (exclusive).

    ``context`` (from 0) and ``child`` are sorted; ``lower`` has each child's probability by the level below.
    """
    first = np.searchsorted(context, np.arange(high - low + 1))
    kinds = np.diff(first)
    sums = np.bincount(context, counts, high - low)
    weight = np.where(kinds > 0, kinds / np.maximum(sums + kinds, 1), 1.0)
    p = (counts + kinds[context] * lower) / (sums + kinds)[context]
    code, book = quantise(np.log10(p))
    back, back_book = quantise(np.log10(weight))
    has = np.flatnonzero(kinds > 0)
    span = np.zeros(high - low, np.int64)
    span[has] = child[first[has + 1] - 1] + 1  # a range's children count from where the range before it ends
    base = np.cumsum(span) - span
    out = {"range": np.array([low, high], np.int64), "code": code, "book": book, "back": back, "back_book": back_book}
    for name, ef in (("pointer", EliasFano.build(first)), ("child", EliasFano.build(base[context] + child))):
        out |= {f"{name}.{k}": a for k, a in ef.arrays().items()}
    return out


def build_shard(keys: np.ndarray, counts: np.ndarray, low: int, high: int, words: Vocabulary, n_tokens: int) -> dict[str, np.ndarray]:
    """A shard of level two from its pair keys."""
    v = words.size
    word = keys % (v + 1)
    return build_level(keys // (v + 1) - low, word, counts, (words.counts(word) + 1) / (n_tokens + v + 1), low, high)


def find_children(a: dict[str, np.ndarray], context: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the shard, place among the context's children) of each child, -1 where it isn't stored; contexts are in order."""
    pointer, children = EliasFano.of(a, "pointer"), EliasFano.of(a, "child")
    new = np.ones(len(context), bool)
    new[1:] = context[1:] != context[:-1]
    u, inverse = context[new] - a["range"][0], np.cumsum(new) - 1
    start, end = pointer.access_both(u)
    base = np.zeros(len(u), np.int64)
    later = np.flatnonzero((start > 0) & (end > start))
    base[later] = children.access(start[later] - 1) + 1
    at = children.find(base[inverse] + child)
    ok = (at >= start[inverse]) & (at < end[inverse])
    return np.where(ok, at, -1), np.where(ok, at - start[inverse], -1)


def last_words(a: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The children at these places of a shard, each relative to its range: on level two, word ids."""
    pointer, children = EliasFano.of(a, "pointer"), EliasFano.of(a, "child")
    first = pointer.access(np.arange(int(a["range"][1] - a["range"][0]) + 1))
    start = first[np.searchsorted(first, at, "right") - 1]
    u, inverse = np.unique(start, return_inverse=True)
    base = np.zeros(len(u), np.int64)
    base[u > 0] = children.access(u[u > 0] - 1) + 1
    return children.access(at) - base[inverse]


def child_probs(a: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    return a["book"][a["code"][at]].astype(float)


def backoff(a: dict[str, np.ndarray], context: np.ndarray) -> np.ndarray:
    return a["back_book"][a["back"][context - a["range"][0]]].astype(float)


def _pieces(values: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(shard, slice) of the sorted values that lie in each shard."""
    cut = [*np.searchsorted(values, edges[:-1]), len(values)]
    yield from ((s, slice(x, y)) for s, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x)


class TrieModel:
    """A trained model: where its files are, how many pairs each shard holds, and the sums that smoothing needs."""

    def __init__(self, folder: str, words: Vocabulary, shards: int, n_tokens: int, pairs: np.ndarray, third: int = 0):
        self.folder, self.words, self.shards, self.n_tokens, self.third = folder, words, shards, n_tokens, third
        starts = np.concatenate([[0], np.cumsum(pairs)]).astype(np.int64)
        write_arrays(f"{folder}/pairs-index", {"starts": starts})
        self.n_pairs = int(starts[-1])

    @property
    def starts(self) -> np.ndarray:
        """The first pair id of each shard, and the end; tasks map them too."""
        return self._file("pairs-index")["starts"]

    @property
    def contexts(self) -> np.ndarray:
        """The first context of each shard, and the end."""
        return np.append(_shard_edges(self.shards, self.words.size), self.words.size + 1)

    def _file(self, name: str) -> dict[str, np.ndarray]:
        return kept_arrays(f"{self.folder}/{name}")

    def pair_edges(self) -> np.ndarray:
        """The first pair id of each shard of level three, and the end."""
        return np.array([self.n_pairs * s // max(self.third, 1) for s in range(self.third + 1)], np.int64)

    def pairs(self, tokens: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each token: training count, log10 p given the word before, pair id with it and place among its successors (-1: not stored)."""
        v = self.words.size
        u, inverse = np.unique(tokens, return_inverse=True)
        ids, counts = self.words.lookup(u)
        ids, counts = ids[inverse], counts[inverse]
        unigram = np.log10((counts + 1) / (self.n_tokens + v + 1))
        if not v:
            return counts, unigram, ids, ids
        word = np.where(ids < 0, v, ids)  # never stored, so found in no range
        context = np.empty_like(ids)
        context[1:] = ids[:-1]
        context[0:1] = v
        context[stop[:-1]] = v
        keys, inverse = np.unique(np.where(context < 0, -1, context * (v + 1) + word), return_inverse=True)
        p, back = np.full(len(keys), np.nan), np.zeros(len(keys))
        pair, place = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        begin = int(len(keys) > 0 and keys[0] < 0)
        for s, part in _pieces(keys[begin:], self.contexts * (v + 1)):
            part = slice(part.start + begin, part.stop + begin)
            a, c = self._file(f"pairs-{s}"), keys[part] // (v + 1)
            at, place[part] = find_children(a, c, keys[part] % (v + 1))
            pair[part] = np.where(at < 0, -1, at + self.starts[s])
            p[part] = np.where(at < 0, np.nan, child_probs(a, np.maximum(at, 0)) if len(a["code"]) else np.nan)
            back[part] = backoff(a, c)
        p = p[inverse]
        return counts, np.where(np.isnan(p), back[inverse] + unigram, p), pair[inverse], place[inverse]

    def log_probs(self, tokens: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count, log10 p given the two words before) of each token."""
        counts, p, pair, place = self.pairs(tokens, stop)
        if not self.third:
            return counts, p
        before = _pairs_before(pair, stop)
        ask = np.flatnonzero(before >= 0)
        order = ask[np.argsort(before[ask])]
        x, place = before[order], place[order]
        out = p[order]
        edges, size = self.pair_edges(), self.words.size + 1
        for s, part in _pieces(x, edges):
            a = self._file(f"triples-{s}")
            keys, inverse = np.unique((x[part] - edges[s]) * (size + 1) + np.where(place[part] < 0, size, place[part]), return_inverse=True)
            context = keys // (size + 1) + edges[s]
            at, _ = find_children(a, context, keys % (size + 1))
            stored = np.where(at < 0, np.nan, child_probs(a, np.maximum(at, 0)) if len(a["code"]) else np.nan)[inverse]
            out[part] = np.where(np.isnan(stored), backoff(a, context)[inverse] + out[part], stored)
        p[order] = out
        return counts, p

    def successors(self, low: int, high: int) -> np.ndarray:
        """For the pairs from ``low`` to ``high`` (exclusive): the first pair id of the successors of its second word."""
        ids = np.arange(low, high)
        word = np.empty(len(ids), np.int64)
        for s, part in _pieces(ids, self.starts):
            word[part] = last_words(self._file(f"pairs-{s}"), ids[part] - self.starts[s])
        u, inverse = np.unique(word, return_inverse=True)
        first = np.empty(len(u), np.int64)
        for s, part in _pieces(u, self.contexts):
            a = self._file(f"pairs-{s}")
            first[part] = EliasFano.of(a, "pointer").access(u[part] - a["range"][0]) + self.starts[s]
        return first[inverse]

    def pair_probs(self, pair: np.ndarray) -> np.ndarray:
        """The probability that level two stores for each pair id."""
        u, inverse = np.unique(pair, return_inverse=True)
        p = np.empty(len(u))
        for s, part in _pieces(u, self.starts):
            p[part] = child_probs(self._file(f"pairs-{s}"), u[part] - self.starts[s])
        return 10 ** p[inverse]


def _pairs_before(pair: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each token the pair id of the token before it; -1 at the beginning of a text."""
    before = np.empty_like(pair)
    before[1:] = pair[:-1]
    before[0:1] = -1
    before[stop[:-1]] = -1
    return before


def _count_triples(model: TrieModel, step: int):
    """Counts dealt to runs of ``step`` shards of level three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _Triples(model.pair_edges()[:-1:step], model.words.size)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text"), SLICE):
                tokens, stop = token_stream(data, offsets)
                _, _, pair, place = model.pairs(tokens, stop)
                before = _pairs_before(pair, stop)
                ok = before >= 0
                counted.add(before[ok], place[ok])
                if counted.n > HELD:
                    yield from counted.flush()
        yield from counted.flush()

    return run


def _split_triples(model: TrieModel, step: int):
    """The second pass where there are many shards: a task holds no more than the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, size = model.pair_edges()[:-1], model.words.size + 1
        counted: dict[int, _Triples] = {}
        for batch in batches:
            for r in batch.to_pylist():
                low = r["block"] * step
                t = counted.setdefault(low, _Triples(edges[low : low + step], model.words.size, low))
                k = unpack(r["k"], delta=True).astype(np.int64)
                t.add(k // size + edges[low], k % size, unpack(r["c"]).astype(np.int64))
                if t.n > HELD:
                    yield from t.flush()
        for low in sorted(counted):
            yield from counted[low].flush()

    return run


def train(docs: DataFrame, text_col: str = "text", block_bytes: int = 32 << 20, order: int = 3) -> TrieModel:
    """Count all texts of ``docs`` and store the model in the shared folder. No text gives an empty model. ``order`` is 2 or 3."""
    scratch = Scratch(docs.sparkSession, "language-model")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(4, -(-total // block_bytes))
    folder = f"{scratch.top}/model"
    words = dealt(lambda e: texts.mapInArrow(_count_words(e), Tally.schema), blocks, hash_edges(blocks)).groupBy("block").applyInPandas(_vocabulary_block(folder), "block int, n long, tokens long, bytes long")
    words = words.collect()  # one row of sizes a block
    vocabulary = Vocabulary(folder, {r["block"]: r["n"] for r in words}, blocks)
    n_tokens = sum(r["tokens"] for r in words)
    sizes = np.zeros(blocks, np.int64)
    if not vocabulary.size:
        return TrieModel(folder, vocabulary, blocks, n_tokens, sizes)
    none = np.zeros(0, np.int64)

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(pdf)
        s = int(pdf["block"].iloc[0])
        size = write_arrays(f"{folder}/pairs-{s}", build_shard(keys, counts, *_shard_range(s, blocks, vocabulary.size), vocabulary, n_tokens))
        return pd.DataFrame([(s, len(keys), size)], columns=["block", "n", "bytes"])

    firsts = _shard_edges(blocks, vocabulary.size) * (vocabulary.size + 1)
    pairs = dealt(lambda e: texts.mapInArrow(_count_pairs(vocabulary, e), Tally.schema), blocks, firsts).groupBy("block").applyInPandas(shard, "block int, n long, bytes long")
    for r in pairs.collect():
        sizes[r["block"]] = r["n"]
    for s in np.flatnonzero(sizes == 0).tolist():  # contexts that nothing follows
        write_arrays(f"{folder}/pairs-{s}", build_shard(none, none, *_shard_range(s, blocks, vocabulary.size), vocabulary, n_tokens))
    if order == 2:
        return TrieModel(folder, vocabulary, blocks, n_tokens, sizes)
    model = TrieModel(folder, vocabulary, blocks, n_tokens, sizes, blocks * THIRD)
    shards = model.third

    def third(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(pdf)
        s = int(pdf["block"].iloc[0])
        keys = keys.astype(np.int64)
        context, place = keys // (vocabulary.size + 1), keys % (vocabulary.size + 1)
        low, high = (model.n_pairs * x // shards for x in (s, s + 1))
        lower = model.pair_probs(model.successors(low, high)[context] + place)
        size = write_arrays(f"{folder}/triples-{s}", build_level(context, place, counts, lower, low, high))
        return pd.DataFrame([(s, len(keys), size)], columns=["block", "n", "bytes"])

    step = 1 if shards <= WIDE else int(np.ceil(np.sqrt(shards)))
    counted = texts.mapInArrow(_count_triples(model, step), Tally.schema)
    if step > 1:
        counted = counted.repartition(-(-shards // step), "block").sortWithinPartitions("block").mapInArrow(_split_triples(model, step), Tally.schema)
    made = {r["block"] for r in counted.groupBy("block").applyInPandas(third, "block int, n long, bytes long").collect()}
    for s in set(range(shards)) - made:
        write_arrays(f"{folder}/triples-{s}", build_level(none, none, none, none, *(model.n_pairs * x // shards for x in (s, s + 1))))
    return model


def score(docs: DataFrame, model: TrieModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns per row: ``id_col``, n_tokens, n_known, base_score (add-one unigrams), score, both log10.

    Tokens are runs of bytes other than ASCII white space, A-Z lower-cased, and one end a text. A null
    text is empty and has the end only. Null and repeated ids pass through; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text"), SLICE):
                tokens, stop = token_stream(data, offsets)
                counts, p = model.log_probs(tokens, stop)
                begin = np.concatenate([[0], stop[:-1]])
                base = np.add.reduceat(np.log10((counts + 1) / (model.n_tokens + model.words.size + 1)), begin)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(stop - begin), pa.array(np.add.reduceat((counts > 0).astype(np.int64), begin)), pa.array(base), pa.array(np.add.reduceat(p, begin))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("doc_id", id_col)


def held_out(modulus: int, id_col: str = "doc_id") -> Column:
    """True where the CRC-32 of the id as text leaves the remainder 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == 2, F.lit(False))
