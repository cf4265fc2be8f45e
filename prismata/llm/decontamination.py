"""Benchmark decontamination: n-gram seeds join documents to test items, Smith-Waterman alignment scores what they meet.

The test items are the stated query set. They are laid out in blocks of bounded size, each a memory-mapped
file in the shared folder, and every task that reads documents meets all blocks in its one pass over them, so
documents are never shuffled and read once. All n-grams of an item are its seeds, whatever the corpus; a
window around the seeds met is aligned unless the words that it shares with the item cannot reach the
threshold. Items too short for an alignment are looked for as they stand.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from prismata.llm.kernels import NOT_ALNUM, SHORT_SLICE, ngram_hashes, text_slices, word_bounds, word_hashes
from prismata.llm.scratch import Scratch, small_batches
from prismata.llm.shared_files import map_arrays, write_arrays

STEM = 5  # bytes of a word's beginning that earn half a match
MATCH, STEM_MATCH, MISS, GAP = 2, 1, -1, -1
# Scripts written without spaces: each character is a word of its own.
UNSPACED = r"([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}])"


class Items:
    """One block of test items: word and stem hashes, the sorted n-gram hashes of all, and the short ones by length."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n = int(arrays["n"][0])
        self.gram, self.item, self.offset = (arrays[x] for x in ("gram", "item", "offset"))
        cut = arrays["cut"]
        self.ids = [i if known else None for i, known in zip(arrays["ids"].tolist(), arrays["known"].tolist(), strict=True)]
        self.words = [arrays["words"][a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.stems = [arrays["stems"][a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.short: dict[int, dict[int, list[int]]] = {}  # by length and hash: places of items that are too short for an alignment
        for k in np.flatnonzero(arrays["short"]).tolist():
            w = self.words[k]
            self.short.setdefault(len(w), {}).setdefault(int(ngram_hashes(w, len(w))[0]), []).append(k)

    @staticmethod
    def arrays(ids: list[int | None], texts: list[str | None], n: int, least: int) -> dict[str, np.ndarray]:
        words, stems, short, grams, items, offsets, own = [], [], [], [], [], [], []
        for a, _, data, bounds in text_slices(spaced(pa.array(texts, pa.string())), 1 << 40):
            starts, ends, first = word_bounds(data, bounds, NOT_ALNUM)
            w = word_hashes(data, starts, ends)
            s = word_hashes(data, starts, np.minimum(ends, starts + STEM))
            for k, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), a):
                if y - x < 2:
                    continue
                if y - x >= max(n, least):
                    g = ngram_hashes(w[x:y], n)
                    grams.append(g)
                    items.append(np.full(len(g), len(own), np.int32))
                    offsets.append(np.arange(len(g), dtype=np.int32))
                short.append(y - x < max(n, least))
                own.append(ids[k])
                words.append(w[x:y])
                stems.append(s[x:y])
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        gram = join(grams, np.uint64)
        order = np.argsort(gram, kind="stable")
        return {
            "n": np.array([n]), "gram": gram[order], "item": join(items, np.int32)[order], "offset": join(offsets, np.int32)[order], "ids": np.array([i or 0 for i in own], np.int64), "known": np.array([i is not None for i in own], np.uint8),
            "words": join(words, np.uint64), "stems": join(stems, np.uint64), "cut": np.cumsum([0, *map(len, words)]), "short": np.array(short, np.uint8),
        }

    @staticmethod
    @functools.lru_cache(2)
    def load(uri: str) -> Items:
        return Items(map_arrays(uri))


def spaced(texts: pa.Array) -> pa.Array:
    """The texts with spaces around the characters of scripts that have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data = texts.buffers()[2]
    if data is None or not (np.frombuffer(data, np.uint8) >= 0xE0).any():  # such characters are of three bytes or more
        return texts
    return pc.replace_substring_regex(texts, UNSPACED, r" \1 ")


def _doc_grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends, first word of each text, n-gram hashes, and the text of each n-gram (-1 where it runs over an edge)."""
    starts, ends, first = word_bounds(data, offsets, NOT_ALNUM)
    words = word_hashes(data, starts, ends)
    grams = ngram_hashes(words, n)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    owner = np.where(text[: len(grams)] == text[n - 1 :], text[: len(grams)], -1) if len(grams) else np.zeros(0, np.int64)
    return starts, ends, first, grams, owner


def smith_waterman(doc: np.ndarray, doc_stems: np.ndarray, item: np.ndarray, item_stems: np.ndarray) -> tuple[int, int]:
    """(best local score, end of the alignment in ``doc``, exclusive)."""
    steps = np.arange(len(doc) + 1) * -GAP
    row, best, end = np.zeros(len(doc) + 1, np.int64), 0, 0
    for w, s in zip(item, item_stems, strict=True):
        gain = np.where(doc == w, MATCH, np.where(doc_stems == s, STEM_MATCH, MISS))
        new = np.zeros(len(doc) + 1, np.int64)
        new[1:] = np.maximum(np.maximum(row[:-1] + gain, row[1:] + GAP), 0)
        row = np.maximum.accumulate(new + steps) - steps
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def _windows(diagonals: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of seed diagonals that one copy of an item may span."""
    d = np.sort(diagonals)
    cut = np.flatnonzero(np.diff(d) > length)
    return list(zip(d[np.concatenate([[0], cut + 1])].tolist(), d[np.concatenate([cut, [len(d) - 1]])].tolist(), strict=True))


def lay_out(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", n: int = 3, least_words: int = 8, block_bytes: int = 8 << 20) -> list[str]:
    """Write the items in blocks of about ``block_bytes`` of text, dealt at random, and name the files; they stay until the shared folder goes."""
    top = Scratch(benchmark.sparkSession, "benchmark").top
    tests = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))

    def write(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        k = table["block"][0].as_py()
        uri = f"{top}/items-{k}"
        write_arrays(uri, Items.arrays([i for i, _ in rows], [t for _, t in rows], n, least_words))
        return pa.table({"block": pa.array([k], pa.int32()), "uri": [uri]})

    dealt = tests.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
    return [r["uri"] for r in dealt.groupBy("block").applyInArrow(write, "block int, uri string").orderBy("block").collect()]  # a row for each block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 3, least_words: int = 8, threshold: float = 0.5, block_bytes: int = 8 << 20) -> DataFrame:
    """Find documents that hold a copy, edited or not, of a test item.

    Returns a row for each document row and item whose alignment reaches ``threshold`` of the score of an
    exact copy: ``id_col``, ``item_col``, score (0 to 1), first_word and last_word (of the best alignment,
    words from 0). Clean documents have no row. Ids of both tables are cast to long.

    Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lower-cased.
    In scripts without spaces each character is a word. Items of fewer than ``least_words`` words match where
    they stand unchanged, at their first place; those of one word tell no copy from chance and have no rows,
    nor have null ones. Null and empty documents match nothing. Null and repeated ids pass through, a row for each
    time; equal items each get their rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    uris = lay_out(benchmark, item_col, item_text, n, least_words, block_bytes)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = spaced(batch.column("text"))
            for uri in uris:
                out = _leaks(Items.load(uri), texts, threshold)
                ids = batch.column("doc_id").take(pa.array([r[0] for r in out], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[k] for r in out], kind) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]], names=["doc_id", "item_id", "score", "first_word", "last_word"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(align, "doc_id long, item_id long, score double, first_word long, last_word long").withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 3, least_words: int = 8, threshold: float = 0.5, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, whole, in whose own text no test item was found; ids decide nothing. Null and empty texts stay."""
    small_batches(docs.sparkSession)
    uris = lay_out(benchmark, item_col, item_text, n, least_words, block_bytes)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = spaced(batch.column(place).cast(pa.string()))
            clean = np.ones(batch.num_rows, bool)
            for uri in uris:
                clean[[r[0] for r in _leaks(Items.load(uri), texts, threshold)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def _leaks(its: Items, texts: pa.Array, threshold: float) -> list[tuple]:
    """(row, item id, score, first and last word) of what a block of items meets in texts."""
    n, out = its.n, []
    for a, _, data, offsets in text_slices(texts, SHORT_SLICE):
        starts, ends, first, grams, owner = _doc_grams(data, offsets, n)
        out += [(a + t, *rest) for t, *rest in _short(its, data, starts, ends, first)]
        low = np.searchsorted(its.gram, grams, "left")
        many = np.where(owner >= 0, np.searchsorted(its.gram, grams, "right") - low, 0)
        hit = np.repeat(np.flatnonzero(many), many[many > 0])
        if not len(hit):
            continue
        which = low[hit] + np.arange(len(hit)) - np.repeat(np.cumsum(many[many > 0]) - many[many > 0], many[many > 0])
        text, item = owner[hit], its.item[which]
        diagonal = hit - first[text] - its.offset[which]
        order = np.lexsort((item, text))
        text, item, diagonal = text[order], item[order], diagonal[order]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(item) != 0), [True]]))
        words: tuple[int, np.ndarray, np.ndarray] = (-1, starts, starts)
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            t, i = int(text[x]), int(item[x])
            if words[0] != t:
                s, e = starts[first[t] : first[t + 1]], ends[first[t] : first[t + 1]]
                words = (t, word_hashes(data, s, e), word_hashes(data, s, np.minimum(e, s + STEM)))
            best = _best(words[1], words[2], its.words[i], its.stems[i], diagonal[x:y], threshold)
            if best:
                out.append((a + t, its.ids[i], *best))
    return out


def _short(items: Items, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, score, first and last word) of each short item at its first place in each text."""
    words = word_hashes(data, starts, ends) if items.short else starts
    for size, its in items.short.items():
        grams = ngram_hashes(words, size)
        at = np.flatnonzero(np.isin(grams, np.array(list(its), np.uint64)))
        text = np.searchsorted(first, at, "right") - 1
        seen = set()
        for t, k in zip(text.tolist(), at.tolist(), strict=True):
            if k + size <= first[t + 1] and (t, grams[k]) not in seen:
                seen.add((t, grams[k]))
                for i in its[int(grams[k])]:
                    if (words[k : k + size] == items.words[i]).all():
                        yield t, items.ids[i], 1.0, k - int(first[t]), k - int(first[t]) + size - 1


def _best(words: np.ndarray, stems: np.ndarray, item: np.ndarray, item_stems: np.ndarray, diagonals: np.ndarray, threshold: float) -> tuple[float, int, int] | None:
    """The best alignment of an item over its windows in a text: (share of a copy's score, first and last word)."""
    best = None
    whole = MATCH * len(item)
    slack = len(item) // 2 + 2
    for low, high in _windows(diagonals, len(item)):
        a, b = max(0, low - slack), min(len(words), high + len(item) + slack)
        most = np.where(np.isin(item, words[a:b]), MATCH, np.where(np.isin(item_stems, stems[a:b]), STEM_MATCH, 0)).sum()
        if most < threshold * whole:  # no alignment scores more
            continue
        score, end = smith_waterman(words[a:b], stems[a:b], item, item_stems)
        if score >= threshold * whole and (best is None or score > best[0]):
            tail = slice(a, a + end)
            _, back = smith_waterman(words[tail][::-1], stems[tail][::-1], item[::-1], item_stems[::-1])
            best = (score, a + end - back, a + end - 1)
    return best and (best[0] / whole, best[1], best[2])
