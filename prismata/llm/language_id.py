"""Language identification: one interpolated Kneser-Ney character model a language, in sorted hash arrays.

Characters are predicted inside runs of letters, from a run's start to its end mark, so a word's score
is the same wherever it stands and each different word of a piece of text is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prismata.llm.kernels import mix, pack, powers, ragged, text_slices, unpack, word_bounds, word_hashes
from prismata.llm.scratch import small_batches

START, STOP = 1, 2  # code points that mark a run's edges
ALPHABET = 1 << 16  # symbols among which the lowest order spreads what it holds back
_letter: list[np.ndarray] = []


def is_letter(points: np.ndarray) -> np.ndarray:
    if not _letter:
        _letter.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    return _letter[0][points]


class Runs:
    """The letter runs of a piece of text, each different white-space word once."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = word_bounds(data, offsets)
        self.text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        _, where, self.word = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        length = ends[where] - starts[where] + 1
        taken = ragged(starts[where], length)
        raw = np.where(np.arange(len(taken)) == np.repeat(np.cumsum(length) - 1, length), 32, data[np.minimum(taken, max(len(data) - 1, 0))]).astype(np.uint8) if len(taken) else np.zeros(0, np.uint8)
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
        gap = points == 32
        word = np.cumsum(gap) - gap
        letter = is_letter(points) if len(points) else gap
        begin = letter & ~np.concatenate([[False], letter[:-1]])
        finish = letter & ~np.concatenate([letter[1:], [False]])
        # each run becomes START, its letters, STOP
        width = letter.astype(np.int64) + begin + finish
        at = np.cumsum(width) - width
        self.symbols = np.zeros(int(width.sum()), np.uint64)
        self.symbols[(at + begin)[letter]] = points[letter]
        self.symbols[at[begin]] = START
        self.symbols[(at + width - 1)[finish]] = STOP
        self.owner = np.repeat(word, width)  # the different word that a symbol belongs to
        head = np.flatnonzero(self.symbols == START)
        self.into = np.arange(len(self.symbols)) - np.repeat(head, np.diff(np.append(head, len(self.symbols)))) if len(head) else np.zeros(0, np.int64)
        self.n_words = len(where)

    def grams(self, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The places of predicted symbols; for k = 1..order the hash of the k symbols that end there, 0 where the run is shorter."""
        at = np.flatnonzero(self.into > 0)
        into, total, out = self.into[at], np.zeros(len(at), np.uint64), []
        for k in range(order):
            ok = into >= k
            total = total + np.where(ok, mix(self.symbols[np.maximum(at - k, 0)]), 0) * powers(order + 2)[k + 1]
            out.append(np.where(ok, mix(total + np.uint64(k + 1)), np.uint64(0)))
        return at, out

    def contexts(self, at: np.ndarray, order: int) -> list[np.ndarray]:
        """For k = 1..order - 1 the hash of the k symbols before each place, made as ``grams`` makes it."""
        into, total, out = self.into[at], np.zeros(len(at), np.uint64), []
        for k in range(order - 1):
            ok = into - 1 >= k
            total = total + np.where(ok, mix(self.symbols[np.maximum(at - 1 - k, 0)]), 0) * powers(order + 2)[k + 1]
            out.append(np.where(ok, mix(total + np.uint64(k + 1)), np.uint64(0)))
        return out


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, weights, len(u))


def _at(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), other)
    k = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[k] == asked, values[k], other)


def kneser_ney(runs: Runs, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 1..order: sorted gram hashes and log2 p of each; sorted context hashes and log2 back-off weight of each.

    Grams of the highest order, and those that begin a run, count as often as they occur; the others by
    the number of different symbols seen before them. One discount an order, n1 / (n1 + 2 * n2).
    """
    at, grams = runs.grams(order)
    contexts = [np.zeros(len(at), np.uint64), *runs.contexts(at, order)]
    times = np.bincount(runs.word, minlength=runs.n_words)[runs.owner[at]].astype(float)
    into = runs.into[at]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(1, order + 1):
        valid = into >= k - 1
        if k < order:
            _, once = np.unique(grams[k], return_index=True)  # a longer gram counts once towards the one it ends with
            single = np.zeros(len(at))
            single[once] = 1
            weight = np.where(into == k - 1, times, np.where(into >= k, single, 0))
        else:
            weight = times
        g, where = np.unique(grams[k - 1][valid], return_index=True)
        first = np.flatnonzero(valid)[where]
        count = _at(*_sums(grams[k - 1][valid], weight[valid]), g, 0.0)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        ctx = contexts[k - 1][first]
        c, total = _sums(ctx, count)
        kinds = _at(*_sums(ctx, np.ones(len(ctx))), c, 0.0)
        back = d * kinds / total
        if k == 1:
            lower = np.full(len(g), 1 / ALPHABET)
        else:
            lower = np.exp2(_at(out[k - 2][0], out[k - 2][1], grams[k - 2][first], 0.0))
        p = np.maximum(count - d, 0) / _at(c, total, ctx, 1.0) + _at(c, back, ctx, 1.0) * lower
        out.append((g, np.log2(p), c, np.log2(back)))
    return out


class Model:
    """The models of all languages: per order one sorted array of hashes and a row of values for each."""

    def __init__(self, langs: list[str], order: int, parts: dict[str, list[tuple[np.ndarray, ...]]]):
        self.langs, self.order = langs, order
        self.grams, self.backs = [], []
        for k in range(order):
            self.grams.append(self._union([parts[x][k][:2] for x in langs], np.nan))
            self.backs.append(self._union([parts[x][k][2:] for x in langs], 0.0))
        self.sharpness = 10.0
        self.usual: list[tuple[float, float, float]] = [(0.0, 1.0, 1.0)] * len(langs)  # of a language's own texts: mean entropy, and its variance as a + b / symbols
        self.limit = np.full(len(langs), np.inf)  # standard deviations above the mean from which on a text is rejected

    @staticmethod
    def _union(tables: list[tuple[np.ndarray, np.ndarray]], other: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *[t[0] for t in tables]]))
        values = np.full((len(keys), len(tables)), other, np.float32)
        for j, (k, v) in enumerate(tables):
            values[np.searchsorted(keys, k), j] = v
        return keys, values

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits a symbol of each text under each language, symbols of each text)."""
        runs, n = Runs(data, offsets), len(offsets) - 1
        at, grams = runs.grams(self.order)
        if not len(at) or not self.langs:
            return np.zeros((n, len(self.langs))), np.zeros(n, np.int64)
        longest = np.minimum(runs.into[at] + 1, self.order) - 1
        keys = np.choose(longest, grams)
        _, pick, inverse = np.unique(keys, return_index=True, return_inverse=True)
        grams, into = [g[pick] for g in grams], runs.into[at[pick]]
        contexts = [np.zeros(len(pick), np.uint64), *runs.contexts(at[pick], self.order)]
        bits = np.full((len(pick), len(self.langs)), np.nan)
        carried = np.zeros((len(pick), len(self.langs)))
        for k in range(self.order, 0, -1):
            valid = np.flatnonzero(into >= k - 1)
            row = self._row(self.grams[k - 1], grams[k - 1][valid], np.nan) + carried[valid]
            old = bits[valid]
            bits[valid] = np.where(np.isnan(old), row, old)
            carried[valid] += self._row(self.backs[k - 1], contexts[k - 1][valid], 0.0)
        bits = np.where(np.isnan(bits), carried - np.log2(ALPHABET), bits)
        per_word = np.zeros((runs.n_words, len(self.langs)))
        owner = runs.owner[at]
        for j in range(len(self.langs)):
            per_word[:, j] = np.bincount(owner, bits[inverse, j], runs.n_words)
        symbols = np.bincount(owner, minlength=runs.n_words)
        length = np.bincount(runs.text, symbols[runs.word], n).astype(np.int64)
        total = np.stack([np.bincount(runs.text, per_word[runs.word, j], n) for j in range(len(self.langs))], 1)
        return -total / np.maximum(length, 1)[:, None], length

    @staticmethod
    def _row(table: tuple[np.ndarray, np.ndarray], asked: np.ndarray, other: float) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return np.full((len(asked), values.shape[1]), other)
        k = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where((keys[k] == asked)[:, None], values[k], other)

    def decide(self, entropy: np.ndarray, length: np.ndarray) -> list[tuple[str, float, bool, float | None]]:
        """(language, score, rejected, bits a symbol) of each text; ``und`` where it has no letter."""
        out = []
        for e, n in zip(entropy, length, strict=True):
            if not n or not self.langs:
                out.append(("und", 0.0, True, None))
                continue
            best = int(np.argmin(e))
            sure = 1 / np.exp2(-self.sharpness * (e - e[best])).sum()
            over = self.above(best, e[best], n) / self.limit[best]
            out.append((self.langs[best], float(sure / max(1.0, over)), bool(over > 1), float(e[best])))
        return out

    def above(self, lang: int, entropy: np.ndarray | float, length: np.ndarray | float) -> np.ndarray | float:
        """How many standard deviations an entropy lies above the language's mean; short texts scatter more."""
        mean, a, b = self.usual[lang]
        return (entropy - mean) / np.sqrt(a + b / length)

    def calibrate(self, own: np.ndarray, entropy: np.ndarray, length: np.ndarray, reject: float) -> None:
        """Fit sharpness, usual entropies and limits to texts whose language is known and which were not counted.

        Sharpness has the least cross-entropy towards labels that are smoothed by half a text, so that it stays
        finite where all texts are told apart. A language's limit lets all but a share ``reject`` of its texts pass.
        """
        n, langs = len(own), len(self.langs)
        gap = entropy - entropy.min(1, keepdims=True)
        wrong = 0.5 / (n + 1) if langs > 1 else 0.0
        mine = gap[np.arange(n), own]
        others = (gap.sum(1) - mine) / max(langs - 1, 1)
        pull = ((1 - wrong) * mine + wrong * others).sum()
        grid = np.exp2(np.arange(-8, 33) / 2)
        loss = [s * pull + np.log2(np.exp2(-s * gap).sum(1)).sum() for s in grid]
        self.sharpness = float(grid[int(np.argmin(loss))])
        for k in range(langs):
            its = own == k
            if not its.any():
                continue
            e, m = entropy[its, k], length[its].astype(float)
            mean = float(np.average(e, weights=np.sqrt(m)))
            square, short = (e - mean) ** 2, 1 / m
            slope = max(0.0, float(np.cov(short, square)[0, 1] / short.var())) if len(e) > 2 and short.var() > 0 else 0.0
            level = max(float(square.mean() - slope * short.mean()), 0.02**2)
            self.usual[k] = (mean, level, slope)
            self.limit[k] = max(float(np.quantile(self.above(k, e, m), 1 - reject)), 3.0)


def _learn(order: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lang = pdf["lang"].iloc[0]
        texts = pa.array(sorted(pdf["text"]), pa.large_string())
        (_, _, data, offsets), *_ = text_slices(texts, 1 << 40)
        parts = kneser_ney(Runs(data, offsets), order)
        return pd.DataFrame([(lang, k, *map(pack, p)) for k, p in enumerate(parts)], columns=["lang", "k", "g", "p", "c", "b"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 5, per_language: int = 1500, kept: float = 0.2, reject: float = 0.002) -> Model:
    """Learn from about ``per_language`` rows a language, drawn by a hash of the id: the bound of what is learnt from.

    A share ``kept`` of them is not counted and calibrates the model instead. Rows without text or language are left
    out; a language all of whose drawn texts have no letter is not learnt.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count"))
    place = F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1 << 20))
    drawn = rows.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang").where(place < F.col("share") * (1 << 20))
    aside = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < int(kept * (1 << 20))
    drawn = drawn.where(F.col("text").rlike(r"\p{L}")).select("lang", "text", aside.alias("aside"))
    got = drawn.where("not aside").groupBy("lang").applyInPandas(_learn(order), "lang string, k int, g binary, p binary, c binary, b binary").collect()
    parts: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["k"])):
        parts.setdefault(r["lang"], []).append(tuple(unpack(r[x]) for x in "gpcb"))
    model = Model(sorted(parts), order, parts)
    if model.langs:
        _calibrate(spark, model, drawn.where("aside").select("lang", "text"), reject)
    return model


def _calibrate(spark, model: Model, told: DataFrame, reject: float) -> None:
    """Calibrate on the rows set aside: a share of ``per_language`` rows a language, of which the driver gets a number for each language."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {x: k for k, x in enumerate(m.langs)}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, b, data, offsets in text_slices(batch.column("text")):
                e, n = m.entropies(data, offsets)
                own = np.array([place.get(langs[k], -1) for k in range(a, b)])
                ok = (own >= 0) & (n > 0)
                yield pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array(n[ok]), pa.array(list(e[ok]), pa.list_(pa.float64()))], names=["own", "n", "e"])

    rows = told.mapInArrow(run, "own long, n long, e array<double>").collect()
    if rows:
        order = sorted(range(len(rows)), key=lambda k: (rows[k]["own"], rows[k]["n"], rows[k]["e"]))  # sums don't depend on the order of tasks
        model.calibrate(np.array([rows[k]["own"] for k in order]), np.array([rows[k]["e"] for k in order]), np.array([rows[k]["n"] for k in order]), reject)
    shared.unpersist()


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns per row: ``id_col``, lang_pred, score (0 to 1), rejected, bits (a symbol, of the best language).

    The language with the fewest bits a symbol wins, the first by name on a tie. ``rejected`` marks texts whose
    bits lie above the limit that the language's own texts, those set aside while learning, keep to; it lowers the
    score and leaves the language.
    A text that is null or has no letter is ``und``, score 0. Null and repeated ids pass through; other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                said = m.decide(*m.entropies(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *[pa.array(x, t) for x, t in zip(zip(*said, strict=True), (pa.string(), pa.float64(), pa.bool_(), pa.float64()), strict=True)]], names=["doc_id", "lang_pred", "score", "rejected", "bits"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean, bits double").withColumnRenamed("doc_id", id_col)
