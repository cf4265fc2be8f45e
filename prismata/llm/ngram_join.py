"""N-gram Jaccard join: a blocked sparse product of the document-by-shingle incidence matrix.

The product is never formed for all documents. A first pass counts a fixed part of the columns (shingles
whose hash falls below ``sample``) to learn which of them occur in several texts, and drops every row whose
shared columns cannot reach the bound that its size sets. Counts are summed before they move and columns are
looked up in memory-mapped tables, so a column that a third of all rows share is one entry of a block. Rows that
are left are gathered into families over their rarest columns, again by one entry a task and column; within a
family the product is computed in row blocks of bounded size, overlaps are counted exactly, and pairs below the
bound are discarded.

Texts with equal shingle sets are one row of the matrix (a class), so copies never meet in pairs. Shingles and
classes are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prismata.llm.components import connected_components
from prismata.llm.kernels import HELD, SHORT_SLICE, WIDE, Tally, dealt, local_components, merge_counts, mix, pack, ragged, shingle_sets, text_slices, unpack
from prismata.llm.scratch import Scratch
from prismata.llm.shared_files import map_arrays, write_arrays

CHUNK = 2_000_000  # sampled shingles that a task holds before it sends them out
CELL = 1_000_000  # shingles of one row block at most
SPREAD = 256  # row blocks into which all rows are cut at least, if these are not below a twentieth of CELL
TABLE = 250_000  # rows of a table of those that represent a class, about
LINKS = 2_000_000  # links of a cell that are held at a time


def set_class(shingles: np.ndarray) -> int:
    """A signed 64-bit id of a shingle set; 0 for the empty set."""
    if not len(shingles):
        return 0
    both = np.array([np.bitwise_xor.reduce(mix(shingles)), np.add.reduce(shingles)], np.uint64)
    h = mix(both[:1] + both[1:] * np.uint64(3) + np.uint64(len(shingles)))
    return int(h.view(np.int64)[0])


def _misses(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Columns of a row of size n that a linked row may lack: |A| - |A & B|, where |A & B| >= percent / 100 * |A|."""
    return (n * (100 - percent)) // 100


class Incidence:
    """Map side: the columns of runs of texts, dealt to ranges of hashes, and one row of sizes per text."""

    schema = "block int, a binary, b binary, c binary, d binary"

    def __init__(self, edges: np.ndarray, width: int, percent: int, sample: float):
        self.edges, self.width, self.percent = edges, width, percent
        self.below = np.uint64(int(sample * 2**64))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.reset()
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            known = ~np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0))
            for a, b, data, offsets in text_slices(batch.column(1), SHORT_SLICE):
                for k, s in enumerate(shingle_sets(data, offsets, self.width), a):
                    self.add(ids[k], known[k], s)
                if self.held > CHUNK:
                    yield from self.flush()
        yield from self.flush()

    def reset(self) -> None:
        self.rows: list[tuple[int, bool, int, int, int]] = []
        self.seen: set[int] = set()
        self.parts: list[np.ndarray] = []
        self.owners: list[tuple[int, int]] = []
        self.held = 0

    def add(self, doc: int, known: bool, s: np.ndarray) -> None:
        c, n = set_class(s), len(s)
        low = int(np.searchsorted(s, self.below))
        self.rows.append((int(doc), bool(known), c, n, low))
        if n and c not in self.seen:
            self.seen.add(c)
            sent = s if low <= _misses(n, self.percent) else s[:low]  # a row that sampling leaves too little of sends all
            self.parts.append(sent)
            self.owners.append((c, len(sent)))
            self.held += len(sent)
        self.held += 4

    def flush(self) -> Iterator[pa.RecordBatch]:
        out = []
        if self.rows:
            t = list(zip(*self.rows, strict=True))
            out.append((-1, pack(np.array(t[0], np.int64)), pack(np.array(t[1], np.uint8)), pack(np.array(t[2], np.int64)), pack(np.array([t[3], t[4]], np.int32).reshape(-1))))
        if self.parts:
            h = np.concatenate(self.parts)
            owner = np.repeat(np.arange(len(self.owners)), [n for _, n in self.owners]).astype(np.uint32)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            names = np.array([c for c, _ in self.owners], np.int64)
            cut = [*np.searchsorted(h, self.edges), len(h)]
            for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if y > x:
                    who, local = np.unique(owner[x:y], return_inverse=True)
                    out.append((k, pack(h[x:y], delta=True), pack(local.astype(np.uint16 if len(who) < 65536 else np.uint32)), pack(names[who]), b""))
        self.reset()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["block", "a", "b", "c", "d"])


def _edges(blocks: int, below: np.uint64) -> np.ndarray:
    """Lower ends of the hash ranges: ``blocks`` below the sampling bound, where most columns are, and as many above it."""
    part = np.arange(blocks, dtype=np.float64) / blocks
    return np.concatenate([(part * float(below)).astype(np.uint64), below + (part * (2.0**64 - float(below))).astype(np.uint64)])


def _column_counts(edges: np.ndarray):
    """Map side: in how many classes of a task each column occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for x in batch.column("a").to_pylist():
                tally.add(unpack(x, delta=True))
                if tally.n > HELD:
                    yield from tally.flush(edges)
        yield from tally.flush(edges)

    return run


def _shared_columns(folder: str):
    """Reduce side of a block of columns: a table of those that occur more than once, with their counts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, n = merge_counts(np.concatenate([unpack(x, delta=True) for x in pdf["k"]]), np.concatenate([unpack(x) for x in pdf["c"]]).astype(np.int64))
        k = int(pdf["block"].iloc[0])
        write_arrays(f"{folder}/columns-{k}", {"h": h[n > 1], "n": np.minimum(n[n > 1], 2**32 - 1).astype(np.uint32)})
        return pd.DataFrame({"block": [k]})

    return run


class Shared:
    """The columns of each class that other classes have too, with their counts, dealt to buckets of classes.

    Each row of columns needs the tables of its own range only, so the rows of a range may be read in any number of tasks.
    ``step`` neighbouring ranges, or buckets, go by one number where there are so many that a second pass splits them.
    """

    schema = "block int, a binary, b binary, c binary, d binary"

    def __init__(self, folder: str, edges: np.ndarray, buckets: int, step: int):
        self.folder, self.edges, self.buckets, self.step = folder, edges, buckets, step

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last, tables = -1, {}
        for batch in batches:
            for r in batch.to_pylist():
                if self.step > 1 and r["block"] != last:  # ordered by range, so that a table is opened once
                    last, tables = r["block"], {}
                h, cls = unpack(r["a"], delta=True), unpack(r["c"])[unpack(r["b"])]
                first = r["block"] * self.step
                cut = [*np.searchsorted(h, self.edges[first : first + self.step]), len(h)]
                for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True), first):
                    if y > x:
                        table = tables[k] if k in tables else tables.setdefault(k, map_arrays(f"{self.folder}/columns-{k}"))
                        if len(table["h"]):
                            at = np.minimum(np.searchsorted(table["h"], h[x:y]), len(table["h"]) - 1)
                            ok = table["h"][at] == h[x:y]
                            parts.append((h[x:y][ok], cls[x:y][ok], table["n"][at[ok]]))
                if sum(len(p[0]) for p in parts) > CHUNK:
                    yield from self.flush(parts)
                    parts = []
        if parts:
            yield from self.flush(parts)

    def flush(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield from deal_classes(h, c, n, self.buckets, self.step)


def deal_classes(h: np.ndarray, c: np.ndarray, n: np.ndarray, buckets: int, step: int) -> Iterator[pa.RecordBatch]:
    """Columns, classes and counts, packed for each run of ``step`` buckets of classes."""
    bucket = (mix(c.view(np.uint64)) % np.uint64(buckets)).astype(np.int64) // step
    order = np.lexsort((h, bucket))
    h, c, n, bucket = h[order], c[order], n[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0, [True]])) if len(h) else [0]
    out = [(int(bucket[x]), pack(h[x:y], delta=True), pack(c[x:y]), pack(n[x:y]), b"") for x, y in zip(cut[:-1], cut[1:], strict=True)]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["block", "a", "b", "c", "d"])


def _split_classes(buckets: int):
    """The second pass of dealing to buckets: a task holds no more than the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for r in batch.to_pylist():
                parts.append((unpack(r["a"], delta=True), unpack(r["b"]), unpack(r["c"])))
                if sum(len(p[0]) for p in parts) > CHUNK:
                    yield from deal_classes(*(np.concatenate(x) for x in zip(*parts, strict=True)), buckets, 1)
                    parts = []
        if parts:
            yield from deal_classes(*(np.concatenate(x) for x in zip(*parts, strict=True)), buckets, 1)

    return run


def _survivors(edges: np.ndarray, below: np.uint64, percent: int):
    """Reduce side of a bucket of classes: of the rows that the bound keeps, their rarest columns.

    Of the classes here that share such a column one goes on for it, to the column's block; the others are tied to
    that one by edges, which are rows of block -1.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes, posts = pdf[pdf["d"].str.len() > 0], pdf[pdf["d"].str.len() == 0]
        none = pd.DataFrame([], columns=["block", "a", "b"])
        if not len(posts):
            return none
        c = np.concatenate([unpack(x) for x in posts["b"]])
        h = np.concatenate([unpack(x, delta=True) for x in posts["a"]])
        df = np.concatenate([unpack(x) for x in posts["c"]])
        keys, first = np.unique(np.concatenate([unpack(x) for x in sizes["c"]]), return_index=True)
        n, low = (np.concatenate([unpack(x).reshape(2, -1)[k] for x in sizes["d"]])[first].astype(np.int64) for k in (0, 1))
        order = np.lexsort((h, df, c))
        c, h, df = c[order], h[order], df[order]
        new = np.ones(len(c), bool)  # copies in several tasks sent their columns several times
        new[1:] = (c[1:] != c[:-1]) | (h[1:] != h[:-1])
        c, h = c[new], h[new]
        at = np.searchsorted(keys, c)
        start = np.searchsorted(c, keys)
        rank = np.arange(len(c)) - start[at]
        inside = h < below
        shared = np.bincount(at[inside], minlength=len(keys))
        miss = _misses(n, percent)
        full = low <= miss
        alone = np.where(full, n, low) - np.bincount(at, minlength=len(keys))  # columns that no other row has come first in the order
        keep = (full | (shared >= low - miss))[at] & (full[at] | (rank + alone[at] <= miss[at]))
        h, head, ties = _heads(h[keep], c[keep])
        block = np.searchsorted(edges, h, "right") - 1
        out = [(-1, pack(ties[0]), pack(ties[1]))] if len(ties[0]) else []
        for k in np.unique(block):
            m = block == k
            out.append((int(k), pack(h[m], delta=True), pack(head[m])))
        return pd.DataFrame(out, columns=["block", "a", "b"]) if out else none

    return run


def _heads(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The distinct columns in order, one class of each, and edges (class, other class) that tie those who share one."""
    names, c = np.unique(c, return_inverse=True)
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    head = c[np.flatnonzero(new)]
    root = local_components(c, head[np.cumsum(new) - 1], len(names)) if len(c) else np.zeros(0, np.int64)
    tied = root != np.arange(len(names))
    return h[new], names[head], (names[tied], names[root[tied]])


def _stars(pdf: pd.DataFrame) -> pd.DataFrame:
    """Reduce side of a block of rare columns: edges that tie the classes which go on for a column from several buckets."""
    _, _, edges = _heads(np.concatenate([unpack(x, delta=True) for x in pdf["a"]]), np.concatenate([unpack(x) for x in pdf["b"]]))
    return pd.DataFrame({"a": edges[0], "b": edges[1]})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of packed rows."""
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(unpack(r["a"])), pa.array(unpack(r["b"]))], names=["a", "b"])


ROW = ("fam", "ci", "k", "cls", "mult")


def _represented(folder: str):
    """Reduce side of a range of ids: a table of the classes whose smallest id is in it, by id and class."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, pdf = int(pdf["at"].iloc[0]), pdf.sort_values(["least", "cls"])
        write_arrays(f"{folder}-{k}", {name: pdf[name].to_numpy() for name in ("least", *ROW)})
        return pd.DataFrame({"at": [k]})

    return run


class Shingles:
    """Map side of the exact product: whole shingle sets of the rows that represent a class.

    They are found in memory-mapped tables, so that neither do texts move nor does the driver hold what every task needs.
    """

    schema = "fam long, ci int, k int, cls long, mult long, n int, s binary"

    def __init__(self, width: int, folder: str, written: set[int]):
        self.width, self.folder, self.written = width, folder, written

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: map_arrays(f"{self.folder}-{k}") for k in self.written}
        for batch in batches:
            at, ids = np.asarray(batch.column("at")), np.asarray(batch.column("doc_id").fill_null(0))
            lo, hi = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for k in self.written.intersection(at.tolist()):
                m = at == k
                lo[m], hi[m] = (np.searchsorted(tables[k]["least"], ids[m], side) for side in ("left", "right"))
            rows = np.flatnonzero(lo < hi)
            for a, b, data, offsets in text_slices(batch.column("text").take(pa.array(rows)), SHORT_SLICE):
                out = []
                for r, s in zip(rows[a:b].tolist(), shingle_sets(data, offsets, self.width), strict=True):
                    table, cls = tables[at[r]], set_class(s)
                    x = lo[r] + np.searchsorted(table["cls"][lo[r] : hi[r]], cls)
                    if x < hi[r] and table["cls"][x] == cls:  # a repeated doc_id brings other texts too
                        out.append((*[table[name][x] for name in ROW], len(s), pack(s, delta=True)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=[*ROW, "n", "s"])


def _cell(p: pd.DataFrame, percent: int, same: bool) -> list[tuple[int, int, int]]:
    """Exact overlaps of the rows of one row block, or of two: (class, root, linked documents) per linked class."""
    p = p.drop_duplicates("cls")
    m = len(p)
    sets = [unpack(x, delta=True) for x in p["s"]]
    n = np.array([len(s) for s in sets])
    side, mult = p["ci"].to_numpy(), p["mult"].to_numpy()
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), n)
    shared = count[col] > 1
    row, col = row[shared], col[shared]
    by = np.argsort(col, kind="stable")
    post, bounds = row[by], np.concatenate([[0], np.cumsum(np.bincount(col, minlength=len(count)))])
    at = np.searchsorted(row, np.arange(m + 1))
    ea, eb, links, root, held = [], [], np.zeros(m, np.int64), np.arange(m), 0
    for i in range(m):
        cols = col[at[i] : at[i + 1]]
        if len(cols) < n[i] - _misses(n[i], percent):
            continue
        near = post[ragged(bounds[cols], bounds[cols + 1] - bounds[cols])]
        if len(near) * 4 < m:  # few of many rows are met
            j, overlap = np.unique(near, return_counts=True)
        else:
            overlap = np.bincount(near, minlength=m)
            j = np.flatnonzero(overlap)
            overlap = overlap[j]
        hit = (100 * overlap >= percent * (n[j] + n[i] - overlap)) & (j != i)
        if not same:
            hit &= side[j] != side[i]
        j = j[hit]
        if len(j):
            links[i] = mult[j].sum()
            ea.append(np.full(len(j), i))
            eb.append(j)
            held += len(j)
        if held > LINKS:  # of the links so far only what they connect is kept
            root = _joined(root, ea, eb)
            ea, eb, held = [], [], 0
    root = _joined(root, ea, eb)
    cls = p["cls"].to_numpy()
    return [(int(cls[i]), int(cls[root[i]]), int(links[i])) for i in np.flatnonzero((links > 0) | (root != np.arange(m)))]


def _joined(root: np.ndarray, ea: list[np.ndarray], eb: list[np.ndarray]) -> np.ndarray:
    """Components of what was connected before and of new edges."""
    every = np.arange(len(root))
    return local_components(np.concatenate([every, *ea]), np.concatenate([root, *eb]), len(root))


def _products(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, lo, hi), p in pdf.groupby(["fam", "lo", "hi"], sort=False):
            if len(p) > 1:
                out += _cell(p, percent, lo == hi)
        return pd.DataFrame(out, columns=["a", "b", "links"])

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, sample: float = 0.4, block_bytes: int = 16 << 20) -> DataFrame:
    """Link documents whose ``width``-word shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns per row of ``docs``: ``id_col``, n_shingles (set size), n_links (documents linked with it),
    component_id (smallest id reachable over links, itself included). The answer is exact; ``sample`` and
    ``block_bytes`` move work about and never change it. Ids are cast to long.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer words is one
    shingle. Null, empty and blank texts have the empty set and are linked with nothing. A null id gives
    a null component unless the row is linked with one that has an id. A repeated id gives a row for each
    time; its component is the smallest over all its rows' links of their own. Other columns are not read. Empty input gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(4, -(-total // block_bytes))
    below = np.uint64(int(sample * 2**64))
    edges = _edges(blocks, below)
    step = 1 if len(edges) <= WIDE else int(np.ceil(np.sqrt(len(edges))))
    sent = scratch.write(docs.mapInArrow(Incidence(edges[::step], width, percent, sample), Incidence.schema), "incidence")
    columns = sent.where("block >= 0")
    counts = dealt(lambda e: columns.select("a").mapInArrow(_column_counts(e), Tally.schema), len(edges), edges)
    counts.groupBy("block").applyInPandas(_shared_columns(f"{scratch.top}/columns"), "block int").count()  # writes the tables
    # up to ``WIDE`` tables a task opens all; beyond that it gets rows of few ranges, and any cut of a large range will do
    near = columns.hint("rebalance", "block").sortWithinPartitions("block") if step > 1 else columns
    shared = near.mapInArrow(Shared(f"{scratch.top}/columns", edges, blocks, step), Shared.schema)
    if step > 1:
        shared = shared.repartition(-(-blocks // step), "block").mapInArrow(_split_classes(blocks), Shared.schema)
    table = scratch.write(sent.where("block = -1").mapInArrow(_table, "doc_id long, cls long, n int, low int"), "sizes")
    sizes = table.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("mult"), F.min("n").alias("n"), F.min("low").alias("low"))
    classes = scratch.write(sizes, "classes")
    bucketed = classes.mapInArrow(_Bucketed(blocks), Incidence.schema)
    rare = scratch.write(shared.unionByName(bucketed).groupBy("block").applyInPandas(_survivors(edges, below, percent), "block int, a binary, b binary"), "rare")
    stars = rare.where("block >= 0").groupBy("block").applyInPandas(_stars, "a long, b long").unionByName(rare.where("block = -1").mapInArrow(_unpacked, "a long, b long"))
    families = connected_components(stars, scratch, "families").select(F.col("id").alias("cls"), F.col("root").alias("fam"))
    members = scratch.write(families.join(classes, "cls").select("cls", "fam", "mult", "n", "least"), "members")
    reps, weight = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    cell = max(CELL // 20, min(CELL, weight // SPREAD))  # smaller where there is little, so that a hot family is still in many tasks
    wide = members.groupBy("fam").agg(F.ceil(F.sum("n") / cell).cast("int").alias("k"))
    chosen = members.join(wide, "fam").select("fam", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int").alias("ci"), "k", "cls", "mult", "least")
    at = lambda x: F.when(F.col(x).isNull(), -1).otherwise(F.pmod(F.xxhash64(x), F.lit(-(-reps // TABLE) or 1))).cast("int").alias("at")
    chosen = chosen.select(at("least"), F.coalesce("least", F.lit(0)).alias("least"), *ROW)
    written = {r["at"] for r in chosen.groupBy("at").applyInPandas(_represented(f"{scratch.top}/columns/rows"), "at int").collect()}
    sets = docs.select(at("doc_id"), "doc_id", "text").mapInArrow(Shingles(width, f"{scratch.top}/columns/rows", written), Shingles.schema)
    cells = sets.withColumn("cj", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = cells.select("fam", "ci", "cls", "mult", "s", F.least("ci", "cj").alias("lo"), F.greatest("ci", "cj").alias("hi"))
    groups = max(4, -(-2 * weight // cell))
    cells = cells.withColumn("cell", F.pmod(F.xxhash64("fam", "lo", "hi"), F.lit(groups)).cast("int"))
    found = scratch.write(cells.groupBy("cell").applyInPandas(_products(percent), "a long, b long, links long"), "links")
    scratch.drop("members")
    for name in ("incidence", "rare", "columns"):
        scratch.drop(name)
    roots = connected_components(found.select("a", "b"), scratch, "components")
    counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    linked = classes.select("cls", "least", "mult").join(roots.withColumnRenamed("id", "cls"), "cls", "left").join(counts, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(lowest, "root").select("cls", "component_id", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = table.join(linked, "cls", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The per-text sizes that Incidence packed."""
    for batch in batches:
        for r in batch.to_pylist():
            n, low = unpack(r["d"]).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(unpack(r["a"]), mask=unpack(r["b"]) == 0), pa.array(unpack(r["c"])), pa.array(n), pa.array(low)], names=["doc_id", "cls", "n", "low"])


class _Bucketed:
    """Packs the classes' sizes for the bucket that gathers their columns."""

    def __init__(self, buckets: int):
        self.buckets = np.uint64(buckets)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, n, low = (np.asarray(batch.column(x)) for x in ("cls", "n", "low"))
            bucket = mix(c.view(np.uint64)) % self.buckets
            out = [(int(k), b"", b"", pack(c[m]), pack(np.array([n[m], low[m]], np.int32).reshape(-1))) for k in np.unique(bucket) for m in [bucket == k]]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["block", "a", "b", "c", "d"])
