"""The training-data operators: brute force on small inputs, nulls, empties, ties, repeats, clashing columns."""

import collections
import copy
import hashlib
import math
import pickle
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismata.llm import components, decontamination, exact_dedup, html_extraction, kernels, language_id, language_model, license_rules, license_scan, mixing, ngram_join, queries, sharding, shared_files, toxicity
from prismata.llm.elias_fano import EliasFano
from prismata.llm.kernels import pack, shingle_sets, text_slices, unpack
from prismata.llm.scratch import Scratch

ODD = [(1, None, "a"), (None, "the same text stands here twice over", "a"), (2, "the same text stands here twice over", None), (2, "the same text stands here twice over", None), (3, "", "b"), (4, " \t\n", "b"), (5, "é" * 5000 + " " + "wörd " * 3000, "b"), (6, "x", "b"), (7, "x", "b")]
SCHEMA = "doc_id long, text string, source string, slot string, score string, n string, t string, id string, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash", "clash", "clash") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def shingles(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for a in (np.zeros(0, np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64), np.arange(5, dtype=np.int32)):
        assert (unpack(pack(a)) == a).all()
        assert (unpack(pack(np.sort(a), delta=True), delta=True) == np.sort(a)).all()


def test_shared_files(tmp_path, monkeypatch):
    """From a folder and from another store, kept up to the bounds."""
    a = {"x": np.arange(100), "y": np.zeros(0, np.uint8), "z": np.linspace(0, 1, 7, dtype=np.float32)}
    shared_files.write_arrays(f"file://{tmp_path}/one", a)
    monkeypatch.setattr(shared_files, "KEPT_FILES", 2)
    for k in range(4):
        shared_files.write_arrays(f"{tmp_path}/f{k}", {"k": np.array([k])})
        assert shared_files.kept_arrays(f"{tmp_path}/f{k}")["k"][0] == k and len(shared_files._kept) <= 2
    monkeypatch.setattr(shared_files, "local_path", lambda uri: None)  # as another store, by its own reader and writer
    shared_files.write_arrays(f"file://{tmp_path}/two", a)
    for name in ("one", "two"):
        got = shared_files.map_arrays(f"file://{tmp_path}/{name}")
        assert list(got) == list(a) and all((got[k] == a[k]).all() and got[k].dtype == a[k].dtype for k in a)
    monkeypatch.setattr(shared_files, "KEPT_BYTES", 1)
    assert len(shared_files.kept_arrays(f"file://{tmp_path}/one")["x"]) == 100 and len(shared_files._kept) == 1


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 10), (5, 6), (3000, 2**40), (5000, 5001)):
        v = np.sort(rng.choice(top, n, replace=False)) if top < 2**30 else np.unique(rng.integers(0, top, n))
        if n > 1000:
            v = np.unique(np.concatenate([v, np.arange(1000) * 2]))  # a dense run
        ef = EliasFano.build(v)
        assert (ef.access(np.arange(len(v))) == v).all()
        asked = np.concatenate([v, v + 1, [top * 3]]).astype(np.int64)
        place = {int(x): k for k, x in enumerate(v)}
        assert ef.find(asked).tolist() == [place.get(int(x), -1) for x in asked]
        if len(v) > 1:
            k = rng.permutation(len(v) - 1)
            assert [x.tolist() for x in ef.access_both(k)] == [v[k].tolist(), v[k + 1].tolist()]
    steps = np.sort(np.concatenate([np.zeros(700, np.int64), np.arange(50), np.full(300, 51), [10**6, 10**6 + 1]]))  # long runs of set and of clear bits
    ef = EliasFano.build(steps)
    assert (ef.access(np.arange(len(steps))) == steps).all() and [x.tolist() for x in ef.access_both(np.arange(len(steps) - 1))] == [steps[:-1].tolist(), steps[1:].tolist()]
    assert ((ef.find(np.arange(60)) >= 0) == np.isin(np.arange(60), steps)).all() and ef.find(np.array([10**6 + 1]))[0] == len(steps) - 1


def test_shingles_of_slices():
    texts = ["a b c d e f", None, "", "A b", "é ü x \x0b y z w v"] * 3
    got = [len(s) for _, _, d, o in text_slices(pa.array(texts), 10) for s in shingle_sets(d, o)]
    assert got == [len(shingles(t)) for t in texts]


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}
    links = collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), links[i], find(i)) for i in ids}


def test_jaccard_join(docs):
    want = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert got == want


def test_jaccard_join_chains_and_chunks(spark, monkeypatch):
    """Chains link over members that aren't alike; a family in several row blocks gives the same."""
    base = [f"w{k}" for k in range(200)]
    texts = [(k, " ".join(base[k * 3 : 150 + k * 3] + [f"own{k}"])) for k in range(12)] + [(100 + k, " ".join(base[:40]) + f" tail{k}") for k in range(30)]
    want = brute_components(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for cell, links in ((1_000_000, 2_000_000), (400, 5)):
        monkeypatch.setattr(ngram_join, "CELL", cell)
        monkeypatch.setattr(ngram_join, "LINKS", links)
        got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.ngram_jaccard_join(df).collect()}
        assert got == want


def test_jaccard_join_many_blocks(spark, monkeypatch):
    """Dealing in two steps, chunks of a few shingles, and copies and near copies that many tasks hold give the same links."""
    rng = np.random.default_rng(6)
    hot = [f"h{k}" for k in range(60)]
    texts = [(k, " ".join([*hot[:30], f"x{k % 4}", *hot[30:]])) for k in range(60)] + [(100 + k, " ".join(str(w) for w in rng.integers(0, 40, rng.integers(0, 30)))) for k in range(60)]
    texts += [(200 + k, texts[60 + k][1] + " more") for k in range(60)]
    want = brute_components(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    for name in ("WIDE", "CHUNK", "HELD"):
        monkeypatch.setattr(ngram_join, name, {"WIDE": 4, "CHUNK": 300, "HELD": 200}[name])
    monkeypatch.setattr(kernels, "WIDE", 4)
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.ngram_jaccard_join(df, block_bytes=1000).collect()}
    assert got == want


def test_jaccard_join_spares_the_driver(spark, monkeypatch):
    """Chains, null and repeated ids give the same in one task and by rounds; nothing is broadcast, and few edges take no rounds."""
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base[k * 3 : 150 + k * 3] + [f"own{k}"]) for k in range(12)] + [" ".join(base[:40]) + f" tail{k}" for k in range(9)]
    ids = [*range(50, 62), None, None, None, 7, 7, 7, 0, 1, 2]
    want = brute_components(list(enumerate(texts)))
    lowest = {c: min(ids[k] for k in want if want[k][2] == c and ids[k] is not None) for c in {w[2] for w in want.values()}}
    want = sorted(str((ids[k], *w[:2], lowest[w[2]])) for k, w in want.items())
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    wrote, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, table, name: [wrote.append((name, table._jdf.queryExecution().executedPlan().toString())), write(self, table, name)][1])
    monkeypatch.setattr(ngram_join, "TABLE", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for alone in (components.ALONE, 0):
            monkeypatch.setattr(components, "ALONE", alone)
            wrote.clear()
            got = ngram_join.ngram_jaccard_join(df)
            assert sorted(str((r.doc_id, r.n_shingles, r.n_links, r.component_id)) for r in got.collect()) == want
            assert len(wrote) > 5 and not [name for name, plan in wrote if "Broadcast" in plan]
            assert any(name == "components-1" for name, _ in wrote) == (alone == 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_jaccard_join_odd(odd):
    got = ngram_join.ngram_jaccard_join(odd).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id == 2} == {2} and [r.component_id for r in got if r.doc_id is None] == [2]
    assert {(r.doc_id, r.n_shingles, r.n_links) for r in got if r.doc_id in (1, 3, 4)} == {(1, 0, 0), (3, 0, 0), (4, 0, 0)}
    assert ngram_join.ngram_jaccard_join(odd.limit(0)).count() == 0


def test_exact_dedup(docs, odd):
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    for r in [*exact_dedup.exact_dedup(docs).collect(), *exact_dedup.exact_dedup(docs, broadcast_bytes=0).collect()]:  # by broadcast and by shuffle
        own = groups[texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(own), len(own), r.doc_id == max(own), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(ODD) and sorted(map(str, got)) == sorted(map(str, exact_dedup.exact_dedup(odd, broadcast_bytes=0).collect()))
    assert [(r.keep_id, r.kept) for r in got if r.doc_id is None] == [(2, False)]
    assert {(r.doc_id, r.keep_id) for r in got if r.doc_id in (1, 3)} == {(1, 3), (3, 3)}  # null counts as empty
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def test_mixing(spark, docs, odd):
    got = mixing.mix_sources(docs).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += max(1, len((r.text or "x").encode()))
    weight = {s: n**0.7 for s, n in sizes.items()}
    total, whole = sum(sizes.values()), sum(weight.values())
    copies = collections.Counter(r.doc_id for r in got)
    for r in docs.collect():
        mean = weight[r.source] / whole * total / sizes[r.source]
        u = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        k, p = 0, math.exp(-mean)
        c = p
        while c <= u:
            k += 1
            p *= mean / k
            c += p
        assert copies[r.doc_id] == k
    assert collections.Counter(r.doc_id for r in mixing.mix_sources(docs, broadcast_bytes=0).select("doc_id").collect()) == copies
    for part in mixing.mix_sources(docs).select("shuffle_key").rdd.glom().collect():
        assert [r[0] for r in part] == sorted(r[0] for r in part)
    named = spark.createDataFrame([("a", 3.0), ("zzz", 1.0), (None, 1.0)], "name string, weight double")
    assert {r.source for r in mixing.mix_sources(odd, named, epochs=20.0).collect()} <= {"a", None}
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_sharding(odd, docs):
    names, size = [f"s{k}" for k in range(7)], 701
    table = sharding.fill_table(names, size)
    loads = collections.Counter(table)
    assert max(loads.values()) - min(loads.values()) <= 1
    fewer = sharding.fill_table(names[:-1], size)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < size * 0.15
    got = sharding.assign_shards(docs, names, size).collect()
    for r in got:
        slot = int(hashlib.md5(f"key:{r.doc_id}".encode()).hexdigest()[:12], 16) % size
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert len(got) == docs.count() and len(sharding.assign_shards(odd, names, size).collect()) == len(ODD)
    for bad in ((names, 700), ([], 7), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(docs, odd, order):
    rows = docs.withColumn("h", language_model.held_out(7)).select("doc_id", "text", "h").collect()
    one, many = collections.Counter(), collections.Counter()
    for r in rows:
        if not r.h:
            w = [*words(r.text), None]
            one.update(w)
            w = ["<s>", *w]
            many.update(tuple(w[k - m + 1 : k + 1]) for m in range(2, order + 1) for k in range(m - 1, len(w)))
    n, v = sum(one.values()), len(one)
    seen, kinds = collections.Counter(), collections.Counter()
    for g, c in many.items():
        seen[g[:-1]] += c
        kinds[g[:-1]] += 1
    model = language_model.train(docs.where(~language_model.held_out(7)), order=order)
    got = {r.doc_id: r for r in language_model.score(docs, model).collect()}
    assert (model.n_tokens, model.words.size) == (n, v)
    better = 0.0
    for r in rows:
        w = [*words(r.text), None]
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        full = 0.0
        s = ["<s>", *w]
        for k in range(1, len(s)):
            p = (one[s[k]] + 1) / (n + v + 1)
            for m in range(1, min(order, k + 1)):
                a = tuple(s[k - m : k])
                p = (many[*a, s[k]] + kinds[a] * p) / (seen[a] + kinds[a]) if seen[a] else p
            full += math.log10(p)
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known) == (len(w), sum(one[x] > 0 for x in w))
        assert g.base_score == pytest.approx(base) and g.score == pytest.approx(full, abs=0.05 * len(w) + 0.1)
        better += (g.score - g.base_score) * r.h
    assert better > 0
    assert len(language_model.score(odd, model).collect()) == len(ODD)
    empty = language_model.train(docs.limit(0), order=order)
    assert {r.score for r in language_model.score(odd, empty).collect()} == {0.0}


def test_language_model_many_blocks(docs, monkeypatch):
    """Counts dealt in two steps to many blocks and shards score as those of a few."""
    few = language_model.train(docs)
    for m in (kernels, language_model):
        monkeypatch.setattr(m, "WIDE", 4)
    many = language_model.train(docs, block_bytes=20_000)
    assert many.words.blocks > 9 and (many.n_tokens, many.words.size, many.n_pairs) == (few.n_tokens, few.words.size, few.n_pairs)
    a, b = ({(r.doc_id, r.n_tokens): r for r in language_model.score(docs, m).collect()} for m in (few, many))
    assert a.keys() == b.keys() and all(a[k].base_score == pytest.approx(b[k].base_score) and a[k].score == pytest.approx(b[k].score, abs=0.05 * k[1] + 0.1) for k in a)
    assert len(pickle.dumps(many)) < 2000


def test_language_id(spark, sf, docs, odd):
    model = language_id.train(docs.where(~language_model.held_out(4)))
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang").where(language_model.held_out(4)), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    said = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert all(said[k].lang_pred == "und" and said[k].score == 0 for k in (1, 3, 4)) and said[6].lang_pred in model.langs
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}


def test_language_calibration(spark):
    """Limits and sharpness come from rows that were not counted; texts of no learnt language are rejected, the languages' own are not."""
    rng = np.random.default_rng(8)
    shapes = {"aa": "abcdefgh", "bb": "hijklmno", "cc": "opqrstua"}
    word = lambda letters: "".join(letters[int(k)] for k in np.minimum(rng.geometric(0.3, rng.integers(2, 9)), len(letters)) - 1)
    rows = [(k, " ".join(word(shapes[x]) for _ in range(int(rng.integers(3, 60)))), x) for k, x in enumerate(list(shapes) * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where("doc_id < 450"))
    assert all(2.0**-4 < model.sharpness < 2.0**16 for _ in [0]) and np.isfinite(model.limit).all()
    got = {r.doc_id: r for r in language_id.identify(docs.where("doc_id >= 450"), model).collect()}
    assert sum(got[k].lang_pred == x for k, _, x in rows[450:]) == 150 and sum(r.rejected for r in got.values()) <= 6
    strange = spark.createDataFrame([(k, " ".join(word("zyxwv") for _ in range(30))) for k in range(30)], "doc_id long, text string")
    assert sum(r.rejected for r in language_id.identify(strange, model).collect()) >= 28
    assert max(r.score for r in language_id.identify(strange, model).collect()) < min(sorted(r.score for r in got.values())[10:])


def test_kneser_ney_against_definitions():
    """Probabilities by recursion over dictionaries, for texts with seen, unseen and single-letter runs."""
    rng = np.random.default_rng(9)
    text, order = " ".join("".join(rng.choice(list("abcd"), rng.integers(1, 7))) for _ in range(300)), 4
    made = collections.Counter(text.split())
    runs = lambda w: [language_id.START, *map(ord, w), language_id.STOP]
    count = [collections.Counter() for _ in range(order + 1)]
    left = [collections.defaultdict(set) for _ in range(order + 1)]
    for w, times in made.items():
        x = runs(w)
        for i in range(1, len(x)):
            for k in range(1, order + 1):
                if i >= k - 1:
                    g = tuple(x[i - k + 1 : i + 1])
                    if k == order or i == k - 1:
                        count[k][g] += times
                    else:
                        left[k][g].add(x[i - k])
    for k in range(1, order):
        for g, before in left[k].items():
            count[k][g] += len(before)
    d = [0.0]
    for k in range(1, order + 1):
        ones, twos = (sum(v == n for v in count[k].values()) for n in (1, 2))
        d.append(ones / (ones + 2 * twos) if ones and twos else 0.5)

    def p(ctx, symbol):
        k = len(ctx) + 1
        lower = p(ctx[1:], symbol) if ctx else 1 / language_id.ALPHABET
        its = {g: v for g, v in count[k].items() if g[:-1] == ctx}
        if not its:
            return lower
        total = sum(its.values())
        return max(its.get((*ctx, symbol), 0) - d[k], 0) / total + d[k] * len(its) / total * lower

    (_, _, data, offsets), *_ = text_slices(pa.array([text]), 1 << 30)
    model = language_id.Model(["x"], order, {"x": language_id.kneser_ney(language_id.Runs(data, offsets), order)})
    asked = ["abcd", "a", "dddddd bca", "xyz ab", "é abz", text]
    (_, _, data, offsets), *_ = text_slices(pa.array(asked), 1 << 30)
    e, n = model.entropies(data, offsets)
    for k, t in enumerate(asked):
        bits = [-math.log2(p(tuple(x[max(0, i - order + 1) : i]), x[i])) for w in t.split() for x in [runs(w)] for i in range(1, len(x))]
        assert n[k] == len(bits) and e[k, 0] == pytest.approx(sum(bits) / len(bits), rel=1e-5)


def test_kneser_ney_sums_to_one():
    (_, _, data, offsets), *_ = text_slices(pa.array(["abab abba baab ab a bb " * 3]), 1 << 30)
    runs = language_id.Runs(data, offsets)
    model = language_id.Model(["x"], 3, {"x": language_id.kneser_ney(runs, 3)})
    bits = []
    for nxt in ("a", "b", ""):
        (_, _, d, o), *_ = text_slices(pa.array(["ab" + nxt]), 1 << 30)
        r = language_id.Runs(d, o)
        at, grams = r.grams(3)
        ctx = [np.zeros(len(at), np.uint64), *r.contexts(at, 3)]
        k = 2  # the symbol after "ab"
        p, back = None, 0.0
        for n in (3, 2, 1):
            row = model._row(model.grams[n - 1], grams[n - 1][k : k + 1], np.nan)[0, 0]
            if p is None and not np.isnan(row):
                p = row + back
            back += model._row(model.backs[n - 1], ctx[n - 1][k : k + 1], 0.0)[0, 0]
        bits.append(p)
    assert 0.97 < sum(2.0**b for b in bits) <= 1.001


def test_toxicity(spark, odd, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"word{k}" for k in range(400)]
    rows, marks = [], []
    for k in range(1200):
        w = list(rng.choice(vocabulary, 40))
        bad = k % 8 == 0
        if bad:
            w[int(rng.integers(40))] = str(rng.choice(["vile", "nasty", "horrid"]))
        rows.append((k, " ".join(map(str, w))))
        marks.append((k, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    index = toxicity.train(docs.where(~language_model.held_out(4)), labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, index).collect()}
    assert all((got[k].score >= 0.3) == bool(y) for k, y in marks)
    # neighbours, votes and scores against brute force over all examples, in one block and in many
    (_, _, data, offsets), *_ = text_slices(pa.array([t for _, t in rows[:400]]), 1 << 30)
    vectors = index.vectors(data, offsets)
    dense = np.zeros((len(index.ids), len(index.terms)))
    term = np.repeat(np.arange(len(index.terms)), np.diff(index.first))
    for e, (a, b) in enumerate(zip(index.start[:-1], index.start[1:], strict=True)):
        dense[index.posting[a:b].view(np.int32)[::2], term[e]] = index.posting[a:b].view(np.float32)[1::2]
    dense[:, index.column >= 0] = index.dense
    assert index.uri and len(pickle.dumps(index)) < 1000  # tasks map it, nothing is sent
    terms, examples = np.nonzero(dense.T)
    for block, wide in ((2048, 16), (100, 16), (64, 1), (100, 10**9)):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        monkeypatch.setattr(toxicity, "WIDE", wide)
        index = copy.copy(index)
        index._lay_out(terms, examples.astype(np.int32), dense.T[terms, examples].astype(np.float32))
        for (at, w), near, scored in zip(vectors, index.nearest(vectors, 25), index.scores(vectors, 25), strict=True):
            s = np.round(dense[:, at] @ w, 9)
            k = np.flatnonzero((s >= np.sort(s)[-25]) & (s > 0))
            assert set(near[0].tolist()) == set(k.tolist())
            vote = (s[k] ** 2 * index.labels[k]).sum() / (s[k] ** 2).sum()
            level = index.levels[sum(vote >= c - 1e-12 for c in index.cuts)]
            assert scored == (level, [int(index.ids[x]) for x in sorted(k, key=lambda x: (-s[x], index.ids[x]))[:3]])
    assert len(toxicity.score_toxicity(odd, index).collect()) == len(ODD)
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(odd, none).collect()} == {0.0}


def test_toxicity_meets_plain_examples(spark):
    """No term goes with the label here, and yet each text meets its equal among the examples."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"plain{w}" for w in rng.integers(0, 500, 30)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (100, texts[7]), (101, texts[8] + " unheard"), (102, "unheard"), (103, "")], "doc_id long, text string")
    index = toxicity.train(docs, spark.createDataFrame([(k, int(k % 6 == 1)) for k in range(60)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, index).collect()}
    assert all(got[k].evidence[0] == k for k in range(60))
    assert got[100].evidence[0] == 7 and got[101].evidence[0] == 8
    assert got[102].evidence == got[103].evidence == [] and got[102].score == got[103].score


def test_toxicity_drops_copies_only(spark):
    """A toxic variant of a clean text, texts that share a passage and copies with other labels stay; plain copies go."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"plain{w}" for w in rng.integers(0, 500, 30)) for _ in range(20)]
    rows = [*enumerate(texts), *[(20 + k, t + " vile") for k, t in enumerate(texts)], *[(40 + k, t.upper() + " !") for k, t in enumerate(texts)]]
    marks = [(k, int(20 <= k < 40 or k == 40)) for k in range(60)]
    index = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert sorted(index.ids.tolist()) == list(range(41))


def naive_alignment(a, b):
    h = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for i, x in enumerate(b, 1):
        for j, y in enumerate(a, 1):
            s = 2 if x == y else 1 if x[:5] == y[:5] else -1
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_smith_waterman():
    rng = np.random.default_rng(4)
    vocabulary = [f"{p}{k}" for p in ("alphas", "betas", "c") for k in range(4)]
    for _ in range(50):
        a, b = ([str(w) for w in rng.choice(vocabulary, n)] for n in (30, 12))
        code = lambda w: np.array([hash(x) for x in w])
        stem = lambda w: np.array([hash(x[:5]) for x in w])
        assert decontamination.smith_waterman(code(a), stem(a), code(b), stem(b))[0] == naive_alignment(a, b)


def test_decontamination(spark, odd):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    text = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    items = [(k, text(30)) for k in range(6)]
    rows = [(k, text(300)) for k in range(40)]
    rows[3][1][50:80] = items[0][1]
    edited = list(items[1][1])
    edited[10] = "other"
    del edited[20]
    rows[4][1][100:100] = edited
    for k in range(10, 30):
        rows[k][1][5:5] = items[2][1]  # one that leaked widely
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, None), (91, "w1"), (0, " ".join(items[0][1]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(df, tests).collect()}
    assert set(got) == {(3, 0), (4, 1)} | {(k, 2) for k in range(10, 30)}
    assert (got[3, 0].score, got[3, 0].first_word, got[3, 0].last_word) == (1.0, 50, 79)
    small = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, tests, block_bytes=64).collect()}
    assert small == set(got)
    assert {r.doc_id for r in decontamination.drop_leaks(df, tests).collect()} == {k for k in range(40)} - {3, 4} - set(range(10, 30))
    assert decontamination.find_leaks(odd, tests).count() == 0 and decontamination.find_leaks(df, tests.limit(0)).count() == 0
    assert decontamination.drop_leaks(odd, tests).count() == len(ODD)


def test_decontamination_against_all_pairs(spark):
    """Edited copies among words that items share: what seeds and windows find is what aligning every item with every whole text finds."""
    rng = np.random.default_rng(11)
    vocabulary = [f"{x}{k}" for k in range(60) for x in ("run", "runs", "red")]
    draw = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    items = [(k, draw(int(rng.integers(8, 40)))) for k in range(25)]
    rows = []
    for k in range(120):
        w = draw(int(rng.integers(0, 120)))
        for _ in range(int(rng.integers(0, 3))):
            own = list(items[int(rng.integers(25))][1])
            rate = float(rng.choice([0.0, 0.1, 0.25, 0.4]))
            edited = [x for y in own for x in ([y] if rng.random() > rate else [[], draw(1), [y, *draw(1)]][int(rng.integers(3))])]
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = edited
        rows.append((k, w))
    hashes = lambda w: tuple(kernels.word_hashes(np.frombuffer("".join(x[:n] for x in w).encode(), np.uint8), np.cumsum([0, *[len(x[:n]) for x in w]])[:-1], np.cumsum([len(x[:n]) for x in w])) for n in (99, decontamination.STEM))
    want = {}
    for i, w in rows:
        for j, x in items:
            seeded = w and {tuple(w[k : k + 3]) for k in range(len(w) - 2)} & {tuple(x[k : k + 3]) for k in range(len(x) - 2)}
            if seeded:
                a, b = hashes(w), hashes(x)
                score, _ = decontamination.smith_waterman(a[0], a[1], b[0], b[1])
                if score >= len(x):  # half the score of a copy
                    want[i, j] = score / (2 * len(x))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.find_leaks(df, spark.createDataFrame([(j, " ".join(x)) for j, x in items], "item_id long, text string")).collect()}
    assert len(want) > 60 and got == pytest.approx(want)


def test_decontamination_short_and_common(spark):
    """Short items, scripts without spaces, and an edited copy of which only n-grams that many documents hold are unbroken."""
    asked = [f"q{k}" for k in range(24)]
    edited = [w if k < 15 else f"x{k}" for k, w in enumerate(asked)]
    common = [(100 + k, f"y{k} " + " ".join(asked[:3]) + f" z{k} " + " ".join(asked[3:15])) for k in range(8)]
    chinese, long = "今天天气很好", "人工智能正在改变世界各地的人们工作和生活方式"
    rows = [(1, "so it says What is two plus two? here"), (2, "what is two plus three"), (3, f"他说{chinese}所以出门"), (4, "w1 w2"), (5, f"据说{long[:12]}了{long[12:]}吗"), (6, " ".join(edited)), (7, None), *common]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "what is two plus two"), (2, chinese), (3, "w1"), (4, long), (5, " ".join(asked)), (6, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(df, items).collect()}
    assert {k for k in got if k[0] < 100} == {(1, 1), (3, 2), (5, 4), (6, 5)}
    assert (got[1, 1].score, got[1, 1].first_word, got[1, 1].last_word) == (1.0, 3, 7)


def test_license_base_counts(docs, odd):
    for table in (docs, odd):
        for r, t in zip(license_scan.scan_licenses(table).collect(), [x.text for x in table.select("text").collect()], strict=True):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
            want = sorted((k, label) for phrase, label in license_scan.BASE_PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
            assert r.n_words == len(w) and sorted((b.place, b.label) for b in r.base) == want


def test_license_rules():
    s = license_scan.Scanner()
    assert len(s.rules) >= 200
    got = lambda t: [f.label for f in s.scan(t)]
    assert got("licensed under the apache license, version 2.0") == ["apache"]
    assert got("gnu lesser general public license v3") == ["lgpl"]  # the shorter name inside is suppressed
    assert got("the mit\nlicense and the 3-clause bsd license") == ["mit", "bsd-3-clause"]
    assert got("spdx-license-identifier: mit") == ["spdx"] and got("nothing here") == []
    a = license_scan.Found(0, 10, "a", 5, 1, 0.5)
    assert license_scan.resolve([a, license_scan.Found(2, 8, "b", 0, 0, 0.9), license_scan.Found(3, 5, "c", 9, 2, 0.1)]) == [a, license_scan.Found(2, 8, "b", 0, 0, 0.9)]


def test_license_gates():
    s = license_scan.Scanner()
    got = lambda t: [f.label for f in s.scan(t)]
    for text, label in {
        "the gnu library general public license": "lgpl", "released under zero-clause bsd": "0bsd", "0-clause bsd": "0bsd", "attribution-noncommercial-noderivs": "cc-by-nc-nd", "attribution-sharealike 4.0": "cc-by-sa", "creative commons attribution": "cc-by",
        "uses gplv3": "gpl", "lgpl-2.1": "lgpl", "agpl 3.0 or later": "agpl", "mpl 2.0": "mpl", "apache-2.0": "apache", "bsd-3-clause": "bsd-3-clause", "released under the gpl": "gpl", "license:mit license": "mit", "an openrail-m": "openrail", "open rail": "openrail", "spdx-license-identifier:mit": "spdx",
    }.items():
        assert got(text) == [label], text
    assert got("apache 2.4 serves, apache 2.0.55 too; mit students, the gplates and bsd 2000") == []
    for text, label in {
        "license: mit": "mit", '"license": "bsd"': "bsd", "bsd 3-clause license": "bsd-3-clause", "the gnu gpl": "gpl", "gplv3": "gpl", "mpl 2.0": "mpl", "https://opensource.org/licenses/mit": "mit", "see http://www.gnu.org/licenses/lgpl-3.0.html": "lgpl", "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
        "license :: osi approved :: apache software license": "apache", "license = 'isc'": "isc", "licence: cc-by-sa 4.0": "cc-by-sa", "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license": "lgpl", "the above copyright notice and this permission notice shall be included in all copies": "mit",
        "distributed on an \"as is\" basis, without warranties or conditions of any kind": "apache", "an mit-licensed tool": "mit", "the software shall be used for good, not evil": "json", "creative commons attribution-sharealike 4.0 international license": "cc-by-sa", "unauthorized copying of this file is strictly prohibited": "proprietary", "license: unlicensed": "proprietary", "cc0 1.0 universal": "cc0",
        "released under the terms of the mpl": "mpl", "neither the name of the university nor the names of its contributors may be used to endorse": "bsd-3-clause", "with no invariant sections, no front-cover texts, and no back-cover texts": "fdl",
    }.items():
        assert label in got(text), text
    for clean in ("komm mit mir, license is a word", "a bsd conference, the php manual", "under the public eye", "cc by the way", "all of the gnu herd", "the artistic director was licensed", "open data, common sense and development"):
        assert got(clean) == [], clean


def test_license_rules_hold_their_keywords():
    """What any rule matches, in texts that hold each rule's words, also passes its keyword."""
    s = license_scan.Scanner()
    assert len(license_rules.SIGNATURES) >= 200 and len({r.pattern.pattern for r in s.rules}) == len(s.rules)
    names = [re.sub(r"\(\?:([^|()]*)[^()]*\)\??", r"\1", p) for _, _, p in license_scan.LICENSES]
    texts = [f"{head}{n}{tail}" for n in names for head in ("licensed under the ", "license: ", "see the ") for tail in (" version 2.0", "")]
    for _, _, _, _, pattern in license_rules.SIGNATURES:  # a text of each pattern: first choices, options left out and taken
        for keep in ("", r"\1"):
            x = re.sub(r"\(\?:([^()]*)\)\?", keep, re.sub(r"\(\?[!=]([^()]*)\)", "", pattern))
            x = re.sub(r"\(\?:([^|()]*)[^()]*\)[+*]?", r"\1", x)
            for a, b in ((r"\\b", ""), (r"\\d\[[^\]]*\]\*|\\d", "2"), (r"\[[^\]]*\]\??", " "), (r"\\[wS][*+]?", "x"), (r"\\W\??", " "), (r"\.\{0,\d+\}\?", " "), (r"\\s", " "), (r"\\(.)", r"\1"), (r"(.)\?", r"\1"), (r"\{\d+,?\d*\}\??", "")):
                x = re.sub(a, b, x)
            texts += [y for part in x.split("|") for y in (part, part.replace("2", "2.0"))]
    missed = set()
    for text in texts:
        words = s.held(raw := text.encode(), np.array([0, len(raw)])).get(0, set())
        held = [(r, g.places(text, words)) for g, its in s.gates for r in its if r.pattern.search(text)]
        missed |= {(r.keyword, text) for r, places in held if not places}
    assert not missed


def test_license_scan_long_texts():
    """Windows around keywords lose nothing; ten megabytes, even of licenses alone, end in seconds."""
    s = license_scan.Scanner()
    rng = np.random.default_rng(4)
    notices = ["licensed under the apache license,\n version 2.0", "the mit license", "spdx-license-identifier: mit", "gnu lesser general public license v3", "license: cc-by 4.0", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"]
    text = " ".join(str(rng.choice(notices)) if rng.random() < 0.02 else f"word{rng.integers(500)}" for _ in range(3000))
    assert len(text) > license_scan.WHOLE
    whole = license_scan.resolve([license_scan.Found(m.start(), m.end(), r.label, r.order, r.priority, r.confidence) for r in s.rules for m in r.pattern.finditer(text)])
    assert s.scan(text) == whole and len(whole) > 20
    began = time.time()
    assert len(s.scan("lorem ipsum dolor " * 580_000 + "the mit license")) == 1
    many = s.scan("the mit license and more words of it. " * 270_000)
    assert len(many) == 270_000 and time.time() - began < 60


def test_license_resolve():
    """Against the plain rule: no detection within one that was taken before it."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        found = [license_scan.Found(int(a), int(a + n), str(p), k, int(p), 0.5) for k, (a, n, p) in enumerate(zip(rng.integers(0, 30, 25), rng.integers(1, 12, 25), rng.integers(0, 4, 25), strict=True))]
        taken = []
        for f in sorted(found, key=lambda f: (f.priority, f.start - f.end, f.start, f.rule)):
            if not any(t.start <= f.start and f.end <= t.end for t in taken):
                taken.append(f)
        assert license_scan.resolve(found) == sorted(taken)


def test_html():
    x = html_extraction.extract_text
    page = "<html><head><title>T</title><script>if(a<b){}</script></head><body><nav><a href=/>Home</a></nav><article><h1>Head &amp; line</h1><p>One,\n two <b>three</b>.<p>Four &lt;five&gt;.<div class='ad'>Buy</div><ul><li>a<li>b</ul></article><footer>c</footer></body></html>"
    assert x(page) == "Head & line\n\nOne, two three.\n\nFour <five>.\n\na\n\nb"
    assert x(None) == x("") == x("<html><nav>x</nav>") == ""
    plain = "<body><div id=menu><a href=a>A</a><a href=b>B</a></div><div class=c><h2>Title</h2><p>Long text, with commas. And more, of it.</p><p>Second one, too, is long enough.</p></div><div class=comments><p>Me, too.</p></div><form><p>Sign up, now.</p></form></body>"
    assert x(plain) == "Title\n\nLong text, with commas. And more, of it.\n\nSecond one, too, is long enough."
    assert x("<p>cut off in a ta<b") == "cut off in a ta"


def test_html_marks():
    text = "A long sentence of the article, with a comma, stands here."
    more = "Another sentence of it, with more words, follows."
    for page in ("<body class='no-sidebar'><p>{}</p></body>", "<body><div class='has-comments'><p>{}</p></div></body>", "<body><main class='with-nav'><p>{}</p></main></body>", "<body class='sidebar'><p>{}</p></body>", "<body><div class='related'><p>{}</p></div></body>"):
        assert html_extraction.extract_text(page.format(text)) == text
    page = f"<article><h2 id='Legal_status'>Status</h2><p>{text}</p><section id='discussion'><h2>Discussion</h2><p>{more}</p></section><div class='site-footer'><p>Imprint, terms.</p></div></article>"
    assert html_extraction.extract_text(page) == f"Status\n\n{text}\n\nDiscussion\n\n{more}"
    assert html_extraction.extract_text(f"<body><p>{text}</p><div class='comments'><p>{more}</p></div><nav><p>{more}</p></nav></body>") == text
    assert html_extraction.extract_text(f"<body><nav><p>{text}</p></nav></body>") == ""


def test_html_ratios_decide():
    """Link lists fall by their ratio inside an article too; marks hold for whole names; quotes that never close cost one tag."""
    x = html_extraction.extract_text
    text, more = "A long sentence of the article, with a comma, stands here.", "Another sentence of it, with more words, follows."
    links = "".join(f"<li><a href=/{k}>Read this next, number {k}</a></li>" for k in range(6))
    assert x(f"<article><h1>Head</h1><p>{text}</p><p>{more}</p><ul>{links}</ul></article>") == f"Head\n\n{text}\n\n{more}"
    assert x(f"<body><div><p>{text}</p><p>{more}</p><table><tr><td>{links}</td></tr></table></div></body>") == f"{text}\n\n{more}"
    for page in ("<body class='has-sidebar'>{}</body>", "<body class='home page no-comments'>{}</body>", "<article class='post comments-open'>{}</article>", "<main><section id='legal'>{}</section></main>", "<div class='search-result-item'>{}</div>", "<article><div class='legal-news'>{}</div></article>"):
        assert x(page.format(f"<p>{text}</p><p>{more}</p>")) == f"{text}\n\n{more}"
    assert x(f"<article><p title=\"x>{text}</p><p title='a > b'>{more}</p></article>") == f"{text}\n\n{more}"
    assert x(f"<article><p>no marks at all in this one</p></article><div class='ad'>{text}</div>") == "no marks at all in this one"
    assert x(f"<article><h2><a href=/>Card</a></h2></article><div id=c><p>{text}</p><p>{more}</p></div>").endswith(f"{text}\n\n{more}")


def test_html_long_pages():
    """Time in proportion to the page: many classes, deep nesting, stray end tags and open quotes."""
    began = time.time()
    classes = "".join(f"<div class='c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}'><p>Some text, here {k}.</p></div>" for k in range(20000))
    assert html_extraction.extract_text(f"<body>{classes}</body>").count("\n\n") == 19999
    assert html_extraction.extract_text("<div>" * 30000 + "Hello, there." + "</x></div>" * 30000) == "Hello, there."
    assert html_extraction.extract_text('<p title="' * 50000 + "<p>Hello, there.</p>") == "Hello, there."
    assert time.time() - began < 10


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Hi, you.</p></article>", "clash"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(map(str, html_extraction.extract_pages(df).collect())) == sorted(["Row(page_id=1, url='u', text='Hi, you.')", "Row(page_id=None, url=None, text='')"])


SHAPES = {
    "lm": lambda d, s: language_model.score(d, language_model.train(d)),
    "mix": lambda d, s: mixing.mix_sources(d),
    "shard": lambda d, s: sharding.assign_shards(d, queries.SHARDS),
    "leaks": lambda d, s: decontamination.find_leaks(d, s.createDataFrame([(1, " ".join(f"w{k}" for k in range(500, 540)))], "item_id long, text string")),
    "clean": lambda d, s: decontamination.drop_leaks(d, s.createDataFrame([(1, "never said by anyone at all in here, not once")], "item_id long, text string")),
    "language": lambda d, s: language_id.identify(d, language_id.train(d.withColumn("lang", F.lit("xx")))),
    "jaccard": lambda d, s: ngram_join.ngram_jaccard_join(d),
    "toxic": lambda d, s: toxicity.score_toxicity(d, toxicity.train(d, s.createDataFrame([(1, 1), (2, 0), (5, 0), (None, 1)], "doc_id long, toxic int"))),
    "not toxic": lambda d, s: toxicity.drop_toxic(d, toxicity.train(d.limit(0), s.createDataFrame([], "doc_id long, toxic int"))),
    "license": lambda d, s: license_scan.scan_licenses(d),
    "exact": lambda d, s: exact_dedup.exact_dedup(d),
    "html": lambda d, s: html_extraction.extract_pages(d.withColumnRenamed("text", "html")),
}


@pytest.mark.parametrize("name", SHAPES)
def test_odd_long_and_empty_tables(spark, odd, name):
    """Every operator takes nulls, repeats, clashing columns, texts of megabytes and tables without rows, and answers for each row."""
    run = SHAPES[name]
    assert run(odd.limit(0), spark).count() == 0
    got = run(odd, spark)
    assert got.count() == {"leaks": 0}.get(name, len(ODD) if name != "mix" else got.count())
    if name in ("clean", "not toxic", "shard", "mix"):
        assert set(odd.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    text = " ".join(f"w{k * k % 7919}" if k % 3 else f"w{k % 2000}" for k in range(300_000))
    long = spark.createDataFrame([(1, text, "a"), (2, text + " end", "a"), (2, text, "a"), (None, None, None), (5, "x" * 3_000_000, "b")], "doc_id long, text string, source string")
    rows = run(long, spark).collect()
    assert len(rows) >= (0 if name in ("leaks", "mix") else 5)
    if name == "jaccard":
        assert {(r.doc_id, r.n_links, r.component_id) for r in rows} == {(1, 2, 1), (2, 2, 1), (None, 0, None), (5, 0, 5)}
    if name == "exact":
        assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in rows) == [(0, 0, 1), (1, 2, 2), (2, 2, 1), (2, 2, 2), (5, 5, 1)]


def test_queries_run(spark, sf):
    for name, f in queries.QUERIES.items():
        assert f(spark, sf).count() >= 0, name


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert set(corpus_pipeline.COLUMNS) < set(out.columns) and 0 < out.count()
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, sf)
        assert kept.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in kept.select("doc_id").collect()}


def test_pipeline_odd_tables(spark, tmp_path):
    """Each stage on an empty table and on one of nulls, blanks, repeats and a column too many."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    rows = [(1, None, None, None, None, "x"), (None, "", "en", "a", 0, "x"), (None, " \t", "en", "a", 0, "x"), (2, "one two three four five six", "en", "a", 9, "x"), (2, "one two three four five six", "en", "a", 9, "x"), (3, "one two", None, "b", 1, "x")]
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data, kept in ((rows, [6, 5, 6]), ([], [0, 0, 0])):
        docs = spark.createDataFrame(data, schema)
        for (_, stage), n in zip(corpus_pipeline.STAGES[:3], kept, strict=False):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == corpus_pipeline.COLUMNS and out.count() == n
        for _, stage in corpus_pipeline.STAGES[3:]:
            out = stage(spark, docs, str(tmp_path))
            assert set(corpus_pipeline.COLUMNS) <= set(out.columns) and out.count() >= 0


def test_pipeline_rows(spark, tmp_path):
    """Null and repeated ids by brute force: each row goes or stays by its own text."""
    import corpus_pipeline

    rng = np.random.default_rng(7)
    plain = lambda k: " ".join(f"plain{w}" for w in rng.integers(0, 3000, k))
    item = " ".join(f"asked{k}" for k in range(20))
    rows = [(k, plain(30) + (" vile nasty" if k % 5 == 0 else "")) for k in range(300)]
    marks = [(k, int(k % 5 == 0)) for k in range(300)]
    toxic, twin, pair = plain(30) + " vile nasty", plain(40), plain(40)
    rows += [(None, toxic), (None, plain(30)), (None, f"{plain(10)} {item} {plain(10)}"), (900, plain(30)), (900, toxic + " more"), (901, plain(30)), (901, f"{item} {plain(10)}")]
    rows += [(902, twin), (902, twin + " end"), (902, twin), (None, pair), (None, pair), (904, pair), (903, pair), (None, ""), (None, ""), (905, None), (905, None)]
    corpus = str(tmp_path)
    docs = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{corpus}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{corpus}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{corpus}/benchmark.parquet")

    def near(a, b):
        x, y = shingles(a), shingles(b)
        return bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)

    want = [(k, t) for k, t in rows if "vile" not in (t or "")]
    groups = []
    for r in sorted(want, key=lambda r: (r[0] is None, r[0] or 0)):
        home = next((g for g in groups if any(near(r[1], t) for _, t in g)), None)
        groups.append([r]) if home is None else home.append(r)
    order = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = spark.read.parquet(f"{corpus}/documents.parquet")
    out = corpus_pipeline.filter_toxic(spark, out, corpus)
    assert order((r.doc_id, r.text) for r in out.collect()) == order(want)
    out = corpus_pipeline.join_near_copies(spark, out, corpus)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(groups) and all(sum(r in g for r in got) >= 1 for g in groups) and collections.Counter(k for k, _ in got) == collections.Counter(g[0][0] for g in groups)
    out = corpus_pipeline.decontaminate(spark, out, corpus)
    assert order((r.doc_id, r.text) for r in out.collect()) == order(r for r in got if item not in (r[1] or ""))
