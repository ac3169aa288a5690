"""Training-data operators against brute force, and their edge cases."""

import collections
import glob
import math
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphgate.llm import (
    decontaminate, html_text, jaccard, licenses, mixing, ngram_lm, quality, quotes, sharding, toxicity, words)
from glyphgate.llm.catalog import ORACLES, QUERIES
from glyphgate.llm.work import Folder, components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "a b c"), (7, "x" * 300_000 + " tail"), (8, "a b c"), (8, "a b c"),
         (None, "no id here at all"), (9, "éà ü\x0bñ \x00 z")]


def edges(spark, **more):
    rows = [(i, t, "en", None if k % 3 else f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(EDGES)]
    return spark.createDataFrame(rows, DOCS)


# --- words ---------------------------------------------------------------------------

def test_words_follow_the_pattern():
    texts = [t for _, t in EDGES] + ["  lead", "trail  "]
    w = words.words(pa.array(texts, pa.string()))
    got = [[w.data[w.starts[k]:w.ends[k]].tobytes().decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    by = {}
    for word, h in zip((x for row in got for x in row), w.hashes.tolist(), strict=True):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)
    assert len(words.words(pa.array([], pa.string())).hashes) == 0
    assert words.words(pa.array(["ABC abc"]), lower=True).hashes.tolist()[0] == words.words(pa.array(["ABC abc"]), lower=True).hashes.tolist()[1]


def test_chunks_cover_all_rows_in_order():
    batch = pa.record_batch({"t": pa.array(["a" * n for n in (5, 0, 30, 1, 1, 9)])})
    parts = list(words.chunks(batch, "t", 10))
    assert [x for p in parts for x in p.column("t").to_pylist()] == batch.column("t").to_pylist()
    assert all(p.num_rows == 1 or sum(map(len, p.column("t").to_pylist())) <= 10 for p in parts)


# --- LM scoring ----------------------------------------------------------------------

def brute_lm(rows, train, order):
    tokens = lambda t: [*WORD.findall(lower(t)), "</s>"]
    pad = max(1, order - 1)
    raw = [collections.Counter() for _ in range(order + 1)]
    for t in train:
        s = ["<s>"] * pad + tokens(t)
        for i in range(pad, len(s)):
            for k in range(1, order + 1):
                raw[k][tuple(s[i - k + 1:i + 1])] += 1
    adjusted = [None] * order + [dict(raw[order])]
    for k in range(order - 1, 0, -1):
        left = collections.Counter(g[1:] for g in raw[k + 1])
        adjusted[k] = {g: raw[k][g] if g[0] == "<s>" else left[g] for g in raw[k]}
    d, context = [None], [None]
    for k in range(1, order + 1):
        n = collections.Counter(adjusted[k].values())
        d.append(ngram_lm.discounts([n[j] for j in (1, 2, 3, 4)]))
        context.append(collections.defaultdict(lambda: [0, 0, 0, 0]))
        for g, a in adjusted[k].items():
            context[k][g[:-1]][0] += a
            context[k][g[:-1]][min(a, 3)] += 1
    types, total = len(raw[1]), sum(raw[1].values())
    out = []
    for t in rows:
        s, score, base, known = ["<s>"] * pad + tokens(t), 0.0, 0.0, 0
        for q in range(pad, len(s)):
            p = 1 / (types + 1)
            for k in range(1, order + 1):
                g = tuple(s[q - k + 1:q + 1])
                x = context[k].get(g[:-1])
                if x:
                    a = adjusted[k].get(g, 0)
                    p = max(a - (d[k][min(a, 3) - 1] if a else 0), 0) / x[0] + sum(d[k][j] * x[j + 1] for j in range(3)) / x[0] * p
            score += math.log10(p)
            c = raw[1].get((s[q],), 0)
            known += c > 0
            base += math.log10((c + 1) / (total + types + 1))
        out.append((len(s) - pad, known, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_equals_brute_force(spark, order):
    rows = docs(spark) + [(1000, None), (1001, ""), (1002, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    model = ngram_lm.train(df, order=order, where=train)
    got = {r.doc_id: r for r in ngram_lm.score(df, model).collect()}
    want = brute_lm([t for _, t in rows], [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], order)
    for (i, _), (n, known, base, score) in zip(rows, want, strict=True):
        assert (got[i].n_tokens, got[i].n_known) == (n, known)
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(score)


def test_lm_probabilities_sum_to_one_and_empty_training(spark):
    texts = pa.array(["a b a c", "b b a"])
    df = spark.createDataFrame([(t,) for t in texts.to_pylist()], "text string")
    model = ngram_lm.train(df, order=2)
    vocabulary = ["a", "b", "c", "never seen".replace(" ", "")]
    grams, place, owner, number = ngram_lm.ngrams(pa.array([f"a {v}" for v in vocabulary] + ["a"]), 2)
    p, _ = ngram_lm.probabilities(model, model.tables(), grams, place)
    second = number == 1
    assert p[second].sum() == pytest.approx(1.0)      # a, b, c, the end, and one unknown word after "a"
    none = ngram_lm.train(df.where("false"), order=2)
    got = ngram_lm.score(df, none).collect()
    assert none.tokens == 0 and all(r.n_known == 0 and math.isfinite(r.score) for r in got)
    with pytest.raises(ValueError):
        ngram_lm.score(df.withColumn("score", F.lit(1)), model)


def test_lm_entries_are_small_and_exact_and_are_merged_in_rounds(tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) * np.uint64(2))
    values = np.repeat(np.array([[1.0], [1], [1], [1], [0], [0]]), len(key), axis=1)
    some = rng.random(len(key)) < 0.2
    values[:, some] = 1 / rng.integers(1, 9, (6, int(some.sum())))
    blob = ngram_lm._pack(key, values)
    again = ngram_lm._unpack(blob, 6)
    assert (again[0] == key).all() and (again[1] == values).all()
    values[:, some] = 1.0
    blob = ngram_lm._pack(key, values)
    assert len(blob) < 7 * len(key)
    rare = rng.random(len(key)) < 0.02
    values[:, rare] = rng.integers(0, 1 << 34, (6, int(rare.sum())))
    ngram_lm._write(f"{tmp_path}/0", key, values)
    assert sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()) < 11 * len(key)    # six bytes of counts each took 14
    table = ngram_lm.Table(str(tmp_path), 1, 6)
    assert (table.get(key) == values).all() and not table.get(key + np.uint64(1)).any()

    monkeypatch.setattr(ngram_lm, "MERGED", 50, raising=False)
    packed, want = [], collections.Counter()
    for _ in range(40):
        k = np.unique(rng.integers(0, 300, 60).astype(np.uint64))
        packed.append(ngram_lm._pack(k, np.full((1, len(k)), 2.0)))
        want.update({x: 2 for x in k.tolist()})
    batches = [pa.record_batch([pa.array([0], pa.int32()), pa.array([b], pa.binary())], ["part", "blob"]) for b in packed]
    list(ngram_lm._merger(f"{tmp_path}/merged", 1, 1)(iter(batches)))
    table = ngram_lm.Table(f"{tmp_path}/merged", 1, 1)
    assert table.get(np.arange(300, dtype=np.uint64))[0].tolist() == [want[x] for x in range(300)]


def test_lm_training_asks_for_dropped_shuffle_files_and_restores_the_setting(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    shown = []
    real = ngram_lm._merger

    def noted(*a):
        shown.append(spark.conf.get(name, "false"))
        return real(*a)

    df = spark.createDataFrame([("a b a c",), ("b b a",)], "text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ngram_lm, "_merger", noted)
        ngram_lm.train(df)
    assert shown == ["true"] * 3 and spark.conf.get(name, "false") == "false"


# --- toxicity ------------------------------------------------------------------------

def test_toxicity_on_held_out_rows_and_misspellings(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    bad = ["grumbleworth", "snotface", "dreckmuffin"]
    rows = []
    for i in range(600):
        text = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(bad))
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), where=F.col("__id") % 3 != 1)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [r for r in got.values() if r.doc_id % 3 == 1]
    assert sum((r.toxicity >= 0.5) == bool(r.toxic) for r in held) / len(held) > 0.95
    extra = spark.createDataFrame([(1, "grumbleworthy snotfaces dreckmufin"), (2, " ".join(plain[:40])), (3, None), (4, ""), (5, "12 34")],
                                  "doc_id long, text string")
    score = {r.doc_id: r.toxicity for r in toxicity.score(extra, model).collect()}
    assert score[1] > 0.5 > score[2] and score[3] == score[4] == score[5] == 0
    assert toxicity.train(df.select("doc_id", "text"), df.where("toxic = 0").select("doc_id", "toxic")) is None
    assert {r.toxicity for r in toxicity.score(extra, None).collect()} == {0.0}
    assert toxicity.score(extra.where("false"), model).count() == 0


# --- n-gram Jaccard join -------------------------------------------------------------

def brute_groups(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    links = set()
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                links.add((b, a))
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}, links


def near_copies(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            text = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                if text:
                    k = rng.randrange(len(text))
                    text[k:k + 1] = rng.choice([[], [rng.choice(vocabulary)], [text[k], "extra"]])
        else:
            text = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 8, 12, 20, 40, 90, 200]))]
        rows.append((i * 7 % 1009, " ".join(text)))
    return rows


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_jaccard_groups_equal_brute_force(spark, seed, n, percent):
    rows = near_copies(seed, 260)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, links = brute_groups(rows, n, percent)
    assert {r["id"]: (r["n"], r["component"]) for r in jaccard.grouped(df, n=n, percent=percent).collect()} == want
    join = jaccard.self_join(df, n=n, percent=percent, spanning=False)
    node = {r["id"]: r["node"] for r in join.documents.collect()}
    assert {tuple(sorted((r.a, r.b))) for r in join.links.collect()} == {tuple(sorted((node[a], node[b]))) for a, b in links if node[a] != node[b]}


def test_jaccard_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    rows = near_copies(12, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, links = brute_groups(rows, 2, 70)
    assert {r["id"]: (r["n"], r["component"]) for r in jaccard.grouped(df, n=2, percent=70).collect()} == want
    join = jaccard.self_join(df, n=2, percent=70, spanning=False)
    node = {r["id"]: r["node"] for r in join.documents.collect()}
    assert {tuple(sorted((r.a, r.b))) for r in join.links.collect()} == {tuple(sorted((node[a], node[b]))) for a, b in links if node[a] != node[b]}


def test_common_ngrams_change_no_result(spark):
    rows = near_copies(21, 200)
    s = jaccard.sets_of(pa.array([t for _, t in rows]), 3)
    for common in (np.zeros(0, np.uint64), np.unique(s.items), np.unique(s.items)[::3]):
        key, owner = jaccard.keys_of(s, 75, common)
        met = collections.defaultdict(set)
        for k, o in zip(key.tolist(), owner.tolist(), strict=True):
            met[k].add(o)
        pairs = {(a, b) for v in met.values() for a in v for b in v if a < b}
        place = {i: k for k, (i, _) in enumerate(rows)}
        one = jaccard.fingerprints(s)[0]
        for a, b in brute_groups(rows, 3, 75)[1]:
            a, b = sorted((place[a], place[b]))
            assert one[a] == one[b] or (a, b) in pairs


def test_jaccard_keys_meet_for_every_link():
    """The pigeonhole itself: any two sets within the bound share a key, over many sizes."""
    rng = np.random.default_rng(3)
    for size in [2, 6, 7, 8, 9, 12, 14, 19, 30, 45, 90, 150, 400]:
        for _ in range(12):
            a = rng.integers(0, 1 << 62, size).astype(np.uint64)
            budget = jaccard.bound(85, 2 * size)
            out = rng.integers(0, budget // 2 + 1)
            b = np.concatenate([a[out:], rng.integers(0, 1 << 62, max(0, min(out, budget - out))).astype(np.uint64)])
            common = len(np.intersect1d(a, b))
            if 100 * common < 85 * (len(a) + len(b) - common) or len(a) == common == len(b):
                continue
            s = jaccard.Sets(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)]))
            key, owner = jaccard.keys_of(s, 85)
            assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


def test_keys_of_one_set_cost_no_memory_and_stretches_connect_alike(monkeypatch):
    rng = np.random.default_rng(8)
    key, node = np.sort(rng.choice(1 << 40, 200_000, replace=False)).astype(np.uint64), rng.integers(0, 1 << 62, 200_000).astype(np.uint64)
    node[:4] = [7, 9, 5, 9]
    key[:2] = key[0]
    key[2:4] = key[2]
    tracemalloc.start()
    begin, root, pairs = jaccard._spanned(key, node)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * len(key)      # 81 bytes a row when each took part
    assert len(begin) == len(key) - 2 and root[:2].tolist() == [5, 5] and (root[2:] == node[4:]).all()
    assert pairs.tolist() == [[5, 7], [5, 9]]
    for few in (True, False):        # many equal keys, or few
        heads = []
        for n in (0, 50, 1, 90, 70):
            keys = rng.integers(0, 60, n).astype(np.uint64) << np.uint64(58) if few else rng.integers(0, 1 << 63, n).astype(np.uint64) // np.uint64(1 << 56)
            heads.append((np.sort(keys), rng.integers(0, 120, n).astype(np.uint64)))
        group = {}
        for x, y in {(int(v[a]), int(w[b])) for k, v in heads for j, w in heads for a in range(len(k)) for b in range(len(j)) if k[a] == j[b]}:
            one = group.get(x, {x}) | group.get(y, {y})
            group.update(dict.fromkeys(one, one))
        want = sorted([min(g), x] for x, g in group.items() if x != min(g))
        for size in (1, 7, 1000):
            monkeypatch.setattr(jaccard, "KEYS", size)
            assert sorted(jaccard._connected(heads).tolist()) == want
    assert jaccard._connected([]).shape == jaccard._connected(heads[:1]).shape == (0, 2)


def test_jaccard_edges(spark):
    got = {(r["id"], r["n"], r["component"]) for r in jaccard.grouped(edges(spark)).collect()}
    assert (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got and (4, 1, 4) in got and (5, 1, 4) in got
    assert (6, 1, 6) in got and (8, 1, 6) in got
    assert jaccard.grouped(edges(spark).where("false")).count() == 0
    assert jaccard.grouped(edges(spark)).count() == len(EDGES)


def test_components(spark):
    rng = random.Random(2)
    edges_ = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges_, "a long, b long"), Folder(spark)).collect()}
    parent = {x: x for e in edges_ for x in e}
    def find(x):
        return x if parent[x] == x else find(parent[x])
    for a, b in edges_:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for a, b in edges_ if a != b for x in (a, b)}


# --- decontamination -----------------------------------------------------------------

def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        p, t = ("".join(rng.choice("abé") for _ in range(rng.randint(a, 90))) for a in (1, 0))
        assert decontaminate.distance(p, t)[0] == edit_distance(p, t)


def test_hits_equal_brute_force(spark):
    rng = random.Random(4)
    sentence = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    items = [(k, sentence(rng.randint(1, 40))) for k in range(12)] + [(90, None), (91, "  "), (92, "Ab")]
    rows = []
    for i in range(120):
        text = list(sentence(rng.randint(0, 60)))
        if i % 2:
            item = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, len(item) // 15)):
                k = rng.randrange(len(item))
                item[k:k + 1] = rng.choice([[], ["z"], [item[k], "z"]])
            at = rng.randint(0, len(text))
            text[at:at] = item
        rows.append((i, "".join(text).upper() if i % 3 == 0 else "".join(text).replace(" ", " \n ")))
    df = spark.createDataFrame([*rows, (500, None), (501, ""), (7, rows[7][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in [*rows, (500, None)]:
        for k, item in items:
            item, t2 = decontaminate.normalise(item), decontaminate.normalise(t)
            if item:
                d = edit_distance(item, t2)
                if d <= len(item) // decontaminate.PER_ERROR:
                    want[i, k] = d
    got = decontaminate.hits(df, bench).collect()
    assert {(r.doc, r.item): r.distance for r in got} == want and len(got) == len(want) + sum(i == 7 for i, _ in want)
    dirty = {i for i, _ in want}
    assert sorted(r.doc_id for r in decontaminate.clean(df, bench).collect()) == sorted(r.doc_id for r in df.collect() if r.doc_id not in dirty)
    assert decontaminate.hits(df, bench.where("false")).count() == 0 and decontaminate.clean(df, bench.where("false")).count() == df.count()
    assert decontaminate.hits(df.where("false"), bench).count() == 0


# --- quality rules -------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.defaultdict(list)
    for k in range(len(w) - 4):
        windows[tuple(w[k:k + 5])].append(k)
    repeated = {j for v in windows.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(repeated), failed


def test_quality_counts_and_verdicts(spark):
    rows = [*docs(spark), *((2000 + k, t) for k, (_, t) in enumerate(EDGES)), (3000, "a b c d e f " * 9), (3001, "x y\n\nx y\n \nx y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(df, labels)
    scored = quality.score(df, model).collect()
    for r in scored:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(r.text)
        assert not (r.kept and r.base_failed)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    checked = [r for r in scored if r.doc_id in truth and not r.base_failed]
    assert sum(r.kept == bool(truth[r.doc_id]) for r in checked) / len(checked) > 0.9
    assert quality.train(df, labels.where("quality = 1")) is None
    assert all(r.kept != r.base_failed and r.quality is None for r in quality.score(df, None).collect())
    assert quality.score(df.where("false"), model).count() == 0
    with pytest.raises(ValueError):
        quality.score(df.withColumn("kept", F.lit(1)), model)
    assert "__kept" in quality.score(df.withColumn("kept", F.lit(1)), None, prefix="__").columns


# --- HTML ----------------------------------------------------------------------------

@pytest.mark.parametrize(("html", "text"), [
    (None, None), ("", ""), ("<", "<"), ("a < b &amp; c", "a < b & c"),
    ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
    ("<title>T</title><style>x</style><script>'</p>'</script><b>x</b><i>y</i> z", "xy z"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><ol start=4><li>x<li>y</ol>", "- a\n- b\n  - c\n\n4. x\n5. y"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td rowspan=2>r<td>2<tr><td>3</table>", "Name       N\nlong name  1\nr          2\n           3"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab     c\n1   2  3"),
    ("<div hidden>no</div><p style='DISPLAY: none'>no</p><noscript>no</noscript>yes", "yes"),
    ("<pre>\n a\n   b</pre>", " a\n   b"), ("x<blockquote>q</blockquote>y", "x\n\n  q\n\ny"),
    ("<!-- a --><!DOCTYPE html><p>x</div></p>y", "x\n\ny"), ("<td>stray", "stray"), ("a<hr>b", "a\n---\nb"),
])
def test_html_rendering(html, text):
    assert html_text.extract(html) == text


def test_html_survives_hostile_pages(spark):
    pages = ["<div>" * 20_000 + "x", "<table><tr><td>" * 300 + "x", "<" * 50_000, "<a href='" * 5_000, "<ul><li>" * 3_000 + "y", "<td colspan=999999999>z"]
    assert [html_text.extract(p).strip().endswith(t) for p, t in zip(pages, ["x", "x", "<", "", "y", "z"], strict=True)] == [True] * 6
    df = spark.createDataFrame([(1, None, 5), (1, "<p>a", 6), (2, "", 7)], "page_id long, html string, text int")
    assert sorted((r.page_id, r.visible_text) for r in html_text.with_text(df).collect() if r.visible_text) == [(1, "a")]
    with pytest.raises(ValueError):
        html_text.with_text(df, out="text")


# --- quotation linking ---------------------------------------------------------------

def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "user", "How do I sort a list in place?\nI use python three."),
        (1, 1, "assistant", "> How do I sort a list in place?\nUse list.sort().\n\nIt works without copying the list."),
        (1, 2, "user", "On Monday X wrote:\n> Use list.sort().\n>\n> It works without copying\n> the list.\n>> How do I sort a list in place?\nThanks"),
        (2, 0, "user", "> > How do I SORT a list  in place?\nsame question here"), (3, 0, "user", None), (3, 1, "a", ""), (3, 1, "a", ""),
        (None, 1, "a", "x"), (3, None, "a", "y"), (4, 0, "user", "> nobody has ever written this line\nanswer"), (5, 0, "a", "a > b\n  >quoted text that is not long"),
    ]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {(r.conv, r.turn): r for r in quotes.conversations(df).collect()}
    assert (got[1, 1].parent_conv, got[1, 1].parent_turn, got[1, 1].text) == (1, 0, "Use list.sort().\n\nIt works without copying the list.")
    assert (got[1, 2].parent_turn, got[1, 2].level, got[1, 2].text) == (1, 1, "Thanks")
    assert (got[2, 0].parent_conv, got[2, 0].level, got[2, 0].thread, got[2, 0].text) == (1, 2, 1, "same question here")
    assert got[4, 0].parent_conv is None and got[4, 0].text == "answer" and got[5, 0].text == "a > b" and got[3, 0].text is None
    everything = quotes.conversations(df).collect()
    by = collections.defaultdict(list)
    for r in everything:
        by[r.thread].append(r.position)
        if r.parent_conv is not None:
            assert got[r.parent_conv, r.parent_turn].position < r.position
    assert len(everything) == len(rows) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert quotes.conversations(df.where("false")).count() == 0


def test_short_quotes_link_inside_and_all_matches_join_threads(spark):
    rows = [
        (1, 0, "a", "Shall I go on?"), (1, 1, "b", "Yes, please do."), (1, 2, "a", "> Yes, please do.\nDone."),
        (2, 0, "a", "a first long line of conversation two"), (3, 0, "a", "a first long line of conversation three"),
        (4, 0, "b", "> a first long line of conversation three\nand\n> a first long line of conversation two\nboth"),
        (5, 0, "b", "> Yes, please do.\nwho?"), (5, 1, "b", "> who?\n>\nme"), (6, 0, "b", "> \nempty"),
    ]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    out = quotes.conversations(df).collect()
    got = {(r.conv, r.turn): r for r in out}
    assert (got[1, 2].parent_conv, got[1, 2].parent_turn, got[1, 2].text) == (1, 1, "Done.")
    assert {r.thread for r in out if r.conv in (2, 3, 4)} == {2} and got[4, 0].parent_conv == 3
    assert got[5, 0].parent_conv is None and got[5, 1].parent_turn == 0 and {r.thread for r in out if r.conv in (5, 6)} == {5, 6}
    columns = ["conv_id", "turn", "role", "text", "thread_id", "position", "parent_conv", "parent_turn", "level"]
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    want = con.sql(ORACLES["op5_chat_formatting"]).select(*columns).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in ["conv", "turn", "role", "text", "thread", *columns[5:]])) for r in out)


def test_one_line_that_everybody_quotes(spark):
    line = "the very same line in every message"
    df = spark.range(3000).select((F.col("id") % 3).alias("conv_id"), (F.col("id") / 3).cast("int").alias("turn"),
                                  F.lit("user").alias("role"), F.lit(f"> {line}\n{line}").alias("text"))
    got = quotes.conversations(df)
    assert got.count() == 3000 and got.where("parent_conv IS NULL").count() == 1
    assert got.agg(F.max("position"), F.countDistinct("position")).first() == (2999, 3000)


# --- license scans -------------------------------------------------------------------

def test_licenses_own_and_inherited(spark):
    rows = [
        (1, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
        (2, "a/b/c.py", "print()"), (3, "a/b/d.py", "# SPDX-License-Identifier: Apache-2.0\nprint()"), (4, "z.py", "print()"),
        (5, "a/b/e/COPYING", "This work is licensed under the GNU General Public License, version 3."), (6, "a/b/e/f/g/h.py", None), (7, None, "text"),
        (8, "ab/x.py", ""), (9, "k/y.py", "licence of a poet and " + "many other words " * 40), (2, "a/b/c.py", "print()"), (None, "a/n.py", "x"),
    ]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    out = licenses.scan(df).collect()
    got = {(r.id, r.path): (r.license, r.origin, r.from_dir) for r in out}
    assert got[1, "a/LICENSE"][:2] == ("MIT", "own") and got[2, "a/b/c.py"] == ("MIT", "inherited", "a") and got[3, "a/b/d.py"][:2] == ("Apache-2.0", "own")
    assert got[4, "z.py"] == (None, None, None) and got[5, "a/b/e/COPYING"][:2] == ("GPL-3.0", "own")
    assert got[6, "a/b/e/f/g/h.py"] == ("GPL-3.0", "inherited", "a/b/e") and got[7, None][0] is None and got[8, "ab/x.py"][0] is None
    assert got[9, "k/y.py"][0] is None and got[None, "a/n.py"] == ("MIT", "inherited", "a") and len(out) == len(rows)
    root = licenses.scan(df.unionByName(spark.createDataFrame([(20, "LICENSE", "Released under the MIT License.")], df.schema))).collect()
    assert {r.id: r.from_dir for r in root}[4] == ""
    assert licenses.scan(df.where("false")).count() == 0


def test_native_operators_run_no_python(spark):
    for name in ("op5_chat_formatting", "op8_license_scans"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|MapIn", plan)


# --- sharding ------------------------------------------------------------------------

def item_wise(sizes, capacity):
    bins = []
    for s in sizes:
        fits = [(r, -k) for k, r in enumerate(bins) if r >= s]
        if fits:
            tightest = min(r for r, _ in fits)
            bins[next(k for k, r in enumerate(bins) if r == tightest)] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


def test_runs_pack_like_single_items():
    rng = random.Random(9)
    for _ in range(60):
        count = collections.Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 60)))
        sizes = sorted(count.items(), reverse=True)
        runs, n = sharding.best_fit(sizes, 50)
        rest = collections.Counter()
        for s, k, shard in runs:
            rest[shard] += s * k
        assert sorted(50 - v for v in rest.values()) == item_wise([s for s, k in sizes for _ in range(k)], 50) and n == len(rest)
    with pytest.raises(ValueError):
        sharding.best_fit([(60, 1)], 50)


def test_shards_hold_groups_whole_and_fill_evenly(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 400) + str(rng.randint(0, 150))) for i in range(2000)] + [(5000, None), (5001, ""), (5002, None), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash"))
    got = sharding.shard(df, shards=16).collect()
    assert sorted((r.id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    shard_of, slots, filled = collections.defaultdict(set), collections.defaultdict(list), collections.Counter()
    for r in got:
        shard_of[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
        filled[r.shard] += r.size
    assert all(len(s) == 1 for s in shard_of.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(filled) == set(range(16)) and max(filled.values()) - min(filled.values()) < 800
    hot = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "y" * 99).otherwise(F.repeat(F.lit("z"), (F.col("id") % 90).cast("int"))).alias("text"))
    sums = collections.Counter()
    for r in sharding.shard(hot, shards=16).collect():
        sums[r.shard] += r.size
    assert max(sums.values()) < 1.2 * sum(sums.values()) / 16      # a group of over a third of all bytes is cut
    fixed = sharding.shard(hot, capacity=8000).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert max(r.s for r in fixed) <= 8000 and len(fixed) <= -(-sum(sums.values()) // 8000) + 1
    assert sharding.shard(df.where("false"), shards=4).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(df)


# --- mixing --------------------------------------------------------------------------

def test_schedule_deviates_less_than_a_block():
    rng = random.Random(6)
    for _ in range(30):
        shares = {f"s{k}": rng.randint(1, 40) for k in range(rng.randint(1, 9))}
        total, slots = sum(shares.values()), mixing.period(shares)
        assert sorted(x for v in slots.values() for x in v) == list(range(total))
        for s, a in shares.items():
            for j, t in enumerate(slots[s]):
                assert j * total // a <= t < -(-(j + 1) * total // a)      # release and deadline
            for t in range(total + 1):
                assert abs(sum(x < t for x in slots[s]) - a * t / total) < 1


def test_mix_places_every_row(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else f"s{i % 7}") for i in range(1500)] + [(9000, "x", None), (9001, None, ""), (4, "t4", "big"), (4, "t4", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("slot", F.lit(1))
    weights = {"big": 0.5, "s0": 0.2, "s3": 0.2, "s6": 0.1, "": 0.0}
    got = mixing.schedule(df, weights, block_rows=8).schedule.collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows)
    assert len({(r.slot, r.offset) for r in got}) == len(rows)
    source = {}
    for r in got:
        assert source.setdefault(r.slot, r.source) == r.source
    assert sorted(source) == list(range(len(source)))
    end = min(r.slot for r in got if r.phase)
    known = {s: w for s, w in weights.items() if w}
    for t in range(1, end + 1):
        seen = collections.Counter(source[k] for k in range(t))
        assert all(abs(seen[s] - t * w / sum(known.values())) < 1.01 for s, w in known.items())
    kept = mixing.mixed(df, weights, block_rows=8)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.id for r in got if r.phase == 0)
    assert mixing.schedule(df.where("false")).schedule.count() == 0 and mixing.mixed(df.where("false")).count() == 0


def test_schedule_follows_exact_weights_for_any_number_of_sources():
    for counts in ({"hot": 100_000} | {f"s{k}": 10_000 for k in range(20)}, {"hot": 1_000_000} | {f"s{k}": 400 for k in range(5000)},
                   {f"s{k}": 1 + k % 40 for k in range(12_000)}):
        weights = {s: n ** 0.7 for s, n in counts.items()}
        blocks, known = {s: -(-n // 16) for s, n in counts.items()}, sum(weights.values())
        places, ends = mixing.slots(blocks, weights)
        assert sorted(np.concatenate([*places.values()])) == list(range(sum(blocks.values())))
        for s in [*counts][:25]:
            for t in range(0, ends[0] + 1, 7):
                assert abs(np.searchsorted(places[s], t) - t * weights[s] / known) < 1.001


# --- queries -------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_keep_one_row_per_input(spark, name):
    got = QUERIES[name](spark, SF)
    table = "pages" if name.startswith("op6") else "conversations" if name.startswith("op5") else "documents"
    n = got.count()
    assert n > 0 if name.startswith("op4") else n == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_nothing_else_imports_the_subpackage():
    root = __file__.rsplit("/tests/", 1)[0]
    for path in glob.glob(f"{root}/glyphgate/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path) as f:
                assert "glyphgate.llm" not in f.read(), path


def test_jaccard_with_one_id_for_different_texts(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, "quite another text of a few words"), (1, text), (2, text + " more"), (3, "quite another text of a few words indeed, or not")]
    got = collections.Counter((r["id"], r["n"], r["component"]) for r in jaccard.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, 56, 1): 2, (1, 3, 1): 1, (2, 57, 1): 1, (3, 6, 3): 1}


def test_quote_statement_equals_spark_on_quoted_mail(spark, tmp_path):
    """The statement behind op5, on a table that does hold quotes."""
    import duckdb
    rng = random.Random(8)
    said, rows = [], []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            lines = []
            for _ in range(rng.randint(0, 2)):
                if said:
                    if rng.random() < 0.3:
                        lines.append("On Friday Z wrote:")
                    mark = rng.choice(["> ", ">", ">> ", " > > "])
                    lines += [mark + x for x in rng.choice(said).split("\n")]
            own = "\n".join(" ".join(f"word{rng.randint(0, 30)}" for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 3)))
            said.append(own)
            rows.append((conv, turn, "user", "\n".join([*lines, own]) if rng.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op5_chat_formatting"](spark, str(tmp_path))
    columns = sorted(got.columns)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op5_chat_formatting']})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))
    assert got.where("parent_conv IS NOT NULL").count() > 20 and got.where("thread_id <> conv_id").count() > 5


def test_registered_lm_scores_with_triples(spark):
    rows = docs(spark)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    got = {r.doc_id: r.score for r in QUERIES["op1_lm_scoring"](spark, SF).collect()}
    for (i, _), (*_, score) in zip(rows, brute_lm([t for _, t in rows], train, 3), strict=True):
        assert got[i] == pytest.approx(score)
