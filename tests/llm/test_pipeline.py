"""Tests of the corpus pipeline's stages."""

import collections
import itertools
import random
import re

import corpus_pipeline
import numpy as np

from glyphgate.llm import jaccard
from glyphgate.llm.work import Folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_mixing_stage_keeps_every_row_and_orders_the_shards(spark):
    sources = ["hot"] * 2000 + ["a"] * 300 + ["b"] * 300 + ["one"] + [None] * 2
    rows = [(k, f"text {k}", "en", s, 9) for k, s in enumerate(sources)] + [(None, "no id", "en", "a", 5)] * 2
    df = spark.createDataFrame(rows, DOCS)
    mixed = corpus_pipeline.source_mixing(spark, df, "").collect()
    assert sorted(map(repr, (tuple(r)[:5] for r in mixed))) == sorted(map(repr, rows))
    place = {r.doc_id: r.mix_at for r in mixed}
    early = [r.source for r in mixed if r.mix_at < 640]
    assert early.count("a") > 50 and early.count("b") > 50
    out = corpus_pipeline.shards(spark, spark.createDataFrame(mixed, DOCS + ", mix_at long"), "").collect()
    assert len(out) == len(rows)
    for shard in {r.shard for r in out}:
        places = [place[r.doc_id] for r in sorted((r for r in out if r.shard == shard), key=lambda r: r.slot)]
        assert places == sorted(places)


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(words[k:] for k in range(n)))) if len(words) >= n else frozenset([tuple(words)] if words else [])


def first_rows(rows):
    """Brute force of the near-duplicate stage."""
    sets = {shingles(r[1]) for r in rows} - {frozenset()}
    group = {s: s for s in sets}

    def root(s):
        while group[s] != s:
            s = group[s]
        return s
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            group[root(a)] = root(b)
    best, out, seen = {}, [], set()
    for r in rows:
        s = shingles(r[1])
        if s and r[0] is not None:
            best[root(s)] = min(best.get(root(s), (1 << 62,)), (r[0],))
    for r in rows:
        s = shingles(r[1])
        if not s or r[0] is None:
            out.append(r)
        elif (r[0],) == best[root(s)]:
            out.append((r[0], root(s)))
    # of rows with the group's first id one stays
    plain = [r for r in out if not (len(r) == 2 and isinstance(r[1], frozenset))]
    return plain, {r for r in out if len(r) == 2 and isinstance(r[1], frozenset)}, root


def text(rnd, n=40):
    return " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(n))


def corpus():
    rnd = random.Random(4)
    a, b, c, d = (text(rnd) for _ in range(4))
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (3, a, "en", "s", 1), (9, c, "en", "s", 1), (9, d, "en", None, 1), (9, d, "en", None, 1)]
    for k in range(20, 60):
        base = text(rnd)
        rows.append((k, base, "en", "s", 2))
        if k % 3 == 0:
            rows.append((k + 100, base.upper() + " tail", "de", "t", 2))       # a near copy
        if k % 5 == 0:
            rows.append((k, base + " tail", "de", "one", 2))                    # a near copy under the same id
    rows += [(None, a, "en", "s", 1), (None, None, None, None, None), (70, None, "en", "s", None), (71, "", "en", "s", 0), (72, " \n", "en", "s", 0),
             (73, "two words", "en", "s", 0), (74, "Two words", "en", "lone", 0)]
    return rows


def test_near_duplicates_keep_every_distinct_text(spark):
    rows = corpus()
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = [tuple(r) for r in out.collect()]
    plain, firsts, root = first_rows(rows)
    assert sorted(map(repr, (r for r in got if r[0] is None or not shingles(r[1])))) == sorted(map(repr, plain))
    kept = [(r[0], root(shingles(r[1]))) for r in got if r[0] is not None and shingles(r[1])]
    assert len(kept) == len(set(kept)) and set(kept) == firsts
    assert {(5, shingles(rows[1][1])), (9, shingles(rows[3][1])), (9, shingles(rows[4][1]))} <= {(r[0], shingles(r[1])) for r in got}
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], DOCS), "").collect() == []


def test_mixing_replaces_a_column_of_its_name(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 1, "old"), (2, "b", "en", None, 1, "old")], DOCS + ", mix_at string")
    out = corpus_pipeline.source_mixing(spark, df, "")
    assert out.columns.count("mix_at") == 1 and len({r.mix_at for r in out.collect()}) == 2


def test_run_keeps_clean_texts_and_places_each_row_once(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30, 40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = rows[20][1]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    passed = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert len(passed) < len(rows)
    _, firsts, _ = first_rows([tuple(r) for r in passed])
    texts = collections.Counter(i for i, s in firsts if s != shingles(item) and not s >= shingles(item))
    got = collections.Counter(r.doc_id for r in out if r.doc_id is not None)
    assert got == texts
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def random_sets(rng, sizes):
    items = rng.integers(0, 1 << 62, int(sizes.sum())).astype(np.uint64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return jaccard.Sets(rows, items[np.lexsort((items, rows))], sizes)


def test_unrelated_sets_share_hardly_any_key():
    """Segments that chance leaves without n-grams, or with one that a deletion takes, are no keys that thousands of sets have."""
    s = random_sets(np.random.default_rng(5), np.random.default_rng(6).integers(60, 125, 4000))
    key, owner = jaccard.keys_of(s, 80)
    order = np.lexsort((owner, key))
    _, _, joined = jaccard._spanned(key[order], owner[order].astype(np.uint64))
    assert len(joined) < 20


def test_sketches_differ_in_no_more_bits_than_their_sets():
    rng = np.random.default_rng(7)
    sizes = np.repeat([1, 5, 40, 63, 64, 65, 100, 130, 500], 6)
    s = random_sets(rng, sizes)
    whole = [s.items[s.rows == k] for k in range(len(sizes))]
    changed = []
    for x in whole:      # near copies of other sizes, whose sketches may be longer
        out = rng.integers(0, max(1, len(x) // 8) + 1)
        changed.append(np.sort(np.concatenate([x[out:], rng.integers(0, 1 << 62, len(x) // 10 + 1).astype(np.uint64)])))
    t = jaccard.Sets(np.repeat(np.arange(len(sizes)), [len(x) for x in changed]), np.concatenate(changed), np.array([len(x) for x in changed]))
    left, right = jaccard.sketches_of(s), jaccard.sketches_of(t)
    for k, (a, b) in enumerate(zip(whole, changed, strict=True)):
        for j in (k, (k + 6) % len(whole)):
            parity = jaccard._parities([left[k], right[j]])
            apart = int(jaccard._apart(parity[:1], parity[1:])[0, 0])
            differ = len(np.setxor1d(a, changed[j]))
            assert apart <= differ and (j != k or apart % 2 == differ % 2)
    parity = jaccard._parities([x for x, n in zip(left, sizes, strict=True) if n >= 100])
    total = np.repeat([100, 130, 500], 6)
    apart = jaccard._apart(parity[:12], parity[:12]) > (total[:12, None] + total[None, :12]) // 9
    assert (apart | np.eye(12, dtype=bool)).all()     # unrelated sets of like size don't pass


def test_large_clusters_are_split_before_their_sets_are_copied(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    monkeypatch.setattr(jaccard, "SKETCH_BLOCK", 16)
    rng = np.random.default_rng(9)
    s = random_sets(rng, rng.integers(80, 100, 150))
    held = {k: s.items[s.rows == k].view(np.int64).tolist() for k in range(150)}
    for k in range(30):           # k, 200 + k and 300 + k: a chain of near copies
        held[200 + k] = held[k][4:] + rng.integers(0, 1 << 62, 4).tolist()
        held[300 + k] = held[200 + k][:-8] + rng.integers(0, 1 << 62, 4).tolist()
    held[400] = held[149]         # alone in a cluster of one block
    sets = spark.createDataFrame([(k, v) for k, v in held.items()] + [(0, held[0])], "node long, items array<long>")
    clusters = spark.createDataFrame([(k, len(v), -7 if k < 400 else -8) for k, v in held.items()], "node long, n long, cluster long")
    out = jaccard._split(sets, clusters, 80, Folder(spark)).collect()
    groups = collections.defaultdict(set)
    for r in out:
        assert r.n == len(held[r.node])
        groups[r.cluster].add(r.node)
    assert sorted(map(sorted, groups.values())) == sorted([*([k, 200 + k, 300 + k] for k in range(30)), [400]])
    # every set goes to the one task of its cluster
    assert jaccard._tasks(jaccard._split(sets, clusters, 80, Folder(spark)), 80, jaccard.BLOCK).count() == 91


def test_near_duplicates_of_a_chained_cluster(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "SKETCH_BLOCK", 12)
    rnd = random.Random(11)
    line = text(rnd, 30)
    rows = []
    for k in range(120):          # texts that share a passage, each with a chain of near copies
        base = line + " " + text(rnd, rnd.randint(10, 60))
        rows += [(3 * k, base, "en", "s", 1), (3 * k + 1, base + " more", "en", "s", 1), (3 * k + 2, base + " more or less", "en", "s", 1)]
    out = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect()]
    _, firsts, root = first_rows(rows)
    assert sorted((r[0], root(shingles(r[1])) in {f[1] for f in firsts}) for r in out) == sorted((f[0], True) for f in firsts)
