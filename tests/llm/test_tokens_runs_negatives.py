"""Token files, periodic runs and hard negatives against brute force, and their edge cases."""

import glob
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from glyphgate.llm import negatives, runs, token_files
from glyphgate.llm.catalog import QUERIES
from glyphgate.llm.work import Folder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
EDGES = [(3, None), (2, ""), (1, " \n\t "), (4, "one"), (5, "x" * 70_000 + " tail"), (8, "a b c"), (8, "a b c"), (8, "b " * 30),
         (None, "no id here at all"), (9, "éà ü\x0bñ \x00 z 日本 <|endoftext|> 🙂")]


def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def edges(spark):
    rows = [(i, t, "clash", 1, 2) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, ids int, runs int")


# --- token files -------------------------------------------------------------------------

def encoded_by_hand(rows):
    model = Tokenizer.from_file(VOCABULARY)
    return [(i, model.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_query_equals_brute_force(spark):
    want, start = [], 0
    for i, ids in encoded_by_hand(sorted(docs(spark))):
        want.append((i, start, len(ids), digest(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op11_token_files"](spark, SF).collect()) == want


def test_pieces_give_the_same_ids(monkeypatch):
    model = Tokenizer.from_file(VOCABULARY)
    rnd = random.Random(3)
    words_ = ["don't", "Ünï", "a", "end.", "  two", "x1 9y", "日本", "\n\nline", "I'll", "<|endoftext|>", "tab\t", "Zoë", "go"]
    texts = [rnd.choice(["", " ", "\u2003"]) + "".join(rnd.choice(words_) + rnd.choice([" ", "  ", " ", " \n", "\x1f ", "\u2028 "]) for _ in range(rnd.randint(0, 900)))
             for _ in range(30)] + ["", " ", "x" * 1000]
    assert list(token_files.segments("x" * 1000, 100)) == ["x" * 1000] and list(token_files.segments("")) == [""]
    monkeypatch.setattr(token_files, "KNOWN", 10)
    coder = token_files._Coder(VOCABULARY)
    for text in texts:
        cut = list(token_files.segments(text, 100))
        assert "".join(cut) == text and (len(text) < 2000 or len(cut) > 10)
        got = np.frombuffer(b"".join(coder.ids(cut)), "<i4").tolist()
        assert got == model.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_are_ordered_encoded_and_read_in_parts(spark, encoding):
    folder = Folder(spark)
    path = f"{folder.path}/files"
    token_files.write(spark.read.parquet(f"{SF}/documents.parquet"), path, VOCABULARY, text_per_file=100_000, row_group_rows=20, page_bytes=4 << 10, page_rows=5,
                      encoding=encoding)
    files = sorted(glob.glob(f"{path}/part-*"))
    assert len(files) > 2
    seen, groups = [], 0
    for f in files:
        meta, table = pq.ParquetFile(f).metadata, pq.read_table(f)
        seen += table.column("id").to_pylist()
        ends = np.cumsum(table.column("n_tokens").to_numpy())
        assert table.column("until").to_pylist() == ends.tolist() and table.column("at").to_pylist() == [0, *ends[:-1].tolist()]
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index and column.has_column_index
                if column.path_in_schema.startswith("ids"):
                    assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in column.encodings
                elif column.path_in_schema in ("at", "until", "n_tokens"):
                    assert "DELTA_BINARY_PACKED" in column.encodings
    want = encoded_by_hand(sorted(docs(spark)))
    assert seen == [i for i, _ in want] and groups > len(files)

    rows = token_files.read(spark, path)
    stream = [x for _, ids in want for x in ids]
    for first, last in ((0, 5), (39_000, 90_001), (len(stream) - 3, len(stream) + 50), (77, 77), (len(stream) + 1, len(stream) + 9)):
        got = token_files.token_range(rows, first, last).orderBy("start").collect()
        assert [x for r in got for x in r.ids] == stream[first:last]
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = token_files.token_range(rows, 10_000, 41_000)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.findall(r"PushedFilters: (.*)", plan)[0]
    assert "GreaterThan(until,10000)" in pushed and "LessThan(at," in pushed and "LessThanOrEqual(part,1)" in pushed
    some = token_files.documents(rows, F.col("id").between(17, 19))
    assert {r.id: list(r.ids) for r in some.collect()} == {i: ids for i, ids in want if 17 <= i <= 19}
    found = token_files.manifest(rows)
    assert "ids" not in re.findall(r"ReadSchema: (.*)", found._jdf.queryExecution().toString())[0]
    assert [r.start for r in found.orderBy("part").collect()][0] == 0
    assert found.agg(F.sum("n_tokens")).first()[0] == len(stream)


def test_encoded_rows(spark):
    got = token_files.encode(edges(spark), VOCABULARY).collect()
    assert sorted(((r.id, list(r.ids)) for r in got), key=repr) == sorted(encoded_by_hand(EDGES), key=repr)
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_BYTES", 5000, raising=False)
    batch = pa.record_batch([pa.array(range(40), pa.int64()), pa.array(["a word or two, " * 100] * 40)], ["id", "text"])
    got = list(token_files._encoded(iter([batch]), VOCABULARY, 0))
    assert [x for b in got for x in b.column("id").to_pylist()] == list(range(40)) and max(b.num_rows for b in got) <= 4
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    with token_files.small_batches(spark):
        assert spark.conf.get(name) == "5000"
        sizes = spark.range(0, 40, 1, 1).select(F.array_repeat(F.col("id"), 200)).mapInArrow(
            lambda bs: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in bs), "n long").collect()
    assert max(r.n for r in sizes) <= 5 and spark.conf.get(name, None) is None


def test_a_different_piece_is_looked_up_once_a_group():
    class Counted(dict):
        lookups = 0

        def __contains__(self, piece):
            Counted.lookups += 1
            return super().__contains__(piece)

        def __getitem__(self, piece):
            Counted.lookups += 1
            return super().__getitem__(piece)

        def get(self, piece, default=None):
            Counted.lookups += 1
            return super().get(piece, default)

    coder = token_files._Coder(VOCABULARY)
    coder.known = Counted()
    text = "some words, some words and \x00 others again. " * 20
    want = Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    for _ in range(2):
        Counted.lookups = 0
        assert np.frombuffer(coder.ids([text])[0], "<i4").tolist() == want
    assert 0 < Counted.lookups <= len(coder.known)


def test_pieces_end_before_punctuation_only_where_the_tokenizer_cuts():
    model = Tokenizer.from_file(VOCABULARY)
    coder = token_files._Coder(VOCABULARY)
    texts = ["So, a dog.\nA cat; it's: 'tis! Don't?! x.y a.b.c 1,2.3 e,f ,g .h", "\u00e9, \u00e9t\u00e9. z\u2028, q\u00a0. \u1e9e: \u3000,", ",", " ", "", "a", "a, ",
             " lead", "tail ", "a  b", "a\t b", "<|endoftext|>,a<|endoftext|> b.<|endoftext|>", "\u65e5\u672c \u8a9e, \U0001f642 ok."]
    want = [model.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):      # learned, then looked up
        assert [np.frombuffer(x, "<i4").tolist() for x in coder.ids(texts)] == want
    assert {chr(c) for c in np.flatnonzero(coder.ends)} == set(",.;:!?")
    assert sum(x[1:].isalpha() for x in coder.known) > sum("," in x for x in coder.known)


def test_pieces_seen_again_are_remembered(monkeypatch):
    coder, plain, encoded = token_files._Coder(VOCABULARY), token_files._Coder._plain, []
    monkeypatch.setattr(token_files, "KNOWN", 400)
    monkeypatch.setattr(token_files._Coder, "_plain", lambda self, texts: encoded.extend(texts) or plain(self, texts))
    model, often = Tokenizer.from_file(VOCABULARY), " ".join(f"common{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100))
    for k in range(20):
        text = f"go {often} " + " ".join(f"rare{chr(97 + k)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(150))
        assert np.frombuffer(coder.ids([text])[0], "<i4").tolist() == model.encode(text, add_special_tokens=False).ids
        assert len(coder.known) == len(coder.seen) == len(coder.at) - 1 <= 651 and coder.at[-1] == len(coder.flat)
    assert sum(t.count(" common") for t in encoded) == 100 and sum(t.count(" rare") for t in encoded) == 3000


def test_pieces_whose_ends_are_not_found_are_encoded_alone(monkeypatch):
    monkeypatch.setattr(token_files, "JOINED", 40)
    model = Tokenizer.from_file(VOCABULARY)
    words_ = [f"{a}{b}{c}" for a in ("cat", "dog", "Z\u00fcrich", "\u65e5\u672c") for b in ("", "s", "ness", "q") for c in ("", "ly", "zx")]
    texts = ["go " + " ".join(words_), "\n".join(reversed(words_)), "", "go"]
    want = [model.encode(t, add_special_tokens=False).ids for t in texts]
    for sizes in (lambda n: n, lambda n: n + (np.arange(len(n)) % 7 == 0), lambda n: n - (np.arange(len(n)) % 5 == 0), lambda n: 0 * n + 1, lambda n: n + 90):
        coder = token_files._Coder(VOCABULARY)
        coder.bytes = sizes(coder.bytes)
        for _ in range(2):
            assert [np.frombuffer(x, "<i4").tolist() for x in coder.ids(texts)] == want


def test_pieces_begin_at_line_ends_only_where_the_tokenizer_cuts(tmp_path):
    texts = ["One.\nTwo\nthree\n\nfour \n five\r\nsix;\n7\n8\n", "\n", "\na", "a\n", "a\n.\n\u00e9\n\u65e5\n\u2028\nx"]
    for pattern in (None, r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"):
        model = Tokenizer.from_file(VOCABULARY)
        if pattern:
            model.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        path = str(tmp_path / f"{pattern is None}.json")
        model.save(path)
        coder = token_files._Coder(path)
        assert np.flatnonzero(coder.gaps).tolist() == ([32] if pattern else [10, 32])
        want = [model.encode(t, add_special_tokens=False).ids for t in texts]
        for _ in range(2):
            assert [np.frombuffer(x, "<i4").tolist() for x in coder.ids(texts)] == want


def test_texts_longer_than_a_segment_between_others():
    texts = ["short one", None, "many words, " * 40_000 + "\n" + "x" * 300_000, "", "last"]
    batch = pa.record_batch([pa.array(range(5), pa.int64()), pa.array(texts)], ["id", "text"])
    got = [tuple(r.values()) for b in token_files._encoded(iter([batch]), VOCABULARY, 0) for r in b.to_pylist()]
    want = encoded_by_hand(enumerate(texts))
    assert got == [(i, len(ids), ids) for i, ids in want]


def test_token_files_of_edge_cases(spark):
    folder = Folder(spark)
    token_files.write(edges(spark), f"{folder.path}/files", VOCABULARY, text_per_file=9)
    rows = token_files.with_start(token_files.digests(token_files.read(spark, f"{folder.path}/files"))).orderBy("start").collect()
    want = sorted(((i, len(ids), digest(ids)) for i, ids in encoded_by_hand(EDGES)), key=repr)
    assert sorted(((r.id, r.n_tokens, r.ids_crc32) for r in rows), key=repr) == want
    assert [r.id for r in rows] == [None, *sorted(i for i, _ in EDGES if i is not None)]
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(len(rows))]
    token_files.write(edges(spark).limit(0), f"{folder.path}/none", VOCABULARY)
    assert token_files.with_start(token_files.digests(token_files.read(spark, f"{folder.path}/none"))).collect() == []
    named = spark.createDataFrame([("b", "x"), ("a", "y")], "doc_id string, text string")
    token_files.write(named, f"{folder.path}/named", VOCABULARY)
    assert [r.id for r in token_files.read(spark, f"{folder.path}/named", named.schema["doc_id"].dataType).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        token_files.write(named, f"{folder.path}/other", VOCABULARY, encoding="gzip")


# --- periodic runs -----------------------------------------------------------------------

def brute_runs(s, least, exponent):
    n, out = len(s), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(least, exponent * p) and not any(
                    all(s[i + k] == s[i + k + q] for k in range(length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_lengths_and_runs_equal_brute_force():
    rnd = random.Random(1)

    def longest(s, i):
        return max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j)))

    for _ in range(400):
        s = [rnd.randint(1, rnd.randint(1, 4)) for _ in range(rnd.randint(1, 24))]
        assert runs.lyndon_lengths(np.array(s)).tolist() == [longest(s, i) for i in range(len(s))]
        s = s[:rnd.randint(1, len(s))] * rnd.randint(1, 3)
        other = [rnd.randint(1, 2) for _ in range(rnd.randint(1, 9))]
        got = runs.runs_of(np.array([0, *s, -1, *other, -2]), 2, Fraction(2)).tolist()
        assert got == ([[a + 1, b, c] for a, b, c in brute_runs(s, 2, 2)]
                       + [[a + 2 + len(s), b, c] for a, b, c in brute_runs(other, 2, 2)])
    assert runs.lyndon_lengths(np.zeros(0, np.int64)).tolist() == []


def planted(i, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(i).encode()), len(WORD.findall(text or ""))
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    return words


def collapsed(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_run_query_equals_brute_force(spark):
    with_runs = 0
    want = []
    for i, text in docs(spark):
        words = planted(i, text)
        found = brute_runs(words, 24, 3) if len(words) < 3000 else None
        if found is None:
            want.append((i, None))
            continue
        with_runs += bool(found)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        want.append((i, (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                         hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, found).encode()).hexdigest())))
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(want) and with_runs > 5
    for i, w in want:
        assert w is None or got[i] == w, i


def test_runs_of_edge_cases(spark):
    long = "lead " + "one two three " * 4000 + "tail"
    df = edges(spark).unionByName(spark.createDataFrame([(20, long, "", 1, 2)], "doc_id long, text string, id string, ids int, runs int"))
    got = runs.find(df).collect()
    assert len(got) == len(EDGES) + 1
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(([tuple(x) for x in r.runs], r.collapsed))
    assert by[3] == by[2] == by[1] == [([], "")] and by[4] == [([], "one")]
    assert sorted(by[8], key=repr) == sorted([([], "a b c")] * 2 + [([(0, 30, 1)], "b")], key=repr)
    assert by[None] == [([], "no id here at all")]
    assert by[20] == [([(1, 12000, 3)], "lead one two three tail")]
    assert runs.find(df.limit(0)).collect() == []
    low = runs.find(spark.createDataFrame([("k", "a b a b c c")], "doc_id string, text string"), min_length=2, min_exponent=2).first()
    assert low.id == "k" and [tuple(x) for x in low.runs] == [(0, 4, 2), (4, 2, 1)]
    with pytest.raises(ValueError):
        runs.find(df, min_exponent=1.5)


# --- hard negatives ----------------------------------------------------------------------

def brute_negatives(rows, anchor, positives=5, negatives_=10, low=30, high=90):
    """``rows``: (id, vector, label); repeated ids are separate rows."""
    usable = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
              if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    for k, (i, v, y) in enumerate(usable):
        if not anchor(i):
            continue
        others = sorted((-score(v, w), j, m) for m, (j, w, z) in enumerate(usable) if m != k and z == y)[:positives]
        for s, j, _ in others:
            s = -s
            fit = sorted((-score(v, w), m, z) for m, w, z in usable if z != y and 30 * s <= 100 * score(v, w) <= 90 * s
                         ) if (low, high) == (30, 90) else sorted(
                (-score(v, w), m, z) for m, w, z in usable if z != y and low * s <= 100 * score(v, w) <= high * s)
            out += [(i, j, r + 1, m, s, -t) for r, (t, m, _) in enumerate(fit[:negatives_])]
    return sorted(out)


KIND = "vec_id long, embedding array<float>, label int, score int, id string"


def mined(df, anchor, **more):
    return sorted(tuple(r) for r in negatives.mine(df, anchor, **more).collect())


def test_cover_tree_keeps_its_promises():
    rng = np.random.default_rng(5)
    for vectors in (rng.integers(-100, 100, (300, 5)), np.zeros((70, 3), np.int64), rng.integers(-2, 3, (200, 2)), np.ones((1, 4), np.int64)):
        tree = negatives.CoverTree(vectors)
        assert sorted(tree.source) == list(range(len(vectors)))
        points = vectors[tree.source].astype(float)
        square = (points ** 2).sum(1)
        points = np.c_[points, np.sqrt(square.max() - square)]
        for k in range(len(points)):
            inside = points[k:k + tree.size[k]]
            assert np.sqrt(((inside - points[k]) ** 2).sum(1)).max() <= tree.own[k] + 1e-6
            group, rest = tree.first[k], set(range(k + 1, k + tree.size[k]))
            while group >= 0:
                assert np.sqrt(((points[sorted(rest)] - points[k]) ** 2).sum(1)).max() <= tree.rest[group] + 1e-6
                for c in tree.kids[tree.begin[group]:tree.stop[group]]:
                    rest -= set(range(c, c + tree.size[c]))
                group = tree.following[group]
            assert not rest


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    rows = []
    for k in range(700):
        v = centres[k % 6] * 0.5 + rng.normal(size=8) * 0.4
        rows.append((k, [float(np.float32(x)) for x in v], 0 if k % 3 == 0 else k % 5, 1, "x"))
    rows += [(k, rows[10][1], 4, 1, "x") for k in range(700, 760)]               # ties
    rows += [(20, rows[20][1], 0, 1, "x"), (20, rows[21][1], 0, 1, "x")]         # repeated ids
    rows += [(800, None, 1, 1, "x"), (820, [float("nan")] * 8, 1, 1, "x"), (840, [None] * 8, 1, 1, "x"), (860, rows[3][1], None, 1, "x"),
             (880, [float("inf")] * 8, 1, 1, "x"), (None, rows[3][1], 1, 1, "x"), (900, [], 2, 1, "x"), (920, [1.0, 2.0], 9, 1, "x"),
             (940, [0.0] * 8, 3, 1, "x")]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    want = brute_negatives([r[:3] for r in rows], lambda i: i % 20 == 0)
    assert len(want) > 500
    assert mined(df, F.col("vec_id") % 20 == 0) == want
    monkeypatch.setattr(negatives, "BLOCK", 90)
    monkeypatch.setattr(negatives, "ANCHORS", 11)
    monkeypatch.setattr(negatives, "LEAF", 4)
    assert mined(df, F.col("vec_id") % 20 == 0) == want
    few = brute_negatives([r[:3] for r in rows], lambda i: i % 100 == 0, 2, 3, 10, 120)
    assert mined(df, F.col("vec_id") % 100 == 0, positives=2, negatives=3, low=10, high=120) == few


def test_negatives_of_edge_cases(spark):
    assert mined(spark.createDataFrame([], KIND), F.col("vec_id") % 2 == 0) == []
    alone = spark.createDataFrame([(100, [1.0], 1, 1, "")], KIND)
    assert mined(alone, F.col("vec_id") % 100 == 0) == []
    named = spark.createDataFrame([("a", [1.0, 0.0], "p"), ("b", [1.0, 0.0], "p"), ("c", [0.5, 9.0], "q"), ("d", [0.5, 1e-9], "r")],
                                  "vec_id string, embedding array<double>, label string")
    assert mined(named, F.col("vec_id") == "a") == [("a", "b", 1, "c", 65536, 32768), ("a", "b", 2, "d", 65536, 32768)]
    large = spark.createDataFrame([(1, [4e6, 3.0], 1), (2, [4e6, 1.0], 1), (3, [2e6, 5.0], 2)], "vec_id long, embedding array<double>, label int")
    a, b, c = ([math.floor(256 * x) for x in v] for v in ([4e6, 3.0], [4e6, 1.0], [2e6, 5.0]))
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert mined(large, F.col("vec_id") == 1) == [(1, 2, 1, 3, dot(a, b), dot(a, c))]


def test_search_skips_what_cannot_be_returned():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(30, 6)) * 2000
    vectors = np.floor(np.repeat(centres, 100, 0) + rng.normal(size=(3000, 6)) * 20).astype(np.int64)
    tree = negatives.CoverTree(vectors)
    laid = vectors[tree.source]
    search = negatives._Search(tree, laid, laid[:1], np.zeros(3000, np.int64), np.arange(3000))
    exact = (laid @ laid[0]).tolist()
    high = int(0.5 * max(exact))
    window = negatives._Best(0, high, 10)
    search.fill(0, 1, False, np.zeros(3000, bool), [window])
    assert [(-s, k) for s, k in window.rows] == sorted(((s, k) for k, s in enumerate(exact) if 0 <= s <= high), key=lambda x: (-x[0], x[1]))[:10]
    assert search.visited < 1500
