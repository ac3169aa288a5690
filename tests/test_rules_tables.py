"""Rules as a table, texts with tokens and pseudonyms, sketches, retention, repair, SQL table functions, lookup joins."""

import os
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from glyphgate import sql
from glyphgate.functions import regex
from glyphgate.operators import anonymize, evaluate, flows, joins, personal_data, rules, usage
from glyphgate.plans import inputs
from glyphgate.sources import retention, texts as sources

SF = "/root/testdata/sf0.001"
TEXT = "id long, text string"
YEAR = 2026


# --- rules -------------------------------------------------------------------------------

@pytest.mark.parametrize("pattern, literals", [
    (r"\bignore\s+previous\b", {"previous"}),
    (r"(?:drop|delete)\s+table", {"table"}),
    (r"(?:remove|delete)\d", {"remove", "delete"}),
    (r"abc?d+ef", None),
    (r"[a-z]+@[a-z]+", None),
    (r"(?:secret)?key\d", {"key"}),
    (r"(?:secret){2}", {"secret"}),
    (r"naïve plan", {"ve plan"}),
    (r"a|bcd", None),
])
def test_literals_that_rules_imply(pattern, literals):
    got = rules.compile_rule("r", "semantic", pattern).literals
    assert got == (frozenset(literals) if literals else None)


def test_literals_are_in_every_match():
    rnd = random.Random(2)
    for _ in range(300):
        parts = [rnd.choice(["abc", "(?:hello|help)", "x?", r"\d", "(?:foo)+", "(?:bar)*", "[qr]st", "end", "(?:one two|three)"]) for _ in range(4)]
        pattern = "".join(parts)
        if re.fullmatch(pattern, ""):
            continue
        literals = rules.compile_rule("r", "semantic", pattern).literals
        text = "".join({"abc": "abc", "(?:hello|help)": rnd.choice(["hello", "help"]), "x?": rnd.choice(["", "x"]), r"\d": "7",
                        "(?:foo)+": "foo" * rnd.randint(1, 3), "(?:bar)*": "bar" * rnd.randint(0, 2), "[qr]st": "qst", "end": "end",
                        "(?:one two|three)": rnd.choice(["one two", "three"])}[p] for p in parts)
        assert re.fullmatch(pattern, text) and (literals is None or any(w in text for w in literals)), (pattern, literals, text)


@pytest.mark.parametrize("rule", [
    dict(id="a", layer="other", pattern="abc"), dict(id="a", layer="semantic", pattern="("), dict(id="a", layer="semantic", pattern=r"\u{1F600}"),
    dict(id="a", layer="semantic", pattern="x*"), dict(id="a", layer="semantic", pattern="abc", validator="iban"),
    dict(id="a", layer="privacy", pattern="abc", validator="none such"),
])
def test_rules_that_cannot_run_are_refused(rule):
    with pytest.raises(ValueError):
        rules.compile_rules([rule])


def test_rule_ids_are_unique():
    with pytest.raises(ValueError):
        rules.compile_rules([dict(id="a", layer="semantic", pattern="abc")] * 2)


def test_gates_find_literals_that_overlap():
    given = rules.compile_rules([dict(id=w, layer="semantic", pattern=w) for w in ("ignore", "ignored", "red flag", "nor", "edfl", "flag")])
    finder, opens = rules.gates(given)
    for text in ("ignored flag", "an ignore", "xignored", "red flag", "nothing"):
        found = set(re.findall(finder, text))
        assert {r.id for r in given if found & set(opens[r.id])} == {r.id for r in given if r.id in text}


def test_custom_rules_scan(spark):
    table = spark.createDataFrame([
        ("late", "semantic", r"\bsay\s+hi\b", True, 5, None), ("first", "structural", "<sys>", False, 1, None),
        ("free", "semantic", r"\d{3}", False, 9, None), ("CARD", "privacy", r"\b\d(?:[ -]?\d){12,15}\b", False, 1, "credit_card"),
        ("LONG", "privacy", r"\b\d{4} \d{4}\b", False, 2, None)], rules.RULE_SCHEMA)
    df = spark.createDataFrame([
        (1, "Say  HI to <sys> 123"), (2, "<SYS> sayhi"), (3, None), (4, ""), (5, "card 4111 1111 1111 1111 and 1234 5678"),
        (6, "card 4111 1111 1111 1112"), (7, "x" * 200_000 + " say hi")], TEXT)
    got = {r.id: r for r in rules.scan_rules(df, "id", "text", rules.compile_rules(table.collect())).collect()}
    assert {i: r.signatures for i, r in got.items()} == {
        1: ["first", "late", "free"], 2: [], 3: None, 4: [], 5: ["free"], 6: ["free"], 7: ["late"]}
    assert got[3].entities is None and [e.type for e in got[5].entities] == ["CARD", "LONG"]
    assert [e.type for e in got[6].entities] == ["LONG", "LONG"]
    only = rules.scan_rules(df, "id", "text", rules.compile_rules([dict(id="p", layer="privacy", pattern=r"hi")])).collect()
    assert {r.id: len(r.entities or []) for r in only} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1}


def test_each_pattern_runs_only_behind_its_gate(spark):
    given = rules.compile_rules([dict(id=f"r{k}", layer="semantic", pattern=rf"word{k}\s+stop{k}") for k in range(40)])
    plan = rules.scan_rules(spark.range(1).select("id", F.col("id").cast("string").alias("text")), "id", "text", given)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("Join") == 0


# --- tokens and pseudonyms in texts ------------------------------------------------------

TEXTS = [(1, "mail a@b.co or c@d.co now"), (2, "a@b.co"), (3, "nothing here"), (4, None), (5, ""), (2, "call c@d.co 🙂 a@b.co end"),
         (6, "a@b.co " * 300)]


def by_hand(spark, shown):
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(TEXTS)], TEXT)
    found = personal_data.personal_data(df, "id", "text", personal_data.data_types(YEAR), offsets="codepoint", masked=False).collect()
    out = []
    for k, (i, text) in enumerate(TEXTS):
        mine = sorted((r for r in found if r.id == k), key=lambda r: -r.start)
        new = text
        for r in mine:
            new = new[:r.start] + shown(r) + new[r.end:]
        out.append((i, new if mine else None))
    return sorted(out, key=repr)


def test_texts_with_tokens(spark):
    import hashlib
    import hmac
    types = personal_data.data_types(YEAR)
    df = spark.createDataFrame(TEXTS, TEXT)
    want = by_hand(spark, lambda r: f"{r.type}_" + hmac.new(b"s", f"{r.type}:{r.value}".encode(), hashlib.sha256).hexdigest()[:12])
    out = anonymize.tokenize_texts(df, types=types, keyed=anonymize.secret_hashes(spark, "s"))
    assert sorted(((r.id, r.tokenized) for r in out.collect()), key=repr) == want
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = by_hand(spark, lambda r: f"{r.type}_" + hashlib.sha256(f"k:{r.type}:{r.value}".encode()).hexdigest()[:12])
    out = anonymize.tokenize_texts(df, types=types, keyed=anonymize.prefix_hashes("k"))
    assert sorted(((r.id, r.tokenized) for r in out.collect()), key=repr) == want
    with pytest.raises(ValueError):
        anonymize.tokenize_texts(df)


def test_texts_with_pseudonyms(spark, tmp_path):
    import hashlib
    types = personal_data.data_types(YEAR)
    values = sorted(["a@b.co", "c@d.co"], key=lambda v: hashlib.sha256(v.encode()).hexdigest())
    want = by_hand(spark, lambda r: f"{r.type}_{values.index(r.value) + 1}")
    df = spark.createDataFrame(TEXTS, TEXT)
    for k, folder in enumerate((None, f"{tmp_path}/spans")):
        out = anonymize.pseudonymize_texts(df, types=types, folder=folder)
        assert sorted(((r.id, r.pseudonymized) for r in out.collect()), key=repr) == want
    # texts meet the broadcast numbers where they are
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    text_side = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "text" in line]
    assert not text_side


def test_substituted_entities(spark):
    types = personal_data.data_types(YEAR)
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(TEXTS)], TEXT)
    found = personal_data.personal_data(df, "id", "text", types, offsets="codepoint").withColumn("shown", F.lit("<>"))
    got = {r.id: r.text for r in anonymize.substitute(df, "id", "text", found, "shown").collect()}
    assert got == {k: t and re.sub(r"\w@\w\.co", "<>", t) for k, (_, t) in enumerate(TEXTS)}


# --- sketches, retention, repair ---------------------------------------------------------

def test_sketches_merge_in_any_order(spark):
    df = spark.range(100_000).select((F.col("id") % 20).alias("day"), (F.col("id") % 2).alias("kind"),
                                     F.exp(F.col("id") / 10_000).alias("v")).unionByName(
        spark.createDataFrame([(0, 0, None), (0, 1, float("nan"))], "day long, kind long, v double"))
    stored = evaluate.sketches(df, "v", ["day", "kind"])
    exact = {r.kind: r for r in df.where("v IS NOT NULL AND NOT isnan(v)").groupBy("kind").agg(
        F.count("*").alias("n"), *[F.percentile("v", p / 100).alias(f"p{p}") for p in (50, 95, 99)]).collect()}
    for order in ("day", F.desc("day"), F.xxhash64("day")):
        rows = spark.createDataFrame(stored.orderBy(order).collect(), stored.schema).repartition(3)
        for r in evaluate.sketch_percentiles(rows, by=["kind"]).collect():
            assert r.n == exact[r.kind].n == 50_000
            for p in (50, 95, 99):     # a rank error of 0.5 % moves exp(x / 10000) by at most 500 places
                assert abs(r[f"p{p}"] / exact[r.kind][f"p{p}"] - 1) < 0.06
    assert evaluate.sketch_percentiles(stored.limit(0), by=["kind"]).collect() == []
    spread = evaluate.approx_percentiles(df.where("NOT isnan(v)"), "v", by=["kind"]).collect()
    assert all(abs(r.p50 / exact[r.kind].p50 - 1) < 0.01 for r in spread)


NOW = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)


def kept_days(path):
    return sorted(d for d in os.listdir(path) if d.startswith("dt="))


def test_retention_drops_days_unread_and_rows_of_the_boundary(spark, tmp_path, monkeypatch):
    rows = [(k, NOW - timedelta(hours=k * 7)) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, created_at timestamp").withColumn("dt", F.to_date("created_at"))
    path = f"{tmp_path}/audit"
    df.write.partitionBy("dt").parquet(path)
    later = {d: os.listdir(f"{path}/{d}") for d in kept_days(path) if d > "dt=2024-04-24"}
    old = [d[3:] for d in kept_days(path) if d < "dt=2024-04-24"]
    assert retention.drop_expired(spark, path, NOW, days=7) == old and old
    left = {r.id for r in spark.read.parquet(path).collect()}
    assert left == {k for k, t in rows if t >= NOW - timedelta(days=7)}
    assert kept_days(path)[0] == "dt=2024-04-24" and {d: os.listdir(f"{path}/{d}") for d in later} == later
    assert retention.drop_expired(spark, path, NOW, days=7) == []
    # stops after the stage is written: the next run finishes
    place = retention._place
    calls = []

    def stop(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        place(*args)
    monkeypatch.setattr(retention, "_place", stop)
    with pytest.raises(RuntimeError):
        retention.drop_expired(spark, path, NOW, days=3)
    monkeypatch.undo()
    retention.drop_expired(spark, path, NOW, days=3)
    assert {r.id for r in spark.read.parquet(path).collect()} == {k for k, t in rows if t >= NOW - timedelta(days=3)}
    assert not os.path.exists(f"{path}/_staged")


def test_retention_with_more_partitions(spark, tmp_path):
    rows = [(k, NOW - timedelta(hours=k), k % 2) for k in range(80)] + [(99, None, 0)]
    path = f"{tmp_path}/audit"
    (spark.createDataFrame(rows, "id int, created_at timestamp, batch int").withColumn("dt", F.to_date("created_at"))
     .write.partitionBy("dt", "batch").parquet(path))
    retention.drop_expired(spark, path, NOW, days=2, partitions=("dt", "batch"))
    assert {(r.id, r.batch) for r in spark.read.parquet(path).collect()} == {
        (k, b) for k, t, b in rows if t is None or t >= NOW - timedelta(days=2)}


def test_repair_keeps_the_same_row_however_rows_are_dealt(spark):
    rows = [(f"k{i % 40}" if i % 41 else None, i % 7, f"v{i % 13}", i) for i in range(400)]
    want = {}
    for k, at, v, i in rows:
        if k is not None:
            want[k] = min(want.get(k, (99,)), (at, v, i))
    for n in (1, 5, 9):
        random.Random(n).shuffle(rows)
        df = spark.createDataFrame(rows, "k string, at int, v string, i int").repartition(n)
        kept, report = joins.repair(df, ["k"], ["at"])
        got = kept.collect()
        assert {r.k: (r["at"], r.v, r.i) for r in got if r.k is not None} == want
        assert sum(r.k is None for r in got) == sum(r[0] is None for r in rows)
        assert sum(r.dropped for r in report.collect()) == 400 - len(got)


def test_leads_with_a_unique_email(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame([(3, at, " A@b.co ", None), (2, at, "a@B.co", "x"), (4, at - timedelta(1), "c@d.co", "y"), (5, at, None, "z"), (6, at, "held@b.co", "z")],
                               "signup_id int, ts timestamp, email string, source string")
    held = spark.createDataFrame([("held@b.co",)], "email string")
    got = {r.email: (r.signup_id, r.source) for r in usage.unique_leads(df, held).collect()}
    assert got == {"a@b.co": (2, "x"), "c@d.co": (4, "y")}
    assert len(usage.unique_leads(df).collect()) == 3


# --- joins, sources, SQL -----------------------------------------------------------------

def test_lookup_join_is_the_same_on_both_sides_of_its_limit(spark):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None))
                                     .otherwise(F.col("id") % 400).cast("int").alias("k"), F.col("id").alias("row"))
    dim = spark.range(300).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("d"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        small, large = (joins.lookup_join(facts, dim, "k", how, max_broadcast=m, hot_keys=4) for m in (1 << 30, 0))
        assert "__salt" in large._jdf.queryExecution().analyzed().toString()
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_lines_of_plain_text(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.txt").write_text("same\nother\nsame\n")
    shared = sources.read_texts(spark, str(tmp_path), None, "text", "text").collect()
    assert len(shared) == 6 and len({r.id for r in shared}) == 2
    placed = [sources.read_texts(spark, str(tmp_path), None, "text", "text", by_place=True).collect() for _ in range(2)]
    assert len({r.id for r in placed[0]}) == 6 and sorted(placed[0]) == sorted(placed[1])
    with pytest.raises(ValueError):
        sources.read_texts(spark, str(tmp_path), None, "text", "text", stream=True, by_place=True)


def test_key_tables_are_pruned(spark, tmp_path):
    for name, columns in sources.DIMENSIONS.items():
        spark.range(3).select(*[F.col("id").alias(c) for c in columns], F.lit("x").alias("extra")).write.parquet(f"{tmp_path}/{name}")
        dim = sources.read_dim(spark, str(tmp_path), name)
        assert dim.columns == list(columns) and dim.count() == 3
        assert "extra" not in dim._jdf.queryExecution().executedPlan().toString()


def test_a_header_names_the_data(spark):
    row = evaluate.with_header(spark.createDataFrame([(5,)], "samples int"), "synthetic", "2.1").first()
    assert (row.marketing_grade, row.engine_version, row.signature_count, row.samples) == (False, "2.1", 22, 5)


def test_table_functions(spark):
    sql.register_functions(spark, YEAR)
    spark.createDataFrame([(1, "🙂 mail a@b.co, DAN do anything now"), (2, None), (3, "plain")], TEXT).createOrReplaceTempView("told")
    rows = spark.sql("SELECT id, r.* FROM told t, LATERAL pii_rows(t.text) AS r").collect()
    assert [(r.id, r.ordinal, r.type, r.start, r.end) for r in rows] == [(1, 1, "EMAIL", 8, 14)]
    names = spark.sql("SELECT id, r.signature FROM told t, LATERAL sig_rows(t.text) AS r").collect()
    assert {(r.id, r.signature) for r in names} == {(1, "JAILBREAK_DAN")}


def test_demo_view(spark):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(k, start + timedelta(seconds=k), "ip", "hello") for k in range(25)]
    rows += [(30, start, "b", ""), (31, start, "b", "é" * 2049), (32, start, "b", "mail a@b.co"), (33, start, None, "hi"), (34, start, "b", None)]
    df = spark.createDataFrame(rows, "request_id int, ts timestamp, client_ip string, input string")
    got = {r.request_id: r for r in flows.demo_view(df, as_of_year=YEAR).collect()}
    assert [got[k].http_status for k in range(25)] == [200] * 20 + [429] * 5
    assert got[20].retry_after_s == 40 and got[20].verdict is None and got[19].remaining == 0
    assert [got[k].outcome for k in (30, 31, 32, 33, 34)] == ["INVALID_INPUT", "INPUT_TOO_LARGE", "OK", "OK", "INVALID_INPUT"]
    assert got[32].verdict == "ANONYMIZED" and got[32].primary_category == "Email Address" and got[30].categories_matched is None


def test_rules_run_only_where_all_their_literals_start_words(spark):
    patterns = [r"\bare\W+now\b", r"\bthe[ :]+[a-z0-9]+", r"\b(?:you|they)\W+are", r"own\b", r"\bx?and\W+card", r"card_\b", r"\bnot\b|\bnor\b", r"\W+\bthis is"]
    given = rules.compile_rules([dict(id=f"{k}{fold}", layer="semantic", pattern=p, ignore_case=fold) for k, p in enumerate(patterns) for fold in (False, True)])
    by_id = {r.id: r for r in given}
    assert by_id["0True"].needs == (frozenset({"\bare"}), frozenset({"\bnow"})) and by_id["1True"].literals == {"\bthe ", "\bthe:"}
    assert regex.BOUNDARY not in by_id["1True"].pattern
    words = ["are", "Now", "the:", "THE", "The 5", "you", "are", "they", "own", "owner", "xand", "and", "card", "card_", "nor", "this", "is", "Kare", "é", "éare", "_the 1", "\U0001f600now"]
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", "-", "", "\n"]) for _ in range(8)) for _ in range(400)]
    got = rules.scan_rules(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", given).collect()
    for r in got:
        want = {i for i in by_id if re.search(patterns[int(i[0])], texts[r.id], re.A | (re.I if i[1:] == "True" else 0))}
        assert set(r.signatures) == want, texts[r.id]
