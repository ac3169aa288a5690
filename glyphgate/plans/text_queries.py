"""Queries over text tables: sources, signatures, personal data, reports, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphgate.functions import columns, fixed
from glyphgate.operators import anonymize, evaluate, guard, integrity, personal_data, report
from glyphgate.plans import inputs, oracle
from glyphgate.plans.inputs import AS_OF_YEAR, derived, table
from glyphgate.plans.registry import query
from glyphgate.plans.scan import scan, scan_dedup, scan_hybrid
from glyphgate.sources import sinks, texts as sources

SECRET = "fixture-secret"


def types():
    return personal_data.data_types(AS_OF_YEAR)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "texts")


def _scan(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return scan(texts(spark, sf_dir), "doc_id", as_of_year=AS_OF_YEAR, **options)


REP = oracle.report_ctes(AS_OF_YEAR)
ENTS = oracle.entity_ctes(AS_OF_YEAR)
HITS = oracle.hits_cte()


# --- sources -------------------------------------------------------------------------

@query("src_texts", "SELECT doc_id AS id, length(text) AS chars FROM documents")
def src_texts(spark, sf_dir):
    docs = sources.read_texts(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    return docs.select(F.col("doc_id").alias("id"), F.length("text").cast("bigint").alias("chars"))


_LABELLED = ("SELECT doc_id AS id, text, toxic AS label, CASE WHEN quality = 1 THEN 'train' ELSE 'test' END AS split"
             " FROM labels JOIN texts USING (doc_id)")


def labelled(spark, sf_dir) -> DataFrame:
    """Planted documents with a label and a split from the label table."""
    marks = table(spark, sf_dir, "labels")
    return texts(spark, sf_dir).join(marks, "doc_id").select(
        F.col("doc_id").alias("id"), "text", F.col("toxic").alias("label"),
        F.expr("CASE WHEN quality = 1 THEN 'train' ELSE 'test' END").alias("split"))


@query("src_labelled", f"SELECT split, label::BIGINT AS label, count(*) AS n, sum(length(text))::BIGINT AS chars"
                       f" FROM ({_LABELLED}) WHERE text IS NOT NULL AND label IN (0, 1) GROUP BY ALL")
def src_labelled(spark, sf_dir):
    rows = sources.read_labelled(labelled(spark, sf_dir), split="split")
    return rows.groupBy("split", F.col("label").cast("bigint").alias("label")).agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("src_cap", f"SELECT id, split FROM ({_LABELLED}) ORDER BY CASE split WHEN 'train' THEN 0 ELSE 1 END, id LIMIT 1000")
def src_cap(spark, sf_dir):
    return sources.cap_rows(labelled(spark, sf_dir).select("id", "split"))


def _pool(pool) -> str:
    return "CASE doc_id % {n} {cases} END".format(
        n=len(pool), cases=" ".join(f"WHEN {i} THEN {oracle.lit(t)}" for i, t in enumerate(pool)))


_SYNTH = ("SELECT doc_id AS id, toxic AS label, CASE WHEN toxic = 1"
          f" THEN CASE WHEN doc_id % 5 = 0 THEN {_pool(fixed.KEYWORD_FREE_ATTACKS)}"
          f" ELSE {_pool(fixed.KNOWN_ATTACKS)} END || ' (case ' || doc_id || ')'"
          f" ELSE {_pool(fixed.BENIGN_PROMPTS)} || ' (note ' || doc_id || ')' END AS text FROM labels")


def templates(spark, sf_dir) -> DataFrame:
    """A template text for every labelled document: toxic ones become attacks."""
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return evaluate.labelled_templates(ids, "id", "label")


@query("src_synth", f"SELECT id, label::BIGINT AS label, text FROM ({_SYNTH})")
def src_synth(spark, sf_dir):
    return templates(spark, sf_dir).select("id", F.col("label").cast("bigint").alias("label"), "text")


# --- signatures ------------------------------------------------------------------------

def _one_signature(sig: integrity.Signature):
    test = oracle.signature_tests()[sig.id]

    @query(f"sig_{sig.id.lower()}", f"SELECT doc_id FROM texts WHERE {test}")
    def run(spark, sf_dir):
        flagged = integrity.signature_flags(texts(spark, sf_dir).select("doc_id", "text"), "text", [sig])
        return flagged.where(f"sig_{sig.id}").select("doc_id")
    return run


for _sig in integrity.SIGNATURES:
    _one_signature(_sig)


@query("sig_all", f"WITH {HITS} SELECT doc_id, joined AS signatures FROM hits")
def sig_all(spark, sf_dir):
    hit = integrity.signatures(texts(spark, sf_dir).select("doc_id", "text"))
    return hit.select("doc_id", F.array_join("signatures", ",").alias("signatures"))


@query("sig_hits", f"WITH {HITS} SELECT doc_id, unnest(sigs) AS signature,"
                   " generate_subscripts(sigs, 1)::BIGINT AS ordinal FROM hits WHERE n > 0")
def sig_hits(spark, sf_dir):
    return integrity.signature_hits(texts(spark, sf_dir), "doc_id").withColumn("ordinal", F.col("ordinal").cast("bigint"))


_CATALOG = ", ".join(
    f"({i}, '{s.id}', '{s.layer}', {oracle.lit(s.language) if s.language else 'NULL'})"
    for i, s in enumerate(integrity.SIGNATURES, 1))


@query("sig_catalog",
       f"WITH {HITS}, found AS (SELECT unnest(sigs) AS signature FROM hits)"
       f" SELECT ordinal::BIGINT AS ordinal, c.signature, layer, lang, count(f.signature) AS texts"
       f" FROM (VALUES {_CATALOG}) AS c(ordinal, signature, layer, lang)"
       " LEFT JOIN found f ON f.signature = c.signature GROUP BY ALL")
def sig_catalog(spark, sf_dir):
    """The signature catalogue with the number of texts each signature hits."""
    counts = (integrity.signature_hits(texts(spark, sf_dir), "doc_id")
              .groupBy("signature").agg(F.count("*").alias("texts")))
    joined = integrity.signature_catalog(spark).join(counts, "signature", "left")
    return joined.select(F.col("ordinal").cast("bigint").alias("ordinal"), "signature", "layer", "lang",
                         F.coalesce("texts", F.lit(0)).cast("bigint").alias("texts"))


@query("sig_stats",
       f"WITH {HITS}, one AS (SELECT doc_id, unnest(sigs) AS s, generate_subscripts(sigs, 1) AS k FROM hits)"
       " SELECT s AS signature, NULL::VARCHAR AS with_signature, count(*) AS n FROM one GROUP BY s"
       " UNION ALL SELECT a.s, b.s, count(*) FROM one a JOIN one b ON a.doc_id = b.doc_id AND a.k < b.k GROUP BY ALL")
def sig_stats(spark, sf_dir):
    return integrity.signature_stats(texts(spark, sf_dir))


# --- personal data ---------------------------------------------------------------------

_ALL_CANDIDATES = " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(1, len(fixed.PERSONAL_DATA) + 1))


@query("pii_candidates",
       f"WITH {', '.join(oracle.candidate_ctes(AS_OF_YEAR, checked=False))}"
       f" SELECT doc_id, type, v AS value, s AS start, e AS \"end\" FROM ({_ALL_CANDIDATES})")
def pii_candidates(spark, sf_dir):
    found = personal_data.candidates(texts(spark, sf_dir).select("doc_id", "text"), "text", types())
    return found.select("doc_id", F.explode("candidates").alias("c")).select(
        "doc_id", "c.type", "c.value", F.col("c.start").cast("bigint").alias("start"),
        F.col("c.end").cast("bigint").alias("end"))


_ENTITY_ROWS = (f"doc_id, type, {oracle.MASK} AS value, s AS start, e AS \"end\"")


@query("pii_entities", f"WITH {ENTS} SELECT {_ENTITY_ROWS},"
                       " row_number() OVER (PARTITION BY doc_id ORDER BY s) AS ordinal FROM ents")
def pii_entities(spark, sf_dir):
    rows = personal_data.personal_data(texts(spark, sf_dir), "doc_id", types=types())
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("ordinal", "start", "end")})


def _one_type(type_: str):
    @query(f"pii_{type_.lower()}", f"WITH {ENTS} SELECT {_ENTITY_ROWS} FROM ents WHERE type = '{type_}'")
    def run(spark, sf_dir):
        rows = personal_data.personal_data(texts(spark, sf_dir), "doc_id", types=types())
        return rows.where(F.col("type") == type_).select(
            "doc_id", "type", "value", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    return run


for _type in dict.fromkeys(t for t, _, _ in fixed.PERSONAL_DATA):
    _one_type(_type)


@query("pii_pages", f"WITH {oracle.entity_ctes(AS_OF_YEAR, 'page_texts', 'page_id')}"
                    f" SELECT page_id, type, {oracle.MASK} AS value, s AS start, e AS \"end\" FROM ents")
def pii_pages(spark, sf_dir):
    rows = personal_data.personal_data(derived(spark, sf_dir, "page_texts"), "page_id", types=types())
    return rows.select("page_id", "type", "value", F.col("start").cast("bigint").alias("start"),
                       F.col("end").cast("bigint").alias("end"))


@query("pii_redact", f"WITH {ENTS}, {oracle.redacted_cte()} SELECT doc_id, redacted FROM clean")
def pii_redact(spark, sf_dir):
    return (personal_data.redact(texts(spark, sf_dir), types=types())
            .where("redacted IS NOT NULL").select("doc_id", "redacted"))


@query("pii_mask_mode", f"WITH {ENTS}, {oracle.redacted_cte(shown=oracle.MASK)} SELECT doc_id, redacted FROM clean")
def pii_mask_mode(spark, sf_dir):
    return (personal_data.redact(texts(spark, sf_dir), types=types(), mode="mask")
            .where("redacted IS NOT NULL").select("doc_id", "redacted"))


@query("prj_mask", f"SELECT doc_id, {oracle.MASK} AS masked FROM (SELECT doc_id, text AS v FROM texts)")
def prj_mask(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", columns.mask(F.col("text")).alias("masked"))


@query("pii_profile", f"WITH {ENTS} SELECT lang, type, count(*) AS entities, count(DISTINCT doc_id) AS texts"
                      " FROM ents JOIN texts USING (doc_id) GROUP BY ALL")
def pii_profile(spark, sf_dir):
    return personal_data.profile(texts(spark, sf_dir), "doc_id", "text", ["lang"], types())


@query("join_overlap",
       f"WITH {', '.join(oracle.candidate_ctes(AS_OF_YEAR))}, every AS MATERIALIZED ({_ALL_CANDIDATES}),"
       " cells AS MATERIALIZED (SELECT *, unnest(range(s // 64, (e - 1) // 64 + 1)) AS cell FROM every)"
       " SELECT a.doc_id, a.type AS l_type, a.s AS l_start, a.e AS l_end, b.type AS r_type, b.s AS r_start, b.e AS r_end"
       " FROM cells a JOIN cells b ON a.doc_id = b.doc_id AND a.cell = b.cell AND a.p < b.p AND a.s < b.e AND b.s < a.e"
       " AND a.cell = greatest(a.s, b.s) // 64")
def join_overlap(spark, sf_dir):
    rows = personal_data.overlaps(texts(spark, sf_dir), "doc_id", types=types())
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("l_start", "l_end", "r_start", "r_end")})


_KEYED = "'k:' || type || ':' || v"
_KEYED_VALUE = "type || ':' || v"
_TOKEN_SQL = f"type || '_' || left({oracle.hmac(SECRET, _KEYED_VALUE)}, 12)"
_PSEUDO_SQL = "type || '_' || k"


@query("pii_tokenize",
       f"WITH {ENTS} SELECT DISTINCT type || '_' || left(sha256({_KEYED}), 12) AS token, {oracle.MASK} AS masked FROM ents")
def pii_tokenize(spark, sf_dir):
    """Token table under a key that is part of the fixture (a plain prefix hash, so that SQL can repeat it)."""
    return anonymize.token_table(texts(spark, sf_dir), "doc_id", "text", types(), keyed=anonymize.prefix_hash("k"))


@query("pii_tokenize_keyed",
       f"WITH {ENTS} SELECT DISTINCT type || '_' || left({oracle.hmac(SECRET, _KEYED_VALUE)}, 12) AS token, {oracle.MASK} AS masked FROM ents")
def pii_tokenize_keyed(spark, sf_dir):
    return anonymize.token_table(texts(spark, sf_dir), "doc_id", "text", types(), keyed=anonymize.secret_hash(spark, SECRET))


@query("pii_pseudo",
       f"WITH {ENTS}, numbered AS (SELECT *, dense_rank() OVER (PARTITION BY type ORDER BY sha256(v)) AS k FROM ents)"
       " SELECT doc_id, s AS start, e AS \"end\", type || '_' || k AS pseudonym FROM numbered")
def pii_pseudo(spark, sf_dir):
    rows = anonymize.pseudonyms(texts(spark, sf_dir), "doc_id", "text", types(), sinks.work_dir(spark))
    return rows.select("doc_id", F.col("start").cast("bigint").alias("start"),
                       F.col("end").cast("bigint").alias("end"), "pseudonym")


@query("pii_tokenize_text", f"WITH {ENTS}, {oracle.redacted_cte(shown=_TOKEN_SQL)} SELECT doc_id, redacted AS tokenized FROM clean")
def pii_tokenize_text(spark, sf_dir):
    """Texts with a keyed token in place of each value."""
    out = anonymize.tokenize_texts(texts(spark, sf_dir), types=types(), keyed=anonymize.secret_hashes(spark, SECRET))
    return out.where("tokenized IS NOT NULL").select("doc_id", "tokenized")


@query("pii_pseudo_text",
       f"WITH {ENTS}, numbered AS (SELECT *, dense_rank() OVER (PARTITION BY type ORDER BY sha256(v)) AS k FROM ents),"
       f" {oracle.redacted_cte(shown=_PSEUDO_SQL).replace('FROM ents', 'FROM numbered')} SELECT doc_id, redacted AS pseudonymized FROM clean")
def pii_pseudo_text(spark, sf_dir):
    """Texts with a pseudonym, numbered over all texts, in place of each value."""
    out = anonymize.pseudonymize_texts(texts(spark, sf_dir), types=types(), folder=sinks.work_dir(spark))
    return out.where("pseudonymized IS NOT NULL").select("doc_id", "pseudonymized")


# --- scan and report -------------------------------------------------------------------

@query("scan_verdict", f"WITH {REP} SELECT verdict, count(*) AS texts FROM rep GROUP BY verdict")
def scan_verdict(spark, sf_dir):
    return _scan(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("texts"))


@query("scan_confidence", f"WITH {HITS} SELECT doc_id, {oracle.CONFIDENCE} AS confidence FROM hits WHERE n > 0")
def scan_confidence(spark, sf_dir):
    scanned = _scan(spark, sf_dir, modules=["integrity"])
    return scanned.where("confidence IS NOT NULL").select("doc_id", "confidence")


@query("rep_sha", f"WITH {REP} SELECT doc_id, sha256 FROM rep")
def rep_sha(spark, sf_dir):
    return _scan(spark, sf_dir).select("doc_id", "sha256")


_FULL = ("doc_id, verdict, joined AS signatures, k AS entities, confidence, sha256, redacted AS anonymized_input")


def _full(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return df.select(
        id_col, "verdict", F.array_join("signatures", ",").alias("signatures"),
        F.size("entities").cast("bigint").alias("entities"), "confidence", "sha256", "anonymized_input")


@query("scan_full", f"WITH {REP}, {oracle.redacted_cte()} SELECT {_FULL} FROM rep LEFT JOIN clean USING (doc_id)")
def scan_full(spark, sf_dir):
    return _full(_scan(spark, sf_dir))


@query("scan_dedup", f"WITH {REP}, {oracle.redacted_cte()} SELECT {_FULL} FROM rep LEFT JOIN clean USING (doc_id)")
def run_dedup(spark, sf_dir):
    return _full(scan_dedup(texts(spark, sf_dir), "doc_id", as_of_year=AS_OF_YEAR))


@query("scan_pages", f"WITH {oracle.report_ctes(AS_OF_YEAR, 'page_texts', 'page_id')},"
                     f" {oracle.redacted_cte('page_texts', 'page_id')}"
                     f" SELECT {_FULL.replace('doc_id', 'page_id')} FROM rep LEFT JOIN clean USING (page_id)")
def scan_pages(spark, sf_dir):
    return _full(scan(derived(spark, sf_dir, "page_texts"), "page_id", as_of_year=AS_OF_YEAR), "page_id")


@query("scan_hybrid",
       f"WITH {REP}, {oracle.redacted_cte()} SELECT doc_id, verdict, joined AS signatures,"
       " CASE WHEN n > 0 THEN 0 ELSE k END AS entities, confidence,"
       " CASE WHEN n = 0 THEN redacted END AS anonymized_input FROM rep LEFT JOIN clean USING (doc_id)")
def run_hybrid(spark, sf_dir):
    return _full(scan_hybrid(texts(spark, sf_dir), "doc_id", as_of_year=AS_OF_YEAR)).drop("sha256")


_MODULES = ("CASE doc_id % 5 WHEN 0 THEN 'integrity' WHEN 1 THEN 'privacy' WHEN 2 THEN ''"
            " WHEN 3 THEN 'unknown' ELSE 'privacy,integrity' END")


@query("flt_modules",
       f"WITH {REP}, asked AS (SELECT rep.*, {_MODULES} AS m FROM rep),"
       " kept AS (SELECT doc_id, m IN ('', 'integrity', 'privacy,integrity') AS i,"
       " m IN ('', 'privacy', 'privacy,integrity') AS p, n, k FROM asked)"
       " SELECT doc_id, CASE WHEN i AND n > 0 THEN 'BLOCKED' WHEN p AND k > 0 THEN 'ANONYMIZED' ELSE 'CLEARED' END AS verdict,"
       " CASE WHEN i THEN n ELSE 0 END AS signatures, CASE WHEN p THEN k ELSE 0 END AS entities FROM kept")
def flt_modules(spark, sf_dir):
    asked = F.expr(f"CASE WHEN {_MODULES} = '' THEN array() ELSE split({_MODULES}, ',') END")
    done = _scan(spark, sf_dir, modules=asked)
    return done.select("doc_id", "verdict", F.size("signatures").cast("bigint").alias("signatures"),
                       F.size("entities").cast("bigint").alias("entities"))


def signed(spark, sf_dir) -> DataFrame:
    scanned = _scan(spark, sf_dir, keep_text=True)
    moment = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id"))
    return report.sign(report.with_ids(scanned, "doc_id", "text", moment), SECRET)


@query("rep_ids",
       f"WITH {REP} SELECT doc_id, 'zp_' || upper(left(sha256(doc_id || '|' || text), 16)) AS report_id,"
       " strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp_utc, verdict"
       " FROM rep JOIN texts USING (doc_id)")
def rep_ids(spark, sf_dir):
    scanned = _scan(spark, sf_dir, keep_text=True)
    moment = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id"))
    return report.with_ids(scanned, "doc_id", "text", moment).select("doc_id", "report_id", "timestamp_utc", "verdict")


_SIGNED = (
    f"WITH {REP}, named AS (SELECT doc_id, verdict, sha256,"
    " 'zp_' || upper(left(sha256(doc_id || '|' || text), 16)) AS report_id,"
    " strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp_utc"
    " FROM rep JOIN texts USING (doc_id)), signed AS (SELECT *,"
    f" {oracle.hmac(SECRET, "report_id || '.' || sha256 || '.' || timestamp_utc")} AS report_hash FROM named)")


@query("rep_hmac", f"{_SIGNED} SELECT doc_id, report_id, sha256, timestamp_utc, report_hash FROM signed")
def rep_hmac(spark, sf_dir):
    return signed(spark, sf_dir).select("doc_id", "report_id", "sha256", "timestamp_utc", "report_hash")


@query("rep_verify", f"{_SIGNED} SELECT verdict, verdict <> 'ANONYMIZED' OR sha256 = reverse(sha256) AS valid,"
                     " count(*) AS reports FROM signed GROUP BY ALL")
def rep_verify(spark, sf_dir):
    """Stored reports, some altered after signing: how many still verify."""
    stored = signed(spark, sf_dir).withColumn(
        "sha256", F.when(F.col("verdict") == "ANONYMIZED", F.reverse("sha256")).otherwise(F.col("sha256")))
    return report.verify(stored, SECRET).groupBy("verdict", "valid").agg(F.count("*").alias("reports"))


_LABEL_SQL = ("CASE " + " ".join(
    f"WHEN s IN ({', '.join(oracle.lit(x) for x in [k] + [k + '_' + l for l in fixed.LANGUAGE_SUFFIXES])}) THEN {oracle.lit(v)}"
    for k, v in fixed.SIGNATURE_LABELS.items()) + f" ELSE {oracle.lit(fixed.UNKNOWN_SIGNATURE_LABEL)} END")
_DATA_LABEL_SQL = ("CASE type " + " ".join(
    f"WHEN '{k}' THEN {oracle.lit(v)}" for k, v in fixed.PERSONAL_DATA_LABELS.items()) + " END")


@query("prj_public",
       f"WITH {REP}, lab AS (SELECT doc_id, string_agg({_DATA_LABEL_SQL}, '|' ORDER BY s) AS pii,"
       f" arg_min({_DATA_LABEL_SQL}, s) AS first FROM ents GROUP BY doc_id),"
       f" cats AS (SELECT *, list_transform(sigs, lambda s: {_LABEL_SQL}) AS c FROM rep)"
       " SELECT doc_id, verdict, coalesce(c[1], first, 'No threat detected') AS primary_category,"
       " array_to_string(c, '|') AS categories_matched, coalesce(pii, '') AS pii_categories FROM cats LEFT JOIN lab USING (doc_id)")
def prj_public(spark, sf_dir):
    seen = report.public_view(_scan(spark, sf_dir), "doc_id")
    return seen.select("doc_id", "verdict", "primary_category", F.array_join("categories_matched", "|").alias("categories_matched"),
                       F.array_join(F.transform("pii_entities", lambda e: e["category"]), "|").alias("pii_categories"))


@query("prj_compliance", f"WITH {REP} SELECT doc_id, true AS audit_record, true AS ccpa, true AS eu_ai_act_s52,"
                         " k > 0 AS personal_data FROM rep")
def prj_compliance(spark, sf_dir):
    return _scan(spark, sf_dir).select("doc_id", report.compliance(F.col("entities")).alias("c")).select("doc_id", "c.*")


@query("prj_entity_public", f"WITH {ENTS} SELECT doc_id, type, 'REDACTED' AS action, s AS position_start,"
                            " e AS position_end FROM ents")
def prj_entity_public(spark, sf_dir):
    records = _scan(spark, sf_dir, modules=["privacy"]).select("doc_id", F.inline(report.entity_records(F.col("entities"))))
    return records.select("doc_id", "type", "action", F.col("position")[0].cast("bigint").alias("position_start"),
                          F.col("position")[1].cast("bigint").alias("position_end"))


# --- guards ----------------------------------------------------------------------------

@query("flt_guard", f"WITH {REP}, {oracle.redacted_cte()} SELECT doc_id, verdict, coalesce(redacted, text) AS text"
                    " FROM rep JOIN texts USING (doc_id) LEFT JOIN clean USING (doc_id) WHERE verdict <> 'BLOCKED'")
def flt_guard(spark, sf_dir):
    return guard.guard(texts(spark, sf_dir), "doc_id", as_of_year=AS_OF_YEAR)


@query("flt_guard_ctx",
       f"WITH {oracle.report_ctes(AS_OF_YEAR, 'turns', 'turn_id')}, {oracle.redacted_cte('turns', 'turn_id')}"
       " SELECT turn_id, t.conv_id, verdict, coalesce(redacted, text) AS text FROM rep JOIN turns t USING (turn_id)"
       " LEFT JOIN clean USING (turn_id) WHERE verdict <> 'BLOCKED' AND t.turn > 0 AND NOT EXISTS"
       " (SELECT 1 FROM rep r JOIN turns q USING (turn_id) WHERE q.conv_id = t.conv_id AND q.turn = 0 AND r.n > 0)")
def flt_guard_ctx(spark, sf_dir):
    """Conversations: the opening turn is the question, the later turns are its context."""
    turns = derived(spark, sf_dir, "turns")
    opening, later = turns.where("turn = 0"), turns.where("turn > 0")
    return guard.guard_context(opening, later, "conv_id", "turn_id", as_of_year=AS_OF_YEAR)


_BROKEN = "CASE WHEN lang = 'fr' THEN NULL ELSE text END"


@query("flt_failclosed",
       f"WITH {REP}, all_rows AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'BLOCKED' ELSE verdict END AS verdict"
       " FROM rep JOIN texts USING (doc_id)) SELECT verdict, count(*) AS texts FROM all_rows GROUP BY verdict")
def flt_failclosed(spark, sf_dir):
    """Texts that could not be read count as blocked."""
    broken = texts(spark, sf_dir).withColumn("text", F.expr(_BROKEN))
    scanned = scan(broken, "doc_id", as_of_year=AS_OF_YEAR)
    return scanned.groupBy(guard.fail_closed(F.col("verdict")).alias("verdict")).agg(F.count("*").alias("texts"))


@query("flt_valid", "SELECT doc_id FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' || chr(9) || chr(160)"
                    " WHEN 2 THEN chr(8195) || 'x' ELSE text END AS input FROM texts) WHERE doc_id % 4 IN (2, 3)")
def flt_valid(spark, sf_dir):
    blank = F.expr("CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('  ', chr(9), chr(160))"
                   " WHEN 2 THEN ' x' ELSE text END")
    inputs_ = texts(spark, sf_dir).withColumn("input", blank)
    return inputs_.where(columns.is_valid_input(F.col("input"))).select("doc_id")


# --- evaluation ------------------------------------------------------------------------

_EVAL = f"WITH synth AS ({_SYNTH}), {oracle.hits_cte('synth', 'id')}"
_COUNTS = ("count(*) FILTER (n > 0 AND label = 1) AS tp, count(*) FILTER (n > 0 AND label = 0) AS fp,"
           " count(*) FILTER (n = 0 AND label = 0) AS tn, count(*) FILTER (n = 0 AND label = 1) AS fn")


def judged(spark, sf_dir) -> DataFrame:
    """Template texts with label and verdict."""
    return scan(templates(spark, sf_dir), "id", modules=["integrity"], keep=["label"])


@query("join_labels",
       f"WITH {HITS} SELECT doc_id, CASE WHEN n > 0 THEN 'BLOCKED' ELSE 'CLEARED' END AS verdict, toxic::BIGINT AS label"
       " FROM hits JOIN labels USING (doc_id)")
def join_labels(spark, sf_dir):
    verdicts = _scan(spark, sf_dir, modules=["integrity"]).select("doc_id", "verdict")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("bigint").alias("label"))
    return evaluate.join_labels(verdicts, labels, "doc_id")


@query("agg_confusion", f"{_EVAL} SELECT {_COUNTS} FROM hits JOIN synth USING (id)")
def agg_confusion(spark, sf_dir):
    return evaluate.confusion(judged(spark, sf_dir))


_RATES = ("round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision,"
          " round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall,"
          " round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1,"
          " round((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy")


@query("agg_metrics", f"{_EVAL}, counts AS (SELECT {_COUNTS} FROM hits JOIN synth USING (id))"
                      f" SELECT tp, fp, tn, fn, tp + fp + tn + fn AS samples, tp + fn AS positives, fp + tn AS negatives,"
                      f" {_RATES} FROM counts")
def agg_metrics(spark, sf_dir):
    return evaluate.metrics(evaluate.confusion(judged(spark, sf_dir)))


@query("agg_confusion_by", f"WITH {HITS}, joined_ AS (SELECT lang, n, toxic AS label FROM hits JOIN texts USING (doc_id)"
                           f" JOIN labels USING (doc_id)) SELECT lang, {_COUNTS} FROM joined_ GROUP BY lang")
def agg_confusion_by(spark, sf_dir):
    verdicts = _scan(spark, sf_dir, modules=["integrity"], keep=["lang"]).select("doc_id", "lang", "verdict")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return evaluate.confusion(evaluate.join_labels(verdicts, labels, "doc_id"), by=["lang"])
