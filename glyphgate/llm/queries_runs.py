"""Query of the periodic runs."""

from pyspark.sql import Column, functions as F

from glyphgate.llm import runs
from glyphgate.llm.registry import query, table

MIN_LENGTH, MIN_EXPONENT = 24, 3


def repeated_words(text: Column, key: Column) -> Column:
    """The text as it is for nine of ten keys; for the tenth, its words from some place on repeat with some period."""
    found = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, g = F.size(found), F.floor(key / 10)

    def repeat(w):
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.element_at(
            w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int") + 1)), " ")

    # the inner transform names the words once
    repeated = F.transform(F.array(found), repeat)[0]
    return F.when((key % 10 == 0) & (n > 0), repeated).otherwise(text)


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", repeated_words(F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary"))).alias("text"))
    found = runs.find(texts, min_length=MIN_LENGTH, min_exponent=MIN_EXPONENT)
    highest = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", highest).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
