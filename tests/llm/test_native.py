"""Exact deduplication, decontamination and secret scans against plain versions."""

import math
import random
import time

import brute
import pytest
from pyspark.sql import functions as F

from tidewell.llm import decontam, exact_dedup, secrets
from tidewell.llm.queries import oracle_sql, queries


def rows_of(spark, sf, name="documents", key="doc_id"):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, "text").collect()]


def dedup(df, **options):
    out = exact_dedup.exact_dedup(df, **options).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_digest")).alias("h")).collect()
    return sorted(((r[0], r[1], r[2], r[4]) for r in out), key=str), sum(r[3] for r in out)


@pytest.mark.parametrize("salts", [1, 7])
def test_exact_odd(odd, odd_rows, salts):
    want, kept = brute.exact(odd_rows)
    assert dedup(odd, salts=salts) == (sorted(want, key=str), kept)


def test_exact_compares_content_when_digests_clash(odd, odd_rows):
    want, kept = brute.exact(odd_rows)
    got, n = dedup(odd, digest=lambda c: F.unhex(F.lit("00")))
    assert sorted((w[:3] for w in want), key=str) == sorted((g[:3] for g in got), key=str) and n == kept


def test_exact_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = exact_dedup.exact_dedup(df, salts=8)
    assert out.filter("kept").count() == 2001 and out.filter("keep_id = 0 and group_size = 1000").count() == 1000


def test_exact_empty(none):
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_survivors(odd, odd_rows):
    kept = exact_dedup.keep_first_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r.text or "").split() for r in kept.collect()) == sorted({"".join((t or "").split()): (t or "").split() for _, t in odd_rows}.values()) or kept.count() == brute.exact(odd_rows)[1]
    assert kept.count() == brute.exact(odd_rows)[1]


def test_exact_query_sql(spark, sf, same_rows):
    same_rows(queries()["op5_exact_dedup"](spark, sf), oracle_sql()["op5_exact_dedup"])


def decon(df, items, **options):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontam.decontaminate(df, items, **options).collect()), key=str)


ITEMS = [(1, "Brown fox jumps over the lazy dog and then it sleeps for a very long time"), (2, "one two"), (2, "two one"), (10, "ONE"), (None, "no id here"), (3, None), (4, "..."), (5, "fox jumps over the lazy dog and then it sleeps for a very"), (6, "absent words only here for sure and nothing else at all to be found")]


@pytest.mark.parametrize("block", [50_000, 3])
def test_decontamination_odd(spark, odd, odd_rows, block):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id int, text string, window int")
    assert decon(odd, items, block=block) == sorted(brute.contamination(odd_rows, ITEMS), key=str)


def test_decontamination_random(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "d"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 80)))) for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 7)))) for i in range(12)] + [(100 + i, rows[i][1][: rng.randint(20, 60)]) for i in range(15)]
    got = decon(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert got == sorted(brute.contamination(rows, items), key=str)


def test_decontamination_empty(spark, odd, none):
    empty = spark.createDataFrame([], "item_id int, text string")
    assert decontam.decontaminate(odd, empty).filter("contaminated or n_hit > 0").count() == 0
    assert decontam.decontaminate(none, spark.createDataFrame(ITEMS, "item_id int, text string")).count() == 0


def test_decontamination_query(spark, sf):
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries()["op2_decontaminate"](spark, sf).collect()}
    for doc_id, n, hit, items, bad in brute.contamination(rows_of(spark, sf), rows_of(spark, sf, "benchmark", "item_id")):
        assert got[doc_id] == (n, hit, len(items), brute.sha(",".join(items)), bad)


def test_clean_documents_stay(spark, odd):
    items = spark.createDataFrame(ITEMS[:1], "item_id int, text string")
    kept = decontam.keep_clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3


def spans(df):
    return {(r.doc_id, i): [tuple(s) for s in r.spans] for i, r in enumerate(sorted(secrets.scan_secrets(df).collect(), key=str))}


def test_secret_base_spans(odd, odd_rows):
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans if s.kind < 3]) for r in secrets.scan_secrets(odd).collect()), key=str)
    assert got == sorted(((i, brute.secrets(t)) for i, t in odd_rows), key=str)


def test_secret_queries(spark, sf, none):
    got = {r.doc_id: r.base_sha256 for r in queries()["op9_secrets"](spark, sf).collect()}
    for doc_id, text in rows_of(spark, sf):
        assert got[doc_id] == brute.sha(",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in brute.secrets(text)))
    assert secrets.scan_secrets(none).count() == 0


def test_all_spans_of_the_real_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.spans for r in queries()["op9_secrets"](spark, sf).collect()}
    for doc_id, text in rows_of(spark, sf):
        own = brute.entropy_spans(text, secrets)
        assert got[doc_id] == ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in sorted(brute.secrets(text) + own))


def test_secret_scan_of_long_runs_and_many_matches(spark):
    """A run of 200,000 characters, and 20,000 matches in one text, take seconds."""
    rng = random.Random(31)
    run = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=200_000))
    many = " ".join(f"token={k:06d} {'x' * (k % 3)} {k:024x} q7Gz0PvXk2Lw9Rt4Yb6Nc8Hs{k}" for k in range(7000))
    rows = [(1, "é " + run + " end"), (2, many), (3, "word " * 50_000)]
    began = time.perf_counter()
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert time.perf_counter() - began < 60
    assert got[1] == [(2, 3, 200_002)] and got[3] == []
    assert got[2] == sorted(brute.secrets(many) + brute.entropy_spans(many, secrets)) and len(got[2]) > 20_000


def entropy(text):
    return -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text))


def test_window_entropy_is_incremental_yet_exact(spark):
    rng = random.Random(5)
    runs = ["".join(rng.choices("abcdefABCDEF0123456789+/", k=rng.randint(24, 70))) for _ in range(30)] + ["a" * 40, "ab" * 20]
    df = spark.createDataFrame([(r,) for r in runs], "r string").select("r", secrets.window_entropy(F.col("r"), 24, F.lit(3.6)).alias("w"))
    for row in df.collect():
        bits = [entropy(row.r[k : k + 24]) for k in range(len(row.r) - 23)]
        hot = [k for k, b in enumerate(bits) if b >= 3.6]
        assert abs(row.w.top - max(bits)) < 1e-9
        assert (row.w.lo, row.w.hi) == ((hot[0], hot[-1]) if hot else (None, None))


def test_entropy_spans_and_allow_list(spark):
    key = "q7Gz0PvXk2Lw9Rt4Yb6Nc8Hs1Jd3Fm5"
    rows = [(1, f"é key {key} end"), (2, "550e8400-e29b-41d4-a716-446655440000"), (3, "internationalizationinternationalization"), (4, f"token={key}"), (5, "2024-01-01T10-20-30-00000000000"), (6, "Donaudampfschiffahrtsgesellschaftskapitaen-2024"), (7, "EXAMPLE" + key)]
    got = {r.doc_id: [(s.start, secrets.KINDS[s.kind], s.end) for s in r.spans] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1] == [(6, "entropy", 6 + len(key))]
    assert [s[1] for s in got[4]] == ["assign"]
    assert not any(got[k] for k in (2, 3, 5, 6, 7))


def test_entropy_recall_by_class_and_length(spark):
    rng, lower, upper, digits = random.Random(9), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = {"base36": lower + digits, "base32": upper + "234567", "upper36": upper + digits, "base62": lower + upper + digits}
    cases = [(k, n) for k in kinds for n in (24, 28, 32, 40)]
    rows = [(at, "see " + "".join(rng.choices(kinds[k], k=n)) + " end") for at, (k, n) in enumerate(cases) for _ in range(100)]
    out = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id int, text string")).filter(F.size("spans") > 0).groupBy("doc_id").count().collect()
    got = {cases[r["doc_id"]]: r["count"] for r in out}
    assert all(got.get(c, 0) >= (94 if c[1] == 24 else 97) for c in cases), got


def test_entropy_allows_words_with_years(spark):
    texts = ["donaudampfschiffahrtsgesellschaft2024", "annual-report-2024-of-the-northern-office-12", "Donaudampfschiffahrt-Gesellschaft-1999", "QUARTERLY_RESULTS_OF_2023_AND_2024_GROUP"]
    out = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {r.doc_id: len(r.spans) for r in out} == {0: 0, 1: 0, 2: 0, 3: 0}
