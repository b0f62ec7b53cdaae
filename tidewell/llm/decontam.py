"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words is one
window.  A document contains a window only if it contains every shingle of it, so
for exact containment the necessary prefix is one shingle:

1. the windows' shingles of up to ``SHINGLE`` words are counted in the corpus;
2. each window keeps its rarest shingle as prefix; a window with a shingle that no
   document has is out;
3. document positions are joined to the prefixes, the window's start is bounded
   below by 0 (position) and its end by the document's length;
4. what remains is compared word by word over the window's whole size.

The documents are scanned twice: for step 1, which counts their words too, and for
steps 3 and 4.  No document is shuffled; only counts, verified hits and one thin row per
document are.  The broadcast tables hold ``BLOCK`` windows at most; a larger benchmark
goes through in blocks, each with two scans.

Defined results: a null text or item has no words; a null item id names no item;
documents without words have n_words 0 and are clean; rows that repeat an id are
judged each for itself; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import ascii_lower, doc_key, unused
from tidewell.plans.staging import compact, spread, stage

WINDOW, SHINGLE = 13, 5
#: Windows (with their items) that are broadcast at once; a window has under 1 KB.
BLOCK = 50_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + i) for i in range(size)])


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (window, size, item): the window's words joined by spaces, which no word holds."""
    words = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.lit(window), F.size("w"))
    cut = words.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("at"))
    return cut.select("item", "size", F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ").alias("window")).distinct()


def _with_shingles(windows: DataFrame, sizes: list[int], shingle: int) -> DataFrame:
    w = F.split("window", " ")
    parts = [
        F.when(F.least(F.lit(shingle), F.col("size")) == k, F.transform(F.sequence(F.lit(0), F.col("size") - k), lambda o: F.struct(o.alias("off"), _shingle(w, o, k).alias("h")))) for k in sizes
    ]  # noqa: B023
    return windows.select("window", "size", F.explode(F.coalesce(*parts)).alias("s")).select("window", "size", "s.off", "s.h")


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Every position of a document with the hash of the shingle there, for each size; and one at -1, without a hash."""
    at = docs.select("_row", "_id", "_key", "_w", F.explode(F.sequence(F.lit(-1), F.size("_w") - 1)).alias("_at"))
    hashes = [F.when((F.col("_at") >= 0) & (F.col("_at") + k <= F.size("_w")), _shingle(F.col("_w"), F.col("_at"), k)) for k in sizes]
    if len(sizes) == 1:
        return at.withColumn("h", hashes[0])
    each = F.when(F.col("_at") < 0, F.array(F.lit(None).cast("long"))).otherwise(F.array(*hashes))
    return at.withColumn("h", F.explode(each))


def _seen(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """One scan: a row (h, n) for each shingle of ``shingles`` that occurs, with how often, and a row (row, id, key, n_words) for each document."""
    known = shingles.select("h").distinct().withColumn("_known", F.lit(True))
    every = _positions(docs, sizes).join(F.broadcast(known), "h", "left").filter("_at < 0 OR _known")
    of_doc = lambda c: F.when(F.col("_at") < 0, c)
    keys = [F.col("h"), of_doc(F.col("_row")).alias("_row"), of_doc(F.col("_id")).alias("_id"), of_doc(F.col("_key")).alias("_key"), of_doc(F.size("_w")).alias("n_words")]
    return every.select(*keys).groupBy("h", "_row", "_id", "_key", "n_words").agg(F.count(F.lit(1)).alias("n"))


def _block_hits(docs: DataFrame, shingles: DataFrame, seen: DataFrame, sizes: list[int]) -> DataFrame:
    """Verified hits of one block of distinct windows: (id, key, start, size, window)."""
    rarity = shingles.join(seen, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = rarity.groupBy("window", "size").agg(F.min(F.struct("n", "off", "h")).alias("p")).filter("p.n > 0").select("window", "size", "p.off", "p.h")
    prefix = stage(prefix, "decontam-prefixes", rows=shingles.count(), width=160, least=spread(docs.sparkSession))
    start = F.col("_at") - F.col("off")
    near = _positions(docs, sizes).join(F.broadcast(prefix), "h").filter((start >= 0) & (start + F.col("size") <= F.size("_w")))
    same = near.filter(F.array_join(F.slice("_w", start + 1, F.col("size")), " ") == F.col("window"))
    return same.select("_id", "_key", start.alias("start"), "size", "window")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, share: int = 20, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted array of ids as strings), contaminated, key.

    A document is contaminated if it has a hit and the words in hits are at least one in ``share``.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_key", doc_key(F.col("_id"), F.col("_text")))
    worded = rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_key", words_of(F.col("_text")).alias("_w"))
    windows = stage(item_windows(items, item_col, item_text_col, window), "decontam-windows", rows=64 * items.count(), width=128)
    n = windows.count()
    if not n:
        return worded.select(F.col("_id").alias("doc_id"), F.size("_w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.col("_key").alias("key"), F.lit(False).alias("contaminated"))

    blocks = -(-n // block)
    own = windows.select("window", "size").distinct()
    thin, found = None, []
    for b in range(blocks):
        some = own.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        sizes = sorted({min(shingle, r[0]) for r in some.select("size").distinct().collect()})  # no more than ``window`` values
        if not sizes:
            continue
        shingles = stage(_with_shingles(some, sizes, shingle), "decontam-shingles", rows=window * min(n, block), width=160)
        seen = stage(_seen(worded, shingles, sizes), "decontam-seen", rows=docs.count() + window * min(n, block), width=48)
        thin = seen.filter("h IS NULL").select("_id", "_key", F.col("n_words").cast("long").alias("n_words")) if thin is None else thin
        found.append(_block_hits(worded, shingles, seen.filter("h IS NOT NULL").select("h", "n"), sizes))
    hits = stage(reduce(DataFrame.unionByName, found), "decontam-hits")

    by_doc = Window.partitionBy("_id", "_key").orderBy("start", "size")
    before = F.max(F.col("start") + F.col("size")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("size")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    covered = hits.withColumn("new", fresh).groupBy("_id", "_key").agg(F.sum("new").cast("long").alias("n_hit"))
    items_of = windows.select("window", "item").filter("item is not null")
    met = hits.select("_id", "_key", "window").distinct().join(F.broadcast(items_of) if n <= block else items_of, "window")
    named = met.groupBy("_id", "_key").agg(F.sort_array(F.collect_set("item")).alias("items"))

    on = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & (a["_key"] == b["_key"])
    found = covered.join(named, on(covered, named), "left").select(covered["_id"], covered["_key"], "n_hit", "items")
    out = thin.join(found, on(thin, found), "left").select(
        thin["_id"].alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), thin["_key"].alias("key")
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that aren't contaminated."""
    found = decontaminate(docs, items, id_col, text_col)
    own_key, g_id, g_key = unused(docs, "key", "g_id", "g_key")
    gone = found.filter("contaminated").select(F.col("doc_id").alias(g_id), F.col("key").alias(g_key)).distinct()
    own = docs.withColumn(own_key, doc_key(F.col(id_col), F.col(text_col)))
    left = own.join(gone, F.col(id_col).eqNullSafe(F.col(g_id)) & (F.col(own_key) == F.col(g_key)), "left_anti").drop(own_key)
    return compact(left, docs)
