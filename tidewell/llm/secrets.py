"""Secret scan: base patterns plus sliding-window Shannon entropy, in DataFrame operations only.

Every row is scanned on its own, so there is no shuffle and no state beyond a row.
Spans come from the gaps and matches that a pattern splits a text into; only rows in
which a pattern occurs pay for that.

Candidate strings for entropy are runs of ``CANDIDATE``.  A window of ``WINDOW``
characters slides over a run; the counts of its characters, and with them the sum of
``c * log2(c)``, are changed by the character that enters and the one that leaves.
The entropy is ``log2(WINDOW) - sum / WINDOW``.  Work grows with a run's length, and
with matches ``m`` of a text as ``m log m``.  Each class of characters has its own
threshold.  Runs that match the allow list, and runs that touch a base span, add none.

Defined results: a null text is empty and has no spans; spans count code points, end
exclusive; rows that repeat an id are scanned each for itself; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Maximal runs: a run of this length is what the base pattern finds and keeps.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
WINDOW = 24
#: Character class (pattern of the whole run, what it must have besides) and the least entropy in bits a character.
CLASSES = [
    ("hex", r"^[0-9A-Fa-f]+$", r"[0-9]", 2.9),
    ("base36", r"^[a-z0-9+/_=-]+$", r"^(?=.*[0-9])(?=.*[a-z])", 3.6),
    ("base32", r"^[A-Z0-9+/_=-]+$", r"^(?=.*[0-9])(?=.*[A-Z])", 3.5),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", 3.9),
]
#: A word, a word with a year, or a short number.
_PART = r"(?:[A-Za-z]+(?:(?:19|20)[0-9]{2})?|[0-9]{1,4})"
#: Known harmless runs: UUIDs, dates with times, decimal numbers, ruled lines, path-like and hyphenated words, also with years or short numbers.
ALLOW = [r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-][0-9-]+$", r"^[0-9+/_=-]+$", r"^[A-Za-z]*([-_/=+][A-Za-z]+)*[-_/=+]*$", rf"^[-_/=+]*{_PART}(?:[-_/=+]+{_PART})*[-_/=+]*$", r"(?i)example|placeholder|xxxx|0123456789|abcdefghij"]

_SPANS = "array<struct<s:int,e:int,m:string>>"
_OFFSETS = [1 << k for k in range(31)]
#: Least code of a character of a candidate, and how many codes there are from it on.
_FIRST_CODE, _CODES = 43, 80


def _scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under an associative function, by doubling: each element joins the one 1, 2, 4, ... places before."""

    def step(acc: Column, d: Column) -> Column:
        return F.when(d < F.size(acc), F.transform(acc, lambda x, i: F.when(i >= d, join(F.get(acc, i - d), x)).otherwise(x))).otherwise(acc)

    return F.aggregate(F.array(*map(F.lit, _OFFSETS)), values, step)


def _spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs of start, end and text; empty where there is none."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # split() gives a gap before each match and one after the last, which pairs with nothing.
    steps = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct((F.length(g) + F.length(m)).alias("e"), m.alias("m"))), lambda x: x["m"].isNotNull())
    ends = _scan(steps, lambda a, b: F.struct((a["e"] + b["e"]).alias("e"), b["m"].alias("m")))
    spans = F.transform(ends, lambda x: F.struct((x["e"] - F.length(x["m"])).alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def _apart(runs: Column, spans: Column) -> Column:
    """The runs that no span touches; a running maximum of the ends of the spans that start before a run ends."""
    place = lambda at, late, end, run: F.struct(at.alias("at"), F.lit(late).alias("late"), end.alias("end"), run.alias("run"))
    none = F.lit(None).cast(_SPANS[6:-1])
    events = F.array_sort(F.concat(F.transform(spans, lambda b: place(b["start"], 1, b["end"], none)), F.transform(runs, lambda r: place(r["e"], 0, F.lit(-1), r))))
    reach = _scan(events, lambda a, b: F.struct(b["at"].alias("at"), b["late"].alias("late"), F.greatest(a["end"], b["end"]).alias("end"), b["run"].alias("run")))
    return F.transform(F.filter(reach, lambda x: x["run"].isNotNull() & (x["end"] <= x["run"]["s"])), lambda x: x["run"])


def _xlog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(run: Column, width: int, least: Column) -> Column:
    """Struct of first and last window start whose entropy is at least ``least`` (null if none) and the top entropy.

    The run is split into codes once; each step has the code that enters and the one that
    leaves, so the work is in proportion to the run.
    """
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c) - _FIRST_CODE)
    moves = F.zip_with(codes, F.concat(F.array_repeat(F.lit(-1), width), codes), lambda a, b: F.struct(a.alias("new"), b.alias("old")))
    zero = F.array_repeat(F.lit(0), _CODES)
    start = F.struct(F.lit(0).alias("i"), zero.alias("c"), F.lit(0.0).alias("x"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), F.lit(0.0).alias("top"))

    def step(acc, move):
        i, new, old = acc["i"] + 1, move["new"], move["old"]
        at = lambda k: F.get(acc["c"], k)
        gain = _xlog(at(new) + 1) - _xlog(at(new))
        loss = F.when(old >= 0, _xlog(at(old)) - _xlog(at(old) - 1)).otherwise(F.lit(0.0))
        x = F.when(new == old, acc["x"]).otherwise(acc["x"] + gain - loss)
        counts = F.when(new == old, acc["c"]).otherwise(F.transform(acc["c"], lambda v, k: F.when(k == new, v + 1).when(k == old, v - 1).otherwise(v)))
        bits = F.when(i >= width, F.log2(F.lit(float(width))) - x / width).otherwise(F.lit(0.0))
        hit = (i >= width) & (bits >= least)
        return F.struct(i.alias("i"), counts.alias("c"), x.alias("x"), F.when(hit & acc["lo"].isNull(), i - width).otherwise(acc["lo"]).alias("lo"), F.when(hit, i - width).otherwise(acc["hi"]).alias("hi"), F.greatest(acc["top"], bits).alias("top"))

    inside = F.filter(moves, lambda m: m["new"].isNotNull())
    return F.aggregate(inside, start, step, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi"), acc["top"].alias("top")))


def _threshold(run: Column) -> Column:
    """Least entropy for the first class that the run belongs to; null if it belongs to none or is allowed."""
    least = F.lit(None).cast("double")
    for _, whole, has, bits in reversed(CLASSES):
        least = F.when(run.rlike(whole) & run.rlike(has), F.lit(bits)).otherwise(least)
    return F.when(~run.rlike("|".join(f"(?:{p})" for p in ALLOW)), least)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per row: doc_id and spans, an array of struct(start, kind, end), kind as an index of ``KINDS``."""
    text = F.col("_text")
    one = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = lambda spans, k: F.transform(spans, lambda x: F.struct(x["s"].alias("start"), F.lit(k).alias("kind"), x["e"].alias("end")))
    assign = F.filter(_spans(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    base = one.withColumn("_base", F.concat(kind(assign, 0), kind(_spans(text, ACCESS_LONG), 1), kind(_spans(text, HEX_LONG), 2)))
    free = _apart(F.col("_runs"), F.col("_base"))
    rated = F.filter(F.transform(free, lambda r: F.struct(r["s"].alias("s"), r["m"].alias("m"), _threshold(r["m"]).alias("t"))), lambda r: r["t"].isNotNull())
    hot = F.filter(F.transform(rated, lambda r: F.struct(r["s"].alias("s"), window_entropy(r["m"], width, r["t"]).alias("w"))), lambda r: r["w"]["lo"].isNotNull())
    added = F.transform(hot, lambda r: F.struct((r["s"] + r["w"]["lo"]).alias("start"), F.lit(3).alias("kind"), (r["s"] + r["w"]["hi"] + width).alias("end")))
    return (
        base.withColumn("_runs", _spans(text, CANDIDATE))
        .withColumn("_added", F.when(F.size("_runs") > 0, added).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")))
        .select("doc_id", F.array_sort(F.concat("_base", "_added")).alias("spans"))
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
