"""Chat formatting by quotation linking.

A line is quoted ``k`` levels deep if it begins with ``k`` marks ``>``, with blanks
between and before them.  A passage is a run of lines of one level.  Lines that
announce a quotation ("... wrote:" in some languages, directly before one) go with it.

Text is normalised before it is hashed: lower case, every run of white space, line
breaks included, one blank, marks at the ends gone.  A rewrapped quotation therefore
has its original's hash.  A message's own text gives the hashes of the whole, of its
paragraphs, its lines and its sentences; so does a quoted passage.  Hashes have 128
bits and stand for the text.

A passage belongs to the latest message before a bound that has it as a whole; failing
that, to the one that has most characters of its paragraphs; failing that, of its lines
and sentences.  The bound of level 1 is the message itself.  Deeper levels are what the
message quoted at level 1 had quoted, so its turn is their bound; such a passage is
confirmed if that message quotes it too, one level less deep.

The latest occurrence before a bound is found by a scan over a range partitioning by
(conversation, hash, turn): what a partition lacks at its beginning comes from the end
of one before.  A passage that stands in any number of messages is spread like others.

A message replies to the message whose passages make up most characters of its level-1
quotations (the latest of several); without any it replies to the message before it.
The reply order is that of a depth-first walk over replies, children by turn.  As a
message without quotations follows the one before, it comes down to ordering branches,
runs of messages between explicit replies: first children and next siblings make one
list of each conversation's branches, and pointer doubling ranks it, in rounds as many
as the logarithm of the branches of a conversation, however deep a thread is.  No
conversation is ever gathered in one task, and only conversations with explicit replies
take part.

Defined results: a null text is empty; messages without a conversation are one
conversation; a null turn is before all others; messages with equal turns reply to the
same message; a quotation of nothing known is dropped from the text and counted; other
columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import in_arrow
from tidewell.plans.staging import stage, unstage

MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
WROTE = re.compile(r"^.{0,200}\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$", re.I)
#: Stands for null conversations and turns, which come first.
_LEAST = -(2**63) + 1
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: What a unit is; of a passage's units those of the least kind that is found decide.
WHOLE, PARAGRAPH, PART = 0, 1, 2


def quote_level(line: str) -> int:
    found = MARKS.match(line)
    return found[1].count(">") if found else 0


def normalised(text: str) -> str:
    return _EDGES.sub("", " ".join(text.casefold().split()))


def units(lines: list[str]) -> list[tuple[int, str]]:
    """(kind, normalised text) of lines as a whole, their paragraphs, lines and sentences; none that is empty."""
    blocks: list[list[str]] = [[]]
    for line in lines:
        if line.strip():
            blocks[-1].append(line)
        elif blocks[-1]:
            blocks.append([])
    found = [(WHOLE, normalised(" ".join(lines)))]
    for block in filter(None, blocks):
        joined = " ".join(block)
        found.append((PARAGRAPH, normalised(joined)))
        found += [(PART, normalised(x)) for x in (*block, *_SENTENCE.split(joined))]
    return list(dict.fromkeys((kind, text) for kind, text in found if text))


def parse(text: str) -> tuple[str, list[str], list[tuple[int, int, list[str]]]]:
    """(text without quotations, its own lines, quoted passages as (number, level, lines)); a quotation breaks own paragraphs."""
    lines = text.split("\n")
    levels = [quote_level(x) for x in lines]
    kept, own, passages = [], [], []
    for k, (line, level) in enumerate(zip(lines, levels, strict=True)):
        if level:
            if not k or levels[k - 1] != level:
                passages.append((len(passages), level, []))
                own.append("")
            passages[-1][2].append(MARKS.sub("", line))
        elif not (WROTE.match(line) and k + 1 < len(lines) and levels[k + 1]):
            kept.append(line)
            own.append(line)
    return "\n".join(kept).strip("\n") if passages else "\n".join(kept), own, [p for p in passages if any(map(normalised, p[2]))]


def _code(text: str) -> tuple[int, int]:
    import xxhash

    value = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


_MARK = [("hi", pa.int64()), ("lo", pa.int64())]
_OWN = pa.list_(pa.struct(_MARK))
_QUOTED = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("kind", pa.int32()), ("chars", pa.int32()), *_MARK]))


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), 1000):
            part = batch.slice(a, 1000)
            texts, owns, quoted = [], [], []
            for text in part["_text"].to_pylist():
                kept, own, passages = parse(text)
                texts.append(kept)
                owns.append([{"hi": h, "lo": x} for h, x in dict.fromkeys(_code(t) for _, t in units(own))])
                quoted.append([{"passage": n, "level": level, "kind": kind, "chars": len(t), **dict(zip(("hi", "lo"), _code(t), strict=True))} for n, level, ls in passages for kind, t in units(ls)])
            yield pa.RecordBatch.from_arrays([*(part[c] for c in ("conv_id", "turn", "role")), pa.array(texts, pa.string()), pa.array(owns, _OWN), pa.array(quoted, _QUOTED)], ["conv_id", "turn", "role", "text", "own", "quoted"])


def _carry(group: int):
    """For rows sorted by ``group`` long columns and more, the last value not null strictly before each row in its group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, leads = TaskContext.get().partitionId(), None, True
        held = None  # the last value of the group so far
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(group)])
            value = batch["_value"]
            known = np.asarray(value.is_valid())
            values = value.fill_null(0).to_numpy()
            new = np.ones(n, bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            new[0] = last is None or bool((keys[:, 0] != last).any())
            if new[0]:
                held, leads = None, last is None
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))  # of each row's group, -1: in an earlier batch
            seen = np.concatenate([[-1], np.maximum.accumulate(np.where(known, at, -1))[:-1]])
            inside = seen >= np.maximum(start, 0)
            first = start == (0 if new[0] else -1)
            out = np.where(inside, values[np.maximum(seen, 0)], held or 0)
            there = inside | (first & (not new[0]) & (held is not None))
            open_ = first & leads & ~there  # a value may come from the partitions before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=~there), pa.array(open_), pa.array(np.full(n, part, np.int32))], [*batch.schema.names, "_before", "_open", "_part"])
            final = max(int(start[-1]), 0)
            mine = np.flatnonzero(known[final:])
            if len(mine):
                held = int(values[final + mine[-1]])
            elif start[-1] >= 0 and new[final]:
                held = None
            last, leads = keys[:, -1], leads and bool(first[-1])

    return work


def carried(rows: DataFrame, group: list[str], order: list[str], value: Column, into: str) -> DataFrame:
    """Adds ``into``: the last ``value`` not null strictly before a row, by ``order``, among rows of its ``group`` (long, no nulls).

    A partition of the range partitioning is scanned on its own; of the partitions before
    one row each is looked at.
    """
    kept = rows.columns
    wide = rows.select(*group, *[c for c in kept if c not in group], value.cast("long").alias("_value"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields)
    ordered = wide.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    filled = stage(in_arrow(ordered, _carry(len(group)), f"{kind}, _before long, _open boolean, _part int"), "quotes-carried")
    key = F.struct(*group)
    end = F.max(F.struct(key.alias("key"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.coalesce("_value", "_before").alias("value")))
    ends = filled.groupBy("_part").agg(F.min(key).alias("first"), end.alias("end"))  # a row for each task
    known = F.when(F.col("end.value").isNotNull(), F.struct(F.col("end.key").alias("key"), F.col("end.value").alias("value")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    over = ends.select("_part", "first", F.last(known, ignorenulls=True).over(before).alias("c")).filter("c.key = first").select("_part", F.col("c.value").alias("_over"))
    return filled.join(F.broadcast(over), "_part", "left").select(*kept, F.coalesce("_before", F.when(F.col("_open"), F.col("_over"))).alias(into))


def _latest(wanted: DataFrame, own: DataFrame) -> DataFrame:
    """``wanted`` (conv_id, hi, lo, bound, ...) with ``source``, the latest turn below the bound that has the hash among ``own`` (conv_id, hi, lo, turn)."""
    key = ["conv_id", "hi", "lo"]
    asked = wanted.select(*key, "bound").distinct()
    both = asked.select(*key, F.col("bound").alias("at"), F.lit(0).alias("has")).unionByName(own.select(*key, F.col("turn").alias("at"), F.lit(1).alias("has")))
    found = carried(both, key, ["at", "has"], F.when(F.col("has") == 1, F.col("at")), "source").filter("has = 0 and source is not null")
    return wanted.join(found.select(*key, F.col("at").alias("bound"), "source"), [*key, "bound"], "left")


def _decide(found: DataFrame) -> DataFrame:
    """A row for each passage (conv_id, turn, passage, level): its source, its characters and those found there."""
    passage = ["conv_id", "turn", "passage", "level"]
    votes = found.filter("source is not null").groupBy(*passage, "kind", "source").agg(F.sum("chars").alias("met"))
    best = votes.groupBy(*passage).agg(F.max(F.struct((-F.col("kind")).alias("kind"), "met", "source")).alias("best"))
    size = found.filter(F.col("kind") == WHOLE).select(*passage, "chars", "hi", "lo")
    return size.join(best, passage, "left").select(*passage, "chars", "hi", "lo", F.col("best.source").alias("source"))


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(messages, links): messages parsed, and a row for each quoted passage.

    Links have conv_id, turn, passage, level, chars, hi and lo (the hash), source (the turn
    it comes from, null if unknown) and confirmed (null at level 1).
    """
    rows = messages.select(F.coalesce(F.col(conv_col).cast("bigint"), F.lit(_LEAST)).alias("conv_id"), F.coalesce(F.col(turn_col).cast("bigint"), F.lit(_LEAST)).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = "conv_id long, turn long, role string, text string, own array<struct<hi:long,lo:long>>, quoted array<struct<passage:int,level:int,kind:int,chars:int,hi:long,lo:long>>"
    parsed = stage(in_arrow(rows, _parse_rows, kind), "quotes-messages")
    # Messages that repeat a conversation and a turn number their passages alike; the hash tells them apart.
    quoted = parsed.filter(F.size("quoted") > 0).select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*").distinct()
    quoted = stage(quoted, "quotes-units")
    # Only what is quoted somewhere in its conversation matters as original.
    own = parsed.select("conv_id", "turn", F.explode("own").alias("o")).select("conv_id", "o.hi", "o.lo", "turn").join(quoted.select("conv_id", "hi", "lo").distinct(), ["conv_id", "hi", "lo"], "left_semi").distinct()
    own = stage(own, "quotes-originals")

    outer = stage(_decide(_latest(quoted.filter("level = 1").withColumn("bound", F.col("turn")), own)), "quotes-outer")
    replies = reply_targets(outer).select("conv_id", "turn", F.col("reply_to").alias("bound"))
    deeper = quoted.filter("level > 1").join(replies, ["conv_id", "turn"], "left")
    inner = _decide(_latest(deeper.withColumn("bound", F.coalesce("bound", "turn")), own))
    # The same passage, one level less deep, in the message that the quoting one replies to.
    above = outer.unionByName(inner).select("conv_id", F.col("turn").alias("_turn"), (F.col("level") + 1).alias("level"), "hi", "lo").distinct()
    inner = inner.join(replies.withColumnRenamed("bound", "_turn"), ["conv_id", "turn"], "left")
    inner = inner.join(above.withColumn("confirmed", F.lit(True)), ["conv_id", "_turn", "level", "hi", "lo"], "left")
    columns = ["conv_id", "turn", "passage", "level", "chars", "hi", "lo", "source"]
    links = outer.select(*columns, F.lit(None).cast("boolean").alias("confirmed")).unionByName(inner.select(*columns, F.coalesce("confirmed", F.lit(False)).alias("confirmed")))
    links = stage(links, "quotes-links")
    unstage(quoted, own, outer)
    return parsed, links


def reply_targets(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) of messages with a level-1 passage whose source is known."""
    voted = links.filter("level = 1 and source is not null").groupBy("conv_id", "turn", "source").agg(F.sum("chars").alias("chars"))
    return voted.groupBy("conv_id", "turn").agg(F.max(F.struct("chars", "source")).alias("best")).select("conv_id", "turn", F.col("best.source").alias("reply_to"))


def branch_ranks(branches: DataFrame) -> DataFrame:
    """(conv_id, start, rank) of branches (conv_id, start, parent, at): their places, from 1, in a walk over the tree.

    ``parent`` is the start of the branch that has the message ``at``, null for the
    conversation's first branch, which isn't listed.  Children of a branch come at later
    places first, then by start.  A branch is an arc in and an arc out of it; the list of a
    conversation's arcs is ranked by pointer doubling.
    """
    none = F.lit(_LEAST)  # parent of branches off the first one; no branch starts there
    rows = stage(branches.select("conv_id", F.coalesce("parent", none).alias("parent"), (-F.col("at")).alias("back"), "start"), "quotes-branches")
    # Siblings in reverse: what was last carried is the next one.
    back = rows.select("conv_id", "parent", (-F.col("back")).alias("at"), (-F.col("start")).alias("late"), "start")
    ordered = carried(back, ["conv_id", "parent"], ["at", "late"], F.col("start"), "next")
    ordered = stage(ordered.select("conv_id", "parent", "start", "next", F.struct((-F.col("at")).alias("back"), "start").alias("place")), "quotes-siblings")
    child = ordered.groupBy("conv_id", F.col("parent").alias("start")).agg(F.min("place").alias("c")).select("conv_id", "start", F.col("c.start").alias("child"))
    node = lambda start, out: F.struct(start.alias("start"), F.lit(out).alias("out"))
    inward = ordered.join(child, ["conv_id", "start"], "left").select("conv_id", node(F.col("start"), 0).alias("arc"), F.when(F.col("child").isNull(), node(F.col("start"), 1)).otherwise(node(F.col("child"), 0)).alias("next"))
    up = F.when(F.col("parent") != none, node(F.col("parent"), 1))
    outward = ordered.select("conv_id", node(F.col("start"), 1).alias("arc"), F.when(F.col("next").isNull(), up).otherwise(node(F.col("next"), 0)).alias("next"))
    arcs = inward.unionByName(outward).select("conv_id", "arc", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("left"))
    arcs = stage(arcs, "quotes-arcs")
    while not arcs.filter("next is not null").isEmpty():
        then = arcs.select("conv_id", F.col("arc").alias("next"), F.col("next").alias("over"), F.col("left").alias("more"))
        further = arcs.join(then, ["conv_id", "next"], "left").select("conv_id", "arc", F.col("over").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0).cast("long"))).alias("left"))
        before, arcs = arcs, stage(further, "quotes-arcs")
        unstage(before)
    total = ordered.groupBy("conv_id").agg((2 * F.count(F.lit(1))).alias("arcs"))
    ranks = arcs.filter("arc.out = 0").join(total, "conv_id").select("conv_id", F.col("arc.start").alias("start"), (F.col("arcs") - F.col("left")).alias("rank"))
    ranks = stage(ranks, "quotes-ranks")
    unstage(rows, ordered, arcs)
    return ranks


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message, without quotations: conv_id, turn, role, text, reply_to, n_quoted, n_linked, n_confirmed, order_key.

    ``reply_to`` is the turn explicitly quoted, null without one; the counts are of quoted
    passages.  Ordering by conv_id and order_key (branch, turn) gives the conversations in
    reply order; the first branch of a conversation has number 0.
    """
    parsed, links = link_quotations(messages, conv_col, turn_col, role_col, text_col)
    counts = links.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quoted"), F.count("source").alias("n_linked"), F.count_if("confirmed").alias("n_confirmed"))
    replies = stage(counts.join(reply_targets(links), ["conv_id", "turn"], "left"), "quotes-replies")

    explicit = replies.filter("reply_to is not null").select("conv_id", "turn", "reply_to")
    turns = parsed.select("conv_id", "turn").join(explicit.select("conv_id").distinct(), "conv_id", "left_semi").distinct().join(explicit, ["conv_id", "turn"], "left")
    start = F.when(F.col("reply_to").isNotNull(), F.col("turn"))
    placed = carried(turns, ["conv_id"], ["turn"], start, "_last").select("conv_id", "turn", "reply_to", F.coalesce(start, F.col("_last")).alias("branch"))
    placed = stage(placed, "quotes-placed")
    at = placed.select("conv_id", F.col("turn").alias("reply_to"), F.col("branch").alias("parent"))
    branches = placed.filter("reply_to is not null").select("conv_id", F.col("turn").alias("start"), "reply_to").join(at, ["conv_id", "reply_to"])
    ranks = branch_ranks(branches.select("conv_id", "start", "parent", F.col("reply_to").alias("at")))

    ranked = placed.select("conv_id", "turn", F.col("branch").alias("start")).join(ranks, ["conv_id", "start"]).select("conv_id", "turn", "rank")
    info = stage(replies.join(ranked, ["conv_id", "turn"], "full"), "quotes-info")
    unstage(placed, ranks)
    out = parsed.select("conv_id", "turn", "role", "text").join(info, ["conv_id", "turn"], "left")
    zero, least = F.lit(0).cast("long"), F.lit(_LEAST)
    shown = lambda c: F.when(F.col(c) != least, F.col(c)).alias(c)
    key = F.struct((F.coalesce("rank", F.lit(-1).cast("long")) + 1).alias("branch"), F.col("turn").alias("turn"))
    return out.select(shown("conv_id"), shown("turn"), "role", "text", "reply_to", *[F.coalesce(c, zero).alias(c) for c in ("n_quoted", "n_linked", "n_confirmed")], key.alias("order_key"))


def chat_lines(ordered: DataFrame) -> DataFrame:
    """Messages of ``reply_order`` as (conv_id, order_key, line), a JSON object with role and content in each line."""
    return ordered.select("conv_id", "order_key", F.to_json(F.struct("role", F.col("text").alias("content"))).alias("line"))
