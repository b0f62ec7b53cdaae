"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

A document's set is its distinct shingles of ``size`` words as 64-bit hashes; two
documents link if ``100 * common >= percent * union``.

1. Documents with equal sets are one node, so copies are compared once.
2. Keys put nodes that may link into neighbourhoods; no pair of nodes with a key is
   written down, every node gets one edge to the least node of its keys, and connected
   components of these are the neighbourhoods.  There are two kinds of keys:
   ``bands`` (min-hash): a pair at the threshold shares a band of ``ROWS`` minima except
   with a probability under ``MISS``, closer pairs with far less; ``prefix``: the least
   hashes of a set, as many as make it impossible that a link shares none (prefix
   filtering in the order of the hashes), which misses nothing but makes larger
   neighbourhoods where many documents share a passage.
3. Neighbourhoods are cut into tiles.  One of a volume up to ``FIRST`` is a tile.  The
   nodes of a larger one are banded by size and dealt twice, by other hashes and other
   size bands, to tiles of that volume; a dense group is one component after that.
4. Where components remain apart in such a neighbourhood, every node outside its
   largest component meets every node of its own and the adjacent size bands, in pairs
   of tiles of up to ``TILE``.
5. In a tile, each node has a bitmap of its hashed shingles.  A bit of one that the
   other lacks stands for a shingle at least that isn't common, so bit counts bound
   the overlap from above.  Only pairs whose bound reaches the threshold, and that
   aren't already connected, get the exact intersection of their sorted arrays.
6. A tile gives a spanning forest of its links, and connected components of all
   forests are the result.  No link in a neighbourhood is lost by that, as a pair that
   is skipped is connected already.

Neither a band nor a group of copies is ever held in one task as pairs, and nothing
is capped.  Data dealt in steps 3 and 4 are linear in a neighbourhood as long as what
stays outside its largest component fits a tile.

Defined results: a null text, or one without words, has the empty set, links with
nothing and is its own component; repeated rows are copies; a null id never names a
component that has another; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import doc_key, in_arrow, unused
from tidewell.llm.components import connected_components, star_edges
from tidewell.llm.words import hashed_words, parts
from tidewell.plans.staging import compact, parts_of, stage, unstage

SIZE, PERCENT = 4, 85
#: Minima of a band, and the probability that a pair at the threshold shares no band.
ROWS, MISS = 5, 1.1e-11
#: Volume of a tile of the first dealing, and of the others; a pair of tiles has twice as much.  A set counts as its shingles and ``ROW`` more.
FIRST, TILE, ROW = 40_000, 1_000_000, 64
#: Bytes of a tile's bitmaps, and nodes that one is compared with at a time.
MAPS, STEP = 16_000_000, 512
#: Characters of texts that are hashed at a time.
CHARS = 1_000_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]
_MOST_BANDS = 512
_rng = np.random.default_rng(20240131)
_XOR = _rng.integers(0, 1 << 32, ROWS * _MOST_BANDS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, ROWS * _MOST_BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def n_bands(percent: int) -> int:
    """Bands that leave a pair at the threshold unmet with a probability of at most ``MISS``."""
    if percent >= 100:
        return 1
    need = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))
    if need > _MOST_BANDS:
        raise ValueError(f"a similarity of {percent} % takes {need} bands; use prefix keys")
    return need


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[3]
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashed, counts = hashed_words(texts)
    ends = np.cumsum(counts)
    n = max(0, len(hashed) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = _mix(rolled * _M[0] + hashed[k : k + n] + _M[1])
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:  # the whole sequence is one shingle, unlike any of more words
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashed[a:b]:
                    x = _mix(np.array([x * _M[0] + h + _M[2]]))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    import xxhash

    value = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def band_keys(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """A row of band keys for each of the sets, none of them empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(lengths) - lengths
    keys = np.zeros((len(sets), bands), np.uint64)
    scratch = np.empty_like(flat)
    for k in range(ROWS * bands):
        np.bitwise_xor(flat, _XOR[k], out=scratch)
        np.multiply(scratch, _MUL[k], out=scratch)
        band = k // ROWS
        keys[:, band] = _mix((keys[:, band] + np.uint64(band + 1)) * _M[0] + np.minimum.reduceat(scratch, starts).astype(np.uint64))
    return keys.view(np.int64)


def prefix_keys(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """The least hashes of each set, of which two sets that link share one: a link has ``percent`` of either set in common."""
    return [s[: len(s) - -(-percent * len(s) // 100) + 1].view(np.int64) for s in sets]


def _sketch(size: int, percent: int, exact: bool):
    bands = 0 if exact else n_bands(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "_text", CHARS):
                sets = shingle_sets(part["_text"], size)
                full = [s for s in sets if len(s)]
                keys = iter((prefix_keys(full, percent) if exact else band_keys(full, bands)) if full else ())
                marks = [digest(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["key"], pa.array([x for x, _ in marks], pa.int64()), pa.array([x for _, x in marks], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "key", "hi", "lo", "n", "keys"],
                )

    return work


def _sets_of_nodes(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat an id and a text give their node's set once a task
        for batch in batches:
            for part in parts(batch, "_text", CHARS):
                nodes, fresh = part["node"].to_pylist(), []
                for node in nodes:
                    fresh.append(node not in seen)
                    seen.add(node)
                part = part.filter(pa.array(fresh, pa.bool_()))
                if not len(part):
                    continue
                sets = shingle_sets(part["_text"], size)
                same = [digest(s) == m if len(s) else False for s, m in zip(sets, zip(part["hi"].to_pylist(), part["lo"].to_pylist(), strict=True), strict=True)]
                data = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part["node"], data], ["node", "data"]).filter(pa.array(same, pa.bool_()))

    return work


def link_tile(nodes: list[int], sets: list[np.ndarray], sides: list[int], percent: int = PERCENT, roots: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links in a tile (side 2), or between two tiles (sides 0 and 1); nodes with one root are connected already."""
    order = sorted(range(len(nodes)), key=lambda k: (len(sets[k]), nodes[k]))
    known = np.unique([roots[k] for k in order], return_inverse=True)[1] if roots else np.arange(len(nodes))
    nodes, sets, sides = [nodes[k] for k in order], [sets[k] for k in order], np.array([sides[k] for k in order])
    lengths = np.array([len(s) for s in sets])
    bits = min(1 << 16, max(256, 1 << int(2 * lengths.max()).bit_length()))
    while bits > 256 and len(sets) * bits > MAPS * 8:  # a bound from fewer bits is looser, never wrong
        bits >>= 1
    maps = np.zeros((len(sets), bits // 64), np.uint64)
    for k, s in enumerate(sets):
        at = (s & np.uint64(bits - 1)).astype(np.int64)
        np.bitwise_or.at(maps[k], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    root = known  # of each node, kept flat
    forest = []
    for i in range(1, len(nodes)):
        low = int(np.searchsorted(lengths, -(-percent * lengths[i] // 100), "left"))
        if low >= i:
            continue
        other = np.arange(low, i)
        other = other[(root[low:i] != root[i]) & ((sides[low:i] != sides[i]) | (sides[i] == 2))]
        if not len(other):
            continue
        # The bound costs one pass over the bitmaps; blocks keep it small.
        for a in range(0, len(other), STEP):
            block = other[a : a + STEP]
            block = block[root[block] != root[i]]
            mine = np.bitwise_count(maps[i] & ~maps[block]).sum(axis=1, dtype=np.int64)
            theirs = np.bitwise_count(maps[block] & ~maps[i]).sum(axis=1, dtype=np.int64)
            bound = np.minimum(lengths[i] - mine, lengths[block] - theirs)
            maybe = np.flatnonzero(bound >= -(-percent * (lengths[block] + lengths[i]) // (100 + percent)))
            for k in maybe[np.argsort(-bound[maybe], kind="stable")]:
                j = int(block[k])
                if root[j] == root[i]:
                    continue
                common = len(sets[i]) + len(sets[j]) - len(np.union1d(sets[i], sets[j]))
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    forest.append((nodes[i], nodes[j]))
                    keep, gone = root[j], root[i]
                    root[root == gone] = keep
    return forest


def _link(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, nodes, sets, sides, roots = None, [], [], [], []

        def links() -> pa.RecordBatch:
            found = link_tile(nodes, sets, sides, percent, roots) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

        for batch in batches:  # sorted by tile
            for key, node, side, root, data in zip(batch["tile"].to_pylist(), batch["node"].to_pylist(), batch["side"].to_pylist(), batch["root"].to_pylist(), batch["data"], strict=True):
                if key != tile:
                    if len(nodes) > 1:
                        yield links()
                    tile, nodes, sets, sides, roots = key, [], [], [], []
                if nodes and node == nodes[-1]:
                    continue  # a row that repeats an id and a text
                nodes.append(node)
                sets.append(np.frombuffer(data.as_py(), np.uint64))
                sides.append(side)
                roots.append(root)
        if len(nodes) > 1:
            yield links()

    return work


def _band(percent: int, shift: float) -> Column:
    """Size band of a set: sets that link are in one band or in adjacent ones, whatever the shift."""
    width = math.log(100 / (percent - 0.1))  # a little wider than the sizes of linked sets can differ
    return F.floor(F.log("n") / width + shift).cast("int")


def _volume() -> Column:
    return F.sum(F.col("n") + ROW)


def _entry(tile: Column, side: Column) -> Column:
    return F.struct(tile.cast("string").alias("tile"), side.cast("int").alias("side"))


def _first_tiles(members: DataFrame, wide: DataFrame, percent: int, first: int) -> DataFrame:
    """(node, root, tiles): a small neighbourhood's one tile, a wide one's two dealings."""
    small = members.join(wide, "comp", "left_anti").select("node", F.col("node").alias("root"), F.array(_entry(F.col("comp"), F.lit(2))).alias("tiles"))
    deals = F.explode(F.array(*[F.struct(F.lit(k).alias("deal"), _band(percent, k / 2).alias("band")) for k in range(2)]))
    twice = members.join(wide, "comp", "left_semi").select("node", "comp", "n", deals.alias("d")).select("node", "comp", "n", "d.deal", "d.band")
    sizes = twice.groupBy("comp", "deal", "band").agg(F.ceil(_volume() / first).alias("m"))
    name = F.concat_ws(":", "comp", "deal", "band", F.pmod(F.xxhash64("node", "deal"), F.col("m")))
    large = twice.join(sizes, ["comp", "deal", "band"]).groupBy("node").agg(F.collect_list(_entry(name, F.lit(2))).alias("tiles"))
    return small.unionByName(large.select("node", F.col("node").alias("root"), "tiles"))


def _rest_tiles(apart: DataFrame, percent: int, tile: int, first: int) -> DataFrame:
    """(node, root, tiles) for nodes (node, comp, n, root, main, rest) of neighbourhoods that hold several components.

    A band has tiles of nodes outside the neighbourhood's main component, then tiles of
    those inside, as small as ``rest``, the volume outside, lets them be without dealing
    more than that.  Each pair of tiles of a band or of adjacent bands meets, except for
    two of the latter kind.
    """
    banded = apart.withColumn("band", _band(percent, 0))
    volume = lambda main: F.coalesce(F.sum(F.when(F.col("main") == main, F.col("n") + ROW)), F.lit(0))
    tiles = lambda main: F.ceil(volume(main) / (F.least(F.lit(tile), F.greatest(F.lit(first), F.first("rest"))) if main else tile)).cast("int")
    bands = stage(banded.groupBy("comp", "band").agg(tiles(False).alias("r"), tiles(True).alias("s")), "join-bands")
    at = lambda name, shift: bands.select("comp", (F.col("band") + shift).alias("band"), F.struct("r", "s").alias(name))
    # Adjacent bands seen from a band: the one above has its number less one.
    wide = banded.join(at("own", 0), ["comp", "band"]).join(at("up", -1), ["comp", "band"], "left").join(at("down", 1), ["comp", "band"], "left")
    i = F.when(F.col("main"), F.col("own.r") + F.pmod(F.xxhash64("node"), F.col("own.s"))).otherwise(F.pmod(F.xxhash64("node"), F.col("own.r"))).cast("int")
    name = lambda b1, i1, b2, i2: F.concat_ws(":", F.col("comp"), b1, i1, b2, i2)

    def others(of: str) -> Column:
        """Tiles of a band that a node's tile meets."""
        count = F.when(F.col("main"), F.col(f"{of}.r")).otherwise(F.col(f"{of}.r") + F.col(f"{of}.s"))
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    band = F.col("band")
    own = F.transform(others("own"), lambda j: _entry(name(band, F.least(i, j), band, F.greatest(i, j)), F.when(j == i, 2).when(i < j, 0).otherwise(1)))
    above = F.transform(others("up"), lambda j: _entry(name(band, i, band + 1, j), F.lit(0)))
    below = F.transform(others("down"), lambda j: _entry(name(band - 1, j, band, i), F.lit(1)))
    return wide.select("node", "root", F.concat(own, above, below).alias("tiles")).filter(F.size("tiles") > 0)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, tile: int = TILE, first: int = FIRST, exact: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable by links), key, root.

    ``key`` tells rows that repeat an id but not the text apart.  ``root`` is one value for
    the rows of a component, also where components share an id; null for an empty set.
    ``exact`` finds neighbourhoods by prefix keys, which can miss no link.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("key", doc_key(F.col("doc_id"), F.col("_text")))
    n, n_keys, least = docs.count(), 64 if exact else n_bands(percent), parts_of(docs)
    sketches = in_arrow(rows, _sketch(size, percent, exact), "doc_id long, key long, hi long, lo long, n int, keys array<long>")
    sketches = stage(sketches, "join-sketches", rows=n, width=48 + 8 * n_keys, least=least)
    row_of = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))  # an id where there is one, the least
    classes = sketches.filter("n > 0").groupBy("hi", "lo").agg(row_of.alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = stage(classes.select("hi", "lo", F.col("row.doc_id").alias("least"), F.col("row.key").alias("key"), "n", "keys").withColumn("node", F.monotonically_increasing_id()), "join-nodes", rows=n, width=48 + 8 * n_keys)

    keyed = nodes.select("node", F.explode("keys").alias("k"))
    hubs = stage(keyed.groupBy("k").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub != last").select("k", "hub"), "join-hubs", rows=n * n_keys // 2)
    hoods = connected_components(star_edges(keyed.join(hubs, "k").select("node", "hub"), "node", "hub"), "join-hoods", 2 * n)
    unstage(hubs)

    members = stage(nodes.select("node", "hi", "lo", "least", "key", "n").join(hoods.select("node", F.col("root").alias("comp")), "node"), "join-members", rows=n, width=64)
    unstage(hoods)
    wide = members.groupBy("comp").agg(_volume().alias("volume")).filter(F.col("volume") > first).select("comp")

    own = members.select("node", "hi", "lo", "key", F.col("least").alias("_least"))
    # Both sides go by key whatever their sizes, so that the plan is one at every size.
    texts = rows.join(own.hint("merge"), (rows["key"] == own["key"]) & F.col("doc_id").eqNullSafe(F.col("_least"))).select("_text", "node", "hi", "lo")
    shingles = members.agg(F.sum("n")).first()[0] or 0
    sets = stage(in_arrow(texts, _sets_of_nodes(size), "node long, data binary"), "join-sets", rows=shingles, width=8, least=least)

    def forest(placed: DataFrame) -> DataFrame:
        """Links in the tiles of (node, root, tiles)."""
        dealt = sets.join(placed, "node").select("node", "root", "data", F.explode("tiles").alias("t")).select("t.tile", "t.side", "node", "root", "data")
        return stage(in_arrow(dealt.repartition("tile").sortWithinPartitions("tile", "node"), _link(percent), "a long, b long"), "join-forest")

    links = forest(_first_tiles(members.select("node", "comp", "n"), wide, percent, first))
    linked = connected_components(links, "join-links", n)
    whole = members.select("node", "comp", "n").join(wide, "comp", "left_semi").join(linked, "node", "left").select("node", "comp", "n", F.coalesce("root", "node").alias("root"))
    parted = whole.groupBy("comp", "root").agg(_volume().alias("volume")).groupBy("comp").agg(F.max(F.struct("volume", "root")).alias("top"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("roots"))
    parted = stage(parted.filter("roots > 1").select("comp", F.col("top.root").alias("top"), (F.col("volume") - F.col("top.volume")).alias("rest")), "join-parted", rows=n)
    if not parted.isEmpty():
        apart = stage(whole.join(parted, "comp").select("node", "comp", "n", "root", (F.col("root") == F.col("top")).alias("main"), "rest"), "join-apart", rows=n, width=48)
        linked = connected_components(links.unionByName(forest(_rest_tiles(apart, percent, tile, first))), "join-links", n)

    placed = stage(linked.join(nodes.select("node", "least"), "node"), "join-linked", rows=n)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.select("node", "root").join(named, "root")
    found = nodes.select("node", "hi", "lo", "least").join(known, "node", "left").select("hi", "lo", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "node").alias("root"))
    found = stage(found, "join-classes", rows=n, width=40)
    unstage(placed, links, linked, nodes, sets)
    out = sketches.select("doc_id", "key", "hi", "lo", F.col("n").cast("long").alias("n_shingles")).join(found, ["hi", "lo"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "key", "root")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with their columns, whose id names their component: one of each.

    Of rows that repeat an id one stays for each component: linked rows are one document,
    others aren't.  Rows without words are copies only if they repeat a row.  Rows without an
    id in a component that has no id can't be told apart, and stay.
    """
    found = jaccard_components(docs, id_col, text_col, size, percent)
    own_key, own_id, g_id, g_key, root, place = unused(docs, "key", "id", "g_id", "g_key", "root", "place")
    gone = found.filter(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(g_id), F.col("key").alias(g_key)).distinct()
    own = docs.withColumns({own_id: F.col(id_col).cast("bigint"), own_key: doc_key(F.col(id_col).cast("bigint"), F.col(text_col))})
    left = own.join(gone, F.col(own_id).eqNullSafe(F.col(g_id)) & (F.col(own_key) == F.col(g_key)), "left_anti")
    repeats = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias(g_id)).count().filter("count > 1")
    if not repeats.isEmpty():
        of_row = found.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias(g_id), F.col("key").alias(g_key), F.col("root").alias(root)).distinct()
        known = left.filter(F.col(own_id).isNotNull()).join(of_row, (F.col(own_id) == F.col(g_id)) & (F.col(own_key) == F.col(g_key)))
        own_text = F.when(F.col(root).isNull(), F.col(own_key))
        known = known.withColumn(place, F.row_number().over(Window.partitionBy(own_id, root, own_text).orderBy(own_key))).filter(F.col(place) == 1).drop(place, root, g_id, g_key)
        left = known.unionByName(left.filter(F.col(own_id).isNull()))
    return compact(left.drop(own_id, own_key), docs)
