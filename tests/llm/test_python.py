"""The remaining operators: against libraries, plain versions, round trips and held-out labels."""

import collections
import math
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import backoff, byte_bpe, langid, line_crf, ngram_join, quotes, token_shards
from tidewell.llm.common import may_learn
from tidewell.llm.components import connected_components
from tidewell.llm.queries import oracle_sql, queries


def read(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


# ---- byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    import tiktoken

    ranks = byte_bpe.read_ranks(read("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.ByteBPE(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aeiou nst'\n\t 12.,é中", max_size=200), st.text("ab", min_size=60, max_size=300)))
def test_bpe_is_the_librarys(bpe, text):
    own, library = bpe
    ids = own.encode_texts([text])[0]
    assert ids == library.encode_ordinary(text) and own.decode(ids) == text.encode()
    piece = text.encode()[:90]
    if piece:
        assert own.encode_piece(piece) == np.frombuffer(own.encode_pieces([piece])[0], "<i4").tolist()


def test_bpe_frames(odd, odd_rows, none, bpe):
    ranks = read("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.decode(byte_bpe.encode(odd, ranks, public_tokenizers.PATTERN), ranks).collect()
    want = [(i, bpe[1].encode_ordinary(t or ""), (t or "").encode()) for i, t in odd_rows]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in out), key=str) == sorted(want, key=str)
    once = byte_bpe.round_trip(odd, ranks, public_tokenizers.PATTERN).collect()
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in once), key=str) == sorted(want, key=str)
    assert byte_bpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0


# ---- token shards


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    ids = np.random.default_rng(1).integers(0, 2**32, 1003, dtype=np.uint64).astype(np.uint32)
    assert (token_shards.from_planes(token_shards.to_planes(ids, bits), len(ids)) == ids).all()
    lengths = np.array([3, 0, 1000])
    keys, counts, back = token_shards.read_shard(token_shards.write_shard([1, None, -5], lengths, ids, bits, block=100))
    assert keys == [1, None, -5] and counts.tolist() == lengths.tolist() and (back == ids).all()
    with pytest.raises(ValueError):
        token_shards.read_shard(b"nope" + bytes(40))


@pytest.mark.parametrize(("shard_ids", "bits"), [(4_000_000, False), (50, True)])
def test_shards_hold_the_librarys_ids(odd, odd_rows, none, shard_ids, bits, tmp_path):
    from tokenizers import Tokenizer

    model = read("word_bpe_49k.json")
    library = Tokenizer.from_str(model.decode())
    shards = token_shards.write_shards(odd, model, 2, bits=bits, shard_ids=shard_ids)
    got = sorted(((r.start, r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in token_shards.read_shards(shards).collect()), key=lambda r: r[0])
    assert [r[1] for r in got] == sorted((i for i, _ in odd_rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for start, _, n, ids in got:
        assert start == at and n == len(ids) and ids[-1] == 2
        at += n
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in odd_rows)
    assert sorted((str(r[1]), r[3]) for r in got) == want
    assert token_shards.export_files(shards, str(tmp_path / "f")) == len(list((tmp_path / "f").iterdir())) > 0
    assert token_shards.write_shards(none, model, 2).count() == 0


def test_word_encoder_with_a_small_cache(monkeypatch):
    from tokenizers import Tokenizer

    model = read("word_bpe_49k.json")
    library, own = Tokenizer.from_str(model.decode()), token_shards.WordEncoder(model)
    monkeypatch.setattr(token_shards, "CACHE", 20)
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdXYZ éßİıǅ'.,;!?<|>019\t\n中Σςσ́\x85-_*", k=rng.randint(0, 50))) for _ in range(300)] + ["<|ENDOFTEXT|> a<|endoftext|>b", "don't we'll x's.", "a\x01b \x01 c \x01\x01", "</w> x</w>y", "naïve straße œuvre ĳ ſ", "x" * 500 + " " + "é" * 300 + "!?"]
    for a in range(0, len(texts), 50):
        lengths, ids = own.encode(pa.array(texts[a : a + 50]), 2)
        at = 0
        for text, n in zip(texts[a : a + 50], lengths, strict=True):
            assert ids[at : at + n].tolist() == library.encode(text, add_special_tokens=False).ids + [2]
            at += n


def test_word_encoder_composes_before_it_folds_case():
    from tokenizers import Tokenizer

    model = read("word_bpe_49k.json")
    library = Tokenizer.from_str(model.decode())
    texts = ["H\u0331a J\u030cb T\u0308 T\u0344x W\u030a Y\u030a The THE the É E\u0301", "plain Words", "<|endoftext|> H\u0331 Other"]
    for some in (texts, texts[:2], texts[::-1]):  # whatever shares the batch
        lengths, ids = token_shards.WordEncoder(model).encode(pa.array(some), 2)
        ends = np.cumsum(lengths)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)] == [library.encode(t, add_special_tokens=False).ids + [2] for t in some]


@pytest.fixture
def uncoalesced(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_rows_of_one_id_are_dealt_over_partitions(spark, uncoalesced):
    model = read("word_bpe_49k.json")
    rows = [(None if k % 3 else k, f"text {k % 700} of many" if k % 2 else "the same") for k in range(6000)]
    shards = token_shards.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), model, 2)
    per_part = [r["n"] for r in shards.groupBy("part").agg({"n_docs": "sum"}).withColumnRenamed("sum(n_docs)", "n").collect()]
    assert sum(per_part) == 6000 and max(per_part) <= 2500
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in token_shards.read_shards(shards).collect()), key=lambda r: r[0])
    assert [i for _, i, _ in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert all(a + n == b for (a, _, n), (b, _, _) in zip(got, got[1:], strict=False))


def test_shard_query(spark, sf):
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_str(read("word_bpe_49k.json").decode()), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries()["op10_token_shards"](spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = library.encode(row.text, add_special_tokens=False).ids + [2]
        assert got[row.doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# ---- n-gram Jaccard join


def joined(df, **options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, **options).collect()), key=str)


@pytest.mark.parametrize("tile", [2_000_000, 40])
def test_join_odd(odd, odd_rows, tile):
    if tile == 40:  # very small tiles: without the very long texts
        odd, odd_rows = odd.filter("doc_id is null or doc_id not in (10, 11, 12)"), [r for r in odd_rows if r[0] not in (10, 11, 12)]
    assert joined(odd, tile=tile) == sorted(brute.near(odd_rows), key=str)


@pytest.mark.parametrize("tile", [2_000_000, 150])
def test_join_random_copies(spark, tile):
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 60))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"v{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(words[: len(words) - rng.randint(0, 2)] or words)))
    rng.shuffle(rows)
    assert joined(spark.createDataFrame(rows, "doc_id int, text string"), tile=tile) == sorted(brute.near(rows), key=str)


def test_join_threshold_is_inclusive(spark):
    words = [f"w{k}" for k in range(40)]  # 37 shingles
    for extra in range(4, 9):
        rows = [(1, " ".join(words)), (2, " ".join([*words, *(f"x{k}" for k in range(extra))]))]
        assert joined(spark.createDataFrame(rows, "doc_id int, text string")) == sorted(brute.near(rows), key=str)


def test_join_empty_and_survivors(odd, odd_rows, none):
    assert ngram_join.jaccard_components(none).count() == 0
    kept = ngram_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    one = {i for i, _, c in brute.near(odd_rows) if i is not None and i == c}
    got = sorted(((str(r.doc_id), r.text) for r in kept.collect()), key=str)
    assert {i for i, _ in got} == {str(i) for i in one} | {"None"}
    assert [t for i, t in got if i == "8"] == [] and [t for i, t in got if i == "None"] == ["no id here", None]
    assert [t for i, t in got if i == "9"] == ["one two three", "three two one"] and len(got) == len(one) + 3


def test_join_recall_on_pairs_at_the_threshold(spark):
    """Every pair is just over the threshold, where neighbourhoods are likeliest to miss one."""
    rng, rows = random.Random(21), []
    for k in range(1500):
        n = rng.choice([7, 8, 13, 20, 60, 150])
        words = [f"p{k}w{j}" for j in range(n + 3)]  # n shingles
        more = n * 100 // 85 - n  # shingles that one more text may have
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, *(f"p{k}x{j}" for j in range(more))]))]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    for exact in (False, True):
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df, exact=exact).collect()}
        assert sum(got[2 * k + 1] == 2 * k for k in range(1500)) == 1500


def test_join_of_a_group_of_thousands(spark):
    """Near copies of one text, of which many pairs don't link, and texts near the group that aren't in it."""
    rng, base = random.Random(22), [f"w{j}" for j in range(60)]
    rows = []
    for k in range(3000):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(5000 + k, " ".join(base[: 42 + k] + [f"u{k}{j}" for j in range(9)])) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    want = sorted(brute.near(rows), key=str)
    assert len({c for _, _, c in want}) > 1
    for options in ({}, {"first": 3000, "tile": 5000}, {"first": 3000, "exact": True}):
        assert joined(df, **options) == want


def test_survivors_of_a_repeated_id(spark, odd):
    assert sorted(r.text for r in ngram_join.keep_one_of_each(odd).collect() if r.doc_id == 9) == ["one two three", "three two one"]
    words = [f"w{k}" for k in range(60)]
    near = [" ".join(words), " ".join([*words, "more"])]
    rows = [(5, near[0]), (5, near[1]), (5, near[0]), (5, "another text"), (5, None), (5, " "), (5, " "), (6, near[0]), (7, "another text")]
    kept = ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == {5}
    texts = [r.text for r in kept]
    assert len(texts) == 4 and {"another text", None, " "} < set(texts) and len(set(texts) & set(near)) == 1


def test_join_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries()["op6_jaccard"](spark, sf).collect()}
    assert got == {i: (n, c) for i, n, c in brute.near(rows)}


def test_link_tile_bound_never_hides_a_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[: 60 - k], rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in (0, 2, 4, 5, 8)]
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in ngram_join.link_tile(list(range(len(sets))), sets, [2] * len(sets)):
        parent[find(a)] = find(b)
    for a in range(len(sets)):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                assert find(a) == find(b)


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(1, 60)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(20)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for node, root in got.items():
        seen, todo = {node}, [node]
        while todo:
            for other in near[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        assert root == min(seen)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- language identification


def test_bloom_masks_hold_all_languages():
    rng = np.random.default_rng(0)
    members = {f"l{k:02d}": rng.integers(0, 2**63, 50, dtype=np.uint64) for k in range(70)}  # over one word of bits
    model = langid.LanguageFilter.build(members)
    for k, name in enumerate(sorted(members)):
        assert ((model.masks(members[name])[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()
    other = model.masks(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    rate = ((other[0] >> np.uint64(3)) & np.uint64(1)).mean()
    assert abs(rate - model.false_rate[3]) < 0.01


def test_grams_by_hand():
    assert len(langid.grams(["Ab c"], 3)[0]) == len({" ab", "ab ", " c "})
    assert langid.grams(["", "12 !"], 3)[2].tolist() == [False, False]
    a, owner, some = langid.grams(["abc", None or "", "ABC", "a-bc"], 3)
    assert some.tolist() == [True, False, True, True] and a[owner == 0].tolist() == a[owner == 2].tolist() != a[owner == 3].tolist()


def test_language_query_by_plain_sets(spark, sf):
    """The same rule with n-grams as strings in sets of each language: a Bloom filter may only blur the shares a little."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()

    def grams(text):
        chars = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        chars = " ".join(chars.split())
        chars = f" {chars} " if chars else ""
        return [g for k in range(len(chars) - 3) if " " not in (g := chars[k : k + 4])[1:3]]

    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts[r.lang].update(grams(r.text))
    counts = {lang: {g: n for g, n in c.items() if n > 2} for lang, c in counts.items()}
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    most = collections.defaultdict(float)
    for c in share.values():
        for g, x in c.items():
            most[g] = max(most[g], x)
    own = {lang: {g for g, x in c.items() if x >= langid.RELATIVE * most[g]} for lang, c in share.items()}
    assert max(map(len, own.values())) <= langid.PER_LANGUAGE
    got = {r.doc_id: r for r in queries()["op7_language"](spark, sf).collect()}
    differ = 0
    for r in rows:
        found = grams(r.text)
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        hits = {lang: sum(g in s for g in found) / max(1, len(found)) for lang, s in own.items()}
        best = max(sorted(hits), key=hits.get)
        differ += got[r.doc_id].lang_pred != best
        assert abs(got[r.doc_id].score - hits[got[r.doc_id].lang_pred]) <= 0.03
    assert differ <= 0.01 * len(rows)


def test_language_held_out(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries()["op7_language"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    from pyspark.sql import functions as F

    model = langid.learn(docs, may_learn(F.col("doc_id")))
    out = langid.identify(odd, model).collect()
    assert len(out) == odd.count()
    for r in out:
        assert (r.lang_pred == "und") == (r.doc_id in (4, 5, 6, 13) or (r.doc_id is None and r.score == 0))
    assert langid.identify(none, model).count() == 0
    nothing = langid.learn(docs.limit(0), may_learn(F.col("doc_id")))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    kept = langid.keep_identified(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5


# ---- line CRF


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    texts = ["aa bb\ncc\nDD!! EE", "one", "x y z\n\nx y z\nx### y###\nq", ""]
    bins, _, per_text = line_crf.line_features(texts)
    model = line_crf.LineCRF.blank()
    model.weights[:] = rng.normal(size=len(model.weights))
    model.pairs[:] = rng.normal(size=(2, 2))
    features = line_crf._neighbours(bins, per_text)
    got, pairs = model.marginals(features, per_text, want_pairs=True)
    unary, a, want, sums = model.weights[features].sum(axis=1), 0, [], np.zeros((2, 2))
    for n in per_text.tolist():
        z, good, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n if n else 0):
            y = [(code >> k) & 1 for k in range(n)]
            p = math.exp(sum(unary[a + k] * y[k] for k in range(n)) + sum(model.pairs[y[k], y[k + 1]] for k in range(n - 1)))
            z += p
            good += p * np.array(y)
            for k in range(n - 1):
                both[y[k], y[k + 1]] += p
        want += (good / z).tolist() if n else []
        sums += both / z if n else 0
        a += n
    assert np.allclose(got, want) and np.allclose(pairs, sums)


def test_quality_held_out(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    got = queries()["op4_quality"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    model = line_crf.LineCRF.blank()
    out = line_crf.score(odd, model).collect()
    assert len(out) == odd.count() and all(r.score == model.empty for r in out if r.doc_id in (4, 5, 6))
    assert line_crf.score(none, model).count() == 0
    from pyspark.sql import functions as F

    assert line_crf.learn(none, spark.createDataFrame([], "doc_id long, quality int"), may_learn(F.col("doc_id"))).slope == 1.0


def plain_quality(text, model):
    """The score of a text by counting, with the model's weights: features, forward-backward and the weighted mean line by line."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    if not lines:
        return model.empty
    seen, values = collections.Counter(), []
    for line in lines:
        raw, words = line.encode("utf-8"), line.split()
        kinds = [sum(65 <= b <= 90 for b in raw), sum(48 <= b <= 57 for b in raw), sum(chr(b) in "#$%&*+/<=>@\\^_`{|}~" for b in raw), sum(chr(b) in "!?.,;:()[]-\"'" for b in raw), sum(b >= 128 for b in raw)]
        adjacent = sum(a == b for a, b in zip(words, words[1:], strict=False))
        values.append([*(k / len(raw) for k in kinds), 1 - len(set(words)) / len(words), adjacent / len(words), (len(line) + 1) / len(words) - 1, len(words), seen[line]])
        seen[line] += 1
    bins = [[sum(v > e for e in edges) for v, edges in zip(row, line_crf.BINS.values(), strict=True)] for row in values]
    block = len(line_crf.BINS) * 8 + 1

    def weight(k):
        total = 0.0
        for part, j in ((0, k), (1, k - 1), (2, k + 1)):
            if 0 <= j < len(bins):
                total += sum(model.weights[part * block + f * 8 + b + 1] for f, b in enumerate(bins[j]))
            else:
                total += len(bins[0]) * model.weights[part * block]
        return total

    unary, n = [(0.0, weight(k)) for k in range(len(lines))], len(lines)
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    forward, backward = [unary[0]], [(0.0, 0.0)] * n
    for k in range(1, n):
        forward.append(tuple(unary[k][y] + add(*(forward[-1][x] + model.pairs[x, y] for x in (0, 1))) for y in (0, 1)))
    for k in range(n - 2, -1, -1):
        backward[k] = tuple(add(*(unary[k + 1][y] + backward[k + 1][y] + model.pairs[x, y] for y in (0, 1))) for x in (0, 1))
    good = [1 / (1 + math.exp(min(500, max(-500, f[0] + b[0] - f[1] - b[1])))) for f, b in zip(forward, backward, strict=True)]
    quality = sum(g * len(x) for g, x in zip(good, lines, strict=True)) / sum(map(len, lines))
    return 1 / (1 + math.exp(-(model.slope * math.log((quality + 1e-4) / (1 - quality + 1e-4)) + model.shift)))


def test_quality_query_by_counting(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = line_crf.learn(docs, labels, may_learn(F.col("doc_id")))
    again = line_crf.learn(docs.repartition(7), labels.repartition(3), may_learn(F.col("doc_id")))
    assert (model.weights == again.weights).all() and (model.pairs == again.pairs).all() and (model.slope, model.shift, model.empty) == (again.slope, again.shift, again.empty)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries()["op4_quality"](spark, sf).collect():
        assert abs(r.score - plain_quality(texts[r.doc_id], model)) < 1e-9
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7)


def test_quality_of_empty_texts_is_learned(spark):
    from pyspark.sql import functions as F

    rows = [(k, "good words here" if k % 2 else "#### @@@@ $$$$") for k in range(40)] + [(100 + k, " ") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for label in (0, 1):
        labels = spark.createDataFrame([(k, k % 2 if k < 100 else label) for k, _ in rows], "doc_id long, quality int")
        assert (line_crf.learn(docs, labels, F.lit(True)).empty >= 0.7) == bool(label)


# ---- stupid backoff


def plain_scores(rows):
    texts = [[w for w in brute.SPACE.split((t or "").translate(brute.UPPER)) if w] for _, t in rows]
    ones = collections.Counter(w for ws in texts for w in ws)
    twos = collections.Counter(p for ws in texts for p in zip([None, *ws], ws, strict=False))
    tokens, starts = sum(ones.values()), sum(bool(ws) for ws in texts)
    out = []
    for (doc_id, _), ws in zip(rows, texts, strict=True):
        total = 0
        for p in zip([None, *ws], ws, strict=False):
            s = twos[p] / (starts if p[0] is None else ones[p[0]]) if twos[p] >= 2 else 0.4 * ones[p[1]] / tokens
            total += round(math.log(s) * 1e6)
        out.append((doc_id, len(ws), total / 1e6))
    return out


@pytest.mark.parametrize("tile", [2_000_000, 5000, 50])
def test_backoff_odd(odd, odd_rows, tile):
    got = backoff.score(odd, tile=tile).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.score, 6)) for r in got), key=str) == sorted(((i, n, round(s, 6)) for i, n, s in plain_scores(odd_rows)), key=str)


def test_backoff_empty(none):
    assert backoff.score(none).count() == 0


def test_backoff_counts_rare_words_of_large_corpora(spark):
    rows = [(i, "a b c d " * 1200) for i in range(250)] + [(1000, "rare words once"), (1001, "gibberish a b twice"), (1002, "twice a twice")]
    got = backoff.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_scores(rows)
    assert sum(n for _, n, _ in want) > 1 << 20  # where a vocabulary of 2^20 would pool them
    assert sorted((r.doc_id, r.n_words, round(r.score, 6)) for r in got) == sorted((i, n, round(s, 6)) for i, n, s in want)


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    columns = [np.sort(rng.integers(0, 2**63, 100, dtype=np.uint64)), rng.integers(-5, 9, 100), rng.integers(0, 2**40, 100)]
    back = backoff.unpack(backoff.pack(columns), 3)
    assert all((a.astype(np.int64) == b.astype(np.int64)).all() for a, b in zip(columns, back, strict=True))


def test_backoff_query_sql(spark, sf, same_rows):
    same_rows(queries()["op1_lm_score"](spark, sf), oracle_sql()["op1_lm_score"])


# ---- quotation linking


def plain_links(rows):
    """{(conv, turn, level, whole text): source} and {(conv, turn): reply_to} of messages with distinct turns, by searching."""
    links, reply, confirmed = {}, {}, set()
    for conv in {r[0] for r in rows}:
        parsed = {r[1]: quotes.parse(r[3] or "") for r in rows if r[0] == conv}
        own = {t: {text for _, text in quotes.units(lines)} for t, (_, lines, _) in parsed.items()}
        quoted = {t: {(level, text) for _, level, lines in ps for kind, text in quotes.units(lines) if kind == quotes.WHOLE} for t, (_, _, ps) in parsed.items()}

        def source(lines, bound):
            for kind in (quotes.WHOLE, quotes.PARAGRAPH, quotes.PART):
                votes = collections.Counter()
                for k, text in quotes.units(lines):
                    before = [t for t in own if t < bound and text in own[t]]
                    if k == kind and before:
                        votes[max(before)] += len(text)
                if votes:
                    return max(votes, key=lambda t: (votes[t], t))
            return None

        for turn, (_, _, passages) in parsed.items():
            votes = collections.Counter()
            for level in (1, 2):
                for _, k, lines in passages:
                    if min(k, 2) == level:
                        found, whole = source(lines, turn if k == 1 else reply.get((conv, turn)) or turn), quotes.units(lines)[0][1]
                        links[conv, turn, k, whole] = found
                        if k == 1 and found is not None:
                            votes[found] += len(whole)
                        if k > 1 and (k - 1, whole) in quoted.get(reply.get((conv, turn)), ()):
                            confirmed.add((conv, turn, k, whole))
                reply[conv, turn] = max(votes, key=lambda t: (votes[t], t)) if votes else None
    return links, reply, confirmed


def plain_order(rows):
    """{(conv, turn): (reply_to, place)} by a depth-first walk."""
    out, reply = {}, plain_links(rows)[1]
    for conv in {r[0] for r in rows}:
        turns = sorted(r[1] for r in rows if r[0] == conv)
        children = collections.defaultdict(list)
        for k, t in enumerate(turns[1:], 1):
            to = reply[conv, t]
            children[to if to is not None else turns[k - 1]].append(t)
        stack, place = [turns[0]], 0
        while stack:
            t = stack.pop()
            out[conv, t] = (reply[conv, t], place)
            place += 1
            stack += sorted(children[t], reverse=True)
    return out


def test_parse():
    text, own, quoted = quotes.parse("Hi\n\nOn Monday Ada wrote:\n> first *line*\n> \n> more\n>> deeper\n> > also deep\nanswer")
    assert text == "Hi\n\nanswer" and own == ["Hi", "", "", "", "answer"]
    assert quoted == [(0, 1, ["first *line*", "", "more"]), (1, 2, ["deeper", "also deep"])]
    assert quotes.units(quoted[0][2]) == [(0, "first *line* more"), (1, "first *line"), (2, "first *line"), (1, "more"), (2, "more")]
    assert quotes.parse("a > b")[2] == [] and quotes.parse("")[0] == "" and quotes.parse("> \n> !!")[2] == []


def random_conversations(rng, convs, most):
    """Messages that quote whole texts, paragraphs or sentences, rewrapped and nested, and common short lines."""
    rows = []
    for conv in range(convs):
        said = []
        for turn in range(rng.randint(1, most)):
            own = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(2, 12))) + rng.choice([".", "!", ""]) for _ in range(rng.randint(1, 3))]
            if rng.random() < 0.4:
                own.insert(rng.randint(0, len(own)), rng.choice(["thanks", "Thanks!", "ok"]))
            head = []
            if said and rng.random() < 0.6:
                old, quotation = rng.choice(said)
                taken = old if rng.random() < 0.5 else [rng.choice(old)]
                words = "\n\n".join(taken).upper() if rng.random() < 0.5 else "\n".join(taken)
                if rng.random() < 0.4:  # rewrapped
                    words = words.replace(" ", "\n", 1)
                head = ["> " + x for x in words.split("\n")]
                if quotation and rng.random() < 0.6:
                    head = [("> " if x[0] != ">" else ">") + x for x in quotation] + head
            elif rng.random() < 0.3:
                head = [f"> nobody said {turn}", "> at all"]
            said.append((own, head))
            body = (rng.choice(["\n\n", "\n"])).join(own)
            rows.append((conv, turn, "user", "\n".join([*head, body] if rng.random() < 0.7 else [body, *head]), 1))
    return rows


def test_reply_order_random(spark):
    rng = random.Random(8)
    rows = random_conversations(rng, 8, 25)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seg int").repartition(5)
    want, (links, _, confirmed) = plain_order(rows), plain_links(rows)
    assert len({k for *_, k, _ in links}) > 2 and any(v is None for v in links.values()) and confirmed
    found = quotes.link_quotations(df)[1].collect()
    codes = {(*key[:3], *quotes._code(key[3])): (v, key in confirmed) for key, v in links.items()}
    assert {(r.conv_id, r.turn, r.level, r.hi, r.lo): (r.source, bool(r.confirmed)) for r in found} == codes
    out, got = quotes.reply_order(df), collections.defaultdict(list)
    for r in out.orderBy("conv_id", "order_key").collect():
        assert r.reply_to == want[r.conv_id, r.turn][0] and ">" not in r.text
        got[r.conv_id].append(r.turn)
    for conv, turns in got.items():
        assert turns == sorted(turns, key=lambda t: want[conv, t][1])


def test_a_deep_thread_takes_few_rounds(spark, monkeypatch):
    """Each message quotes the one two before it, so that every one begins a branch."""
    rows = [(7, t, "user", f"message number {t}" if t < 2 else f"> message number {t - 2}\nmessage number {t}") for t in range(2000)]
    rows += [(8, t, "user", "thanks" if t % 2 else "> thanks\nwell") for t in range(400)]
    rounds = []
    monkeypatch.setattr(quotes, "stage", lambda df, tag, f=quotes.stage, **more: rounds.append(tag) or f(df, tag, **more))
    out = quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "order_key").collect()
    assert rounds.count("quotes-arcs") <= 14
    want = plain_order(rows)
    assert [(r.conv_id, r.turn) for r in out] == sorted(want, key=lambda k: (k[0], want[k][1]))
    assert all(r.reply_to == want[r.conv_id, r.turn][0] for r in out)


def test_carried_over_partitions(spark, uncoalesced):
    rng = random.Random(12)
    rows = [(rng.randint(0, 3), k, rng.choice([None, None, None, None, k * 10])) for k in range(3000)] + [(9, k, 5 if k == 0 else None) for k in range(2000)]
    want, last = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[:2]):
        want[g, k] = last.get(g)
        last[g] = v if v is not None else last.get(g)
    df = spark.createDataFrame(rows, "g long, k long, v long").repartition(4)
    got = quotes.carried(df, ["g"], ["k"], df["v"], "x").collect()
    assert {(r.g, r.k): r.x for r in got} == want


def test_reply_order_odd(spark):
    rows = [(1, 0, "user", None), (None, None, "user", "x"), (2, 1, "a", "> unknown"), (2, 1, "a", "> unknown"), (2, None, None, ""), (3, 0, "u", "> " * 5 + "x\n" * 3000)]
    out = quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((str(r.conv_id), str(r.turn), r.n_quoted, r.n_linked) for r in out.collect()) == [("1", "0", 0, 0), ("2", "1", 1, 0), ("2", "1", 1, 0), ("2", "None", 0, 0), ("3", "0", 1, 0), ("None", "None", 0, 0)]
    assert quotes.reply_order(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert quotes.chat_lines(out).filter("line is null").count() == 0


def test_conversation_query_by_searching(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    links, reply, _ = plain_links(rows)
    place = plain_order(rows)
    got = queries()["op3_chat_format"](spark, sf).collect()
    assert {(r.conv_id, r.turn): (r.reply_to, r.n_quoted) for r in got} == {k: (v, sum(x[:2] == k for x in links)) for k, v in reply.items()}
    order = sorted(got, key=lambda r: (r.conv_id, r.branch, r.turn))
    assert [(r.conv_id, r.turn) for r in order] == sorted(place, key=lambda k: (k[0], place[k][1]))


def test_conversation_query_keeps_every_message(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    out = queries()["op3_chat_format"](spark, sf)
    assert out.select("conv_id", "turn", "role", "text").exceptAll(table.select("conv_id", "turn", "role", "text")).count() == 0 and out.count() == table.count()
