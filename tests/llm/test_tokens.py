"""Ids, counts, files, packing, mixing and substring dedup against the library on whole texts and versions without Spark."""

from __future__ import annotations

import binascii
import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagsim.llm import common, mixing, packing, queries, substring_dedup, token_files
from tagsim.llm.mixing import document_blocks, mix_sources, mix_texts, permuted, shard_counts, source_targets
from tagsim.llm.packing import Packing, cut_lengths, nnls, pack_documents, packed_sequences
from tagsim.llm.substring_dedup import op8_substring_dedup
from tagsim.llm.token_counts import token_counts
from tagsim.llm.token_files import PerfectHash, find, keys_of, pack_index, pack_shard, read_token_files, write_token_files
from tagsim.llm.tokens import count_tokens, encode_bytes
from tests.helpers import SMALL

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "It's  I'LL 've\tx_y__ 12ab3 ½ ² ٣", "a<|endoftext|>b <|startoftext|>", "é é ﬁ İ ı ẞ Σας", "日本語 😀‍", "x y z\x1cw\x85v", "\r\n \t x", "¿Qué? «Ça» ‘q’ …–", "z" * 3000, "<|", "'s't", "  double  spaces   ", "\x00\x7f"]


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def texts_of(spark) -> list:
    return [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]


def test_pieces_give_the_librarys_ids(spark, library):
    texts = [t or "" for t in ODD + texts_of(spark)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode_bytes(texts, BYTES)] == [e.ids for e in library[BYTES].encode_batch(texts, add_special_tokens=False)]
    assert count_tokens(texts, WORDS) == [len(e) for e in library[WORDS].encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r'’_-.,19éßÿ×÷ĳŉªº½<|>"), st.characters(max_codepoint=0x250, exclude_categories=["Cs"])), max_size=40))
def test_any_text_gives_the_librarys_ids(text):
    whole = Tokenizer.from_file(BYTES) if not hasattr(test_any_text_gives_the_librarys_ids, "t") else test_any_text_gives_the_librarys_ids.t
    test_any_text_gives_the_librarys_ids.t = whole
    words = Tokenizer.from_file(WORDS) if not hasattr(test_any_text_gives_the_librarys_ids, "w") else test_any_text_gives_the_librarys_ids.w
    test_any_text_gives_the_librarys_ids.w = words
    assert np.frombuffer(encode_bytes([text], BYTES)[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert count_tokens([text], WORDS) == [len(words.encode(text, add_special_tokens=False).ids)]


@pytest.mark.parametrize("huge,overlap", [(64, 4), (300, 40), (32_768, 256)])
def test_token_counts(spark, library, huge, overlap):
    texts = ODD + ["a b <|endoftext|> c" * 90, "no" * 2000 + " white space " + "x" * 500, "Σας é́ " * 300] + texts_of(spark)[:40]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(0, None, 7), (None, "é " * 900, 7), (None, "é " * 900, 7)], "doc_id long, text string, n_tokens int")
    got = token_counts(docs, WORDS, huge=huge, overlap=overlap)
    rows = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()), key=repr)
    n = [len(library[WORDS].encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()]
    assert rows == sorted(((r["doc_id"], len((r["text"] or "").encode()), k, k > 2048) for r, k in zip(docs.collect(), n, strict=True)), key=repr)
    assert token_counts(docs.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 65, 3000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    index = PerfectHash.of(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(n))


def test_index_finds_its_keys_only():
    keys = keys_of(pa.array([None, *range(499)]), np.zeros(500))
    data = pack_index(keys, {"n": np.arange(500), "shard": np.arange(500) * 3})
    there, slots = find(data, keys)
    assert there.all() and slots["n"].tolist() == list(range(500)) and slots["shard"].tolist() == [3 * i for i in range(500)]
    strange = keys_of(pa.array(range(500, 900)), np.zeros(400))
    assert find(data, strange)[0].sum() <= 1 and find(data, keys_of(pa.array([5, None]), np.ones(2)))[0].sum() <= 1
    assert pack_shard([np.array([70_000], "<u4").tobytes()])[1] == 4 and pack_shard([np.array([7], "<u4").tobytes(), b""])[1] == 2


def test_token_files_round_trip(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "TASK_DOCS", 40)
    monkeypatch.setattr(token_files, "INDEX_KEYS", 50)
    monkeypatch.setattr(token_files, "START_TASKS", 2)
    texts = ODD + texts_of(spark)[:120]
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)] + [(1000, "again"), (1000, "again"), (None, "no id"), (None, None), (0, "zero"), (-(2**63), "least")] + [(5, f"many {i % 7}") for i in range(90)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    folder = str(tmp_path / "ids")
    write_token_files(docs, BYTES, folder, shard_ids=5000)
    # the reader has the folder and the ids, nothing else
    asked = spark.createDataFrame([(i,) for i in sorted({r[0] for r in rows}, key=str)] + [(10**12,)], "doc_id long")
    got = read_token_files(asked, folder).collect()
    at, expected = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, spark_hash([r[1] or ""]), r[1] or "")):
        ids = library[BYTES].encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((doc_id, at, len(ids), binascii.crc32(np.array(ids, "<u4").tobytes()), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    found = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got), key=lambda r: r[1])
    assert found == expected
    turns = defaultdict(list)
    for r in sorted(got, key=lambda r: r["start"]):
        turns[r["doc_id"]].append(r["turn"])
    assert all(t == list(range(len(t))) for t in turns.values()) and len(turns[5]) == 90
    names = [p.name for p in (tmp_path / "ids").iterdir()]
    assert sum(n.startswith("shard") for n in names) > 3 and sum(n.startswith("index") for n in names) > 3
    assert not [n for n in names if n.startswith(".") and not n.endswith(".crc")]
    assert read_token_files(asked.limit(0), folder).count() == 0
    write_token_files(docs.limit(0), BYTES, str(tmp_path / "none"))
    assert [p.name for p in (tmp_path / "none").iterdir()] == ["layout"]
    assert read_token_files(asked, str(tmp_path / "none")).count() == 0


def test_token_files_query(spark, library):
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_token_files"](spark, SMALL).collect()}
    at = 0
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array(library[BYTES].encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (at, len(ids), binascii.crc32(ids.tobytes()))
        at += len(ids)


def test_token_counts_query(spark, library, tmp_path):
    """On the small table, and on one with huge documents, against the library on whole texts."""
    texts = texts_of(spark)[:20]
    long = [" ".join(texts) * 3, "é́ ﬁ " * 20_000, "x" * 50_000, "日本 語 " * 12_000, None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts + long)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for folder in (SMALL, str(tmp_path)):
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.QUERIES["op7_token_counts"](spark, folder).collect()}
        expected = {}
        for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
            n = len(library[WORDS].encode(r["text"] or "", add_special_tokens=False).ids)
            expected[r["doc_id"]] = (len((r["text"] or "").encode()), n, n > 2048)
        assert got == expected


def test_nnls():
    a = np.random.default_rng(1).random((12, 30))
    x = np.zeros(30)
    x[[3, 7, 20]] = [1.0, 2.0, 3.0]
    got = nnls(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6


def best_fit_decreasing(histogram: dict, capacity: int) -> int:
    rooms: list[int] = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            best = min((r for r in rooms if r >= n), default=None)
            if best is not None:
                rooms.remove(best)
            rooms.append((best if best is not None else capacity) - n)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=40))
def test_packing_holds_every_piece_once_and_wastes_little(histogram):
    plan = Packing(histogram, 64, 16)
    held: Counter = Counter()
    for count, lengths in plan.groups():
        assert count > 0 and sum(lengths) <= 64
        for n in lengths:
            held[n] += count
    assert held == Counter(histogram)
    n = sum(c for c, _ in plan.groups())
    assert n <= best_fit_decreasing(histogram, 64) * 1.12 + 1


def test_cut_lengths():
    assert [cut_lengths(n, 10) for n in (1, 10, 11, 20, 25)] == [[1], [10], [1, 10], [10, 10], [5, 10, 10]]


def check_packed(rows, texts: list, library, capacity: int = 2048) -> None:
    """rows: of every piece; texts: (doc_id, text) of every document."""
    expected = Counter()
    for doc_id, text in texts:
        ids, at = np.array(library[BYTES].encode(text or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for piece, n in enumerate(cut_lengths(len(ids), capacity)):
            expected[(doc_id, piece, at, n, binascii.crc32(ids[at : at + n].tobytes()))] += 1
            at += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    bound = -(-sum(r["length"] for r in rows) // capacity)
    assert len(by) <= bound * 1.03 + 2


def test_pack_query_and_odd_rows(spark, library):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_packed(queries.QUERIES["op5_pack"](spark, SMALL).collect(), texts, library)
    odd = [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (None, "x"), (3, "again"), (3, "again"), (900, "many words " * 4000)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in odd], "doc_id long, text string, length int, bucket string")
    packed = packing.stored(pack_documents(docs, BYTES, with_ids=True), "packed")
    check_packed(packed.drop("ids").collect(), odd, library)
    whole = packed_sequences(packed).collect()
    assert sum(r["n_tokens"] for r in whole) == sum(len(r["ids"]) // 4 for r in whole) and all(sum(r["lengths"]) == r["n_tokens"] for r in whole)
    assert pack_documents(docs.limit(0), BYTES).count() == 0


def test_targets():
    assert source_targets([100, 100, 100]) == [300 * 5 / 8, 300 * 2 / 8, 300 / 8]
    got = source_targets([1, 100, 100, 0])
    assert got[0] == 3 and got[3] == 0 and abs(sum(got) - 201) < 1e-9 and all(t <= 3 * s + 1e-9 for t, s in zip(got, [1, 100, 100, 0], strict=True))
    assert source_targets([]) == [] and source_targets([0, 0]) == [0.0, 0.0]


@pytest.mark.parametrize("size", [1, 2, 5, 64, 1000])
def test_permutation(size):
    a, b = permuted(np.arange(size), size, 1), permuted(np.arange(size), size, 2)
    assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(size)) and (size < 5 or (a != b).any())


def test_shards_add_up_to_the_slots():
    slots = np.array([1000, 20, 0, 333])
    n = -(-int(slots.sum()) // 64)
    found = [shard_counts(slots, s, n, 9) for s in range(n)]
    assert sum(c for c, _ in found).tolist() == slots.tolist()
    for s in range(1, n):
        assert (found[s][1] == found[s - 1][1] + found[s - 1][0]).all()
    assert 30 < np.mean([c.sum() for c, _ in found]) < 64
    huge, drawn = np.array([10**12, 5 * 10**11, 10**9]), []
    for seed in range(3):
        halves = [shard_counts(huge, s, 2, seed)[0] for s in range(2)]
        assert (halves[0] + halves[1] == huge).all()
        drawn.append(halves[0].tolist())
    assert len({d[0] for d in drawn}) == len({d[2] for d in drawn}) == 3 and all(abs(d[0] - 5 * 10**11) < 10**7 for d in drawn)


def plain_words(text) -> list:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_mix_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_mix_sources"](spark, SMALL).collect()
    again = queries.QUERIES["op10_mix_sources"](spark, SMALL).collect()
    assert sorted(rows) == sorted(again) and {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    sizes, taken, told = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(plain_words(docs[r["doc_id"]]["text"])) and 0 <= r["taken"] <= 3 * r["size"]
        source = docs[r["doc_id"]]["source"]
        sizes[source] += r["size"]
        taken[source] += r["taken"]
        told[source] = (r["source_size"], r["target"])
    targets = source_targets([sizes[s] for s in sorted(sizes)])
    for s, t in zip(sorted(sizes), targets, strict=True):
        assert told[s][0] == sizes[s] and abs(told[s][1] - t) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= 2 * mixing.BLOCK


def spark_hash(values: list, seed: int = 42) -> int:
    """What Spark's xxhash64 gives for booleans, integers and strings; a null leaves the hash as it is."""
    h = seed
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else int(v).to_bytes(4 if isinstance(v, (bool, np.int32)) else 8, "little", signed=True)
            h = xxhash.xxh64_intdigest(data, h)
    return h - 2**64 if h >> 63 else h


def test_mix_query_takes_what_a_plain_version_takes(spark):
    """Words taken by document: places among the source's words, blocks, draws by shard and permutations, without Spark."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    sized = []
    for r in docs:
        parts = [x for v in (r["doc_id"], r["text"], r["source"]) for x in (v is None, v)]
        key = (spark_hash(parts), spark_hash([np.int32(1), *parts]))
        sized.append((r["source"], key[0] % mixing.BUCKETS, r["doc_id"], key, len(plain_words(r["text"]))))
    names = sorted({r[0] for r in sized})
    total = {s: sum(r[4] for r in sized if r[0] == s) for s in names}
    targets = dict(zip(names, source_targets([total[s] for s in names]), strict=True))
    blocks = {s: -(-total[s] // 256) for s in names}
    slots = np.array([min(3 * blocks[s], round(targets[s] * blocks[s] / total[s])) for s in names])
    n_shards, uses = -(-int(slots.sum()) // mixing.SHARD), Counter()
    for shard in range(n_shards):
        count, before = shard_counts(slots, shard, n_shards, 0)
        for k, s in enumerate(names):
            for turn in range(int(before[k]), int(before[k] + count[k])):
                epoch, index = divmod(turn, blocks[s])
                uses[(s, int(permuted(np.array([index]), blocks[s], mixing._mixed(0, k, epoch))[0]))] += 1
    expected = {}
    for s in names:
        at = 0
        for _, _, doc_id, _, size in sorted(r for r in sized if r[0] == s):
            expected[doc_id] = (size, total[s], targets[s], sum(uses[(s, w // 256)] for w in range(at, at + size)))
            at += size
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in queries.QUERIES["op10_mix_sources"](spark, SMALL).collect()}
    assert got == expected


def rule_targets(sizes: list[int]) -> list[Fraction]:
    """The rule of the targets, written out: weights 5, 2, 1 in turn share the sum of all sizes; a source stops at 3 times its size, and the others share the rest by weight."""
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    stopped: set[int] = set()
    while True:
        rest = Fraction(sum(sizes) - 3 * sum(sizes[i] for i in stopped))
        shared = sum(weight[i] for i in range(len(sizes)) if i not in stopped)
        target = [Fraction(3 * x) if i in stopped else rest * weight[i] / shared for i, x in enumerate(sizes)]
        above = {i for i in range(len(sizes)) if target[i] > 3 * sizes[i]}
        if not above:
            return target
        stopped |= above


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 10**12)), min_size=1, max_size=12))
def test_targets_follow_the_rule(sizes):
    assert source_targets(sizes) == pytest.approx([float(t) for t in rule_targets(sizes)], rel=1e-9, abs=1e-6)


def test_mix_query_has_the_targets_of_the_rule(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    size, source = Counter(), {r["doc_id"]: r["source"] for r in docs}
    for r in docs:
        size[r["source"]] += len(plain_words(r["text"]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, rule_targets([size[s] for s in names]), strict=True))
    taken: Counter = Counter()
    for r in queries.QUERIES["op10_mix_sources"](spark, SMALL).collect():
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(float(want[s])) and r["source_size"] == size[s] and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - float(want[s])) <= 4 * mixing.BLOCK


def test_a_row_that_repeats_is_spread_over_the_buckets(spark):
    """5,000 copies of a row, of null and of real ids: every copy has its place, and no bucket gets more than a few runs of them."""
    n = 5000
    same = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.lit("a").alias("source"))
    docs = same.unionByName(same.withColumn("doc_id", F.lit(7).cast("long"))).unionByName(spark.createDataFrame([(8, "x " * 900, "a"), (9, None, "a"), (10, "y", "b")], "doc_id long, text string, source string"))
    placed = mixing.mix_sources(docs)[0].collect()
    spans = sorted((r["begin"], r["size"]) for r in placed if r["source"] == "a" and r["size"])
    assert len(placed) == 2 * n + 3 and spans[-1][0] + spans[-1][1] == 4 * n + 900 and all(a + s == b for (a, s), (b, _) in zip(spans, spans[1:], strict=False))
    for doc_id in (None, 7):
        assert sorted(r["turn"] for r in placed if r["doc_id"] == doc_id) == list(range(n))
    packed = pack_documents(docs, BYTES).collect()
    assert Counter(r["doc_id"] for r in packed) == Counter({None: n, 7: n, 8: 1, 9: 1, 10: 1})
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + s == b for (a, s), (b, _) in zip(parts, parts[1:], strict=False)) and sum(s for _, s in parts) <= 2048
    assert len(by) <= -(-sum(r["length"] for r in packed) // 2048) * 1.03 + 2
    runs = common.copy_runs(docs.groupBy(*docs.columns).agg(F.count(F.lit(1)).alias("copies"))).collect()
    assert sum(r["copies"] for r in runs) == 2 * n + 3 and max(r["copies"] for r in runs) <= common.RUN and len(runs) == 2 * -(-n // common.RUN) + 3


def test_mix_takes_very_long_texts(spark):
    rows = [(1, " ".join(f"l{i}" for i in range(300_000)), "a"), (2, "x" * 3_000_000, "a"), (3, "short text here", "b"), (4, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, plan, uses = mix_sources(docs)
    assert {(r["doc_id"], r["size"]) for r in placed.collect()} == {(1, 300_000), (2, 1), (3, 3), (4, 0)}
    blocks = {(r["source_no"], r["block"]): r["n"] for r in uses.collect()}
    want = sum(len(range(b * 256, min((b + 1) * 256, 300_001))) * n for (s, b), n in blocks.items() if s == 0) + sum(3 * n for (s, b), n in blocks.items() if s == 1)
    mixed = mix_texts(docs).collect()
    assert sum(len(plain_words(r["text"])) for r in mixed) == want
    assert {r["doc_id"] for r in mixed} <= {1, 2, 3}


def test_mix_texts_keep_columns_of_any_name_and_tell_rows_apart(spark):
    rows = [(1, "a b c", "s", i % 2, None, {"x": 1}) for i in range(6)] + [(2, None, "s", 1, "y", None), (3, "", None, 1, "y", None), (None, "d e", None, 2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, spans int, key string, mix_key map<string, int>")
    mixed = mix_texts(docs, block=4)
    assert mixed.columns == docs.columns and mixed.filter("source IS NULL").count() > 0
    assert {(r["spans"], r["key"]) for r in mixed.filter("doc_id = 1").collect()} <= {(0, None), (1, None)}
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mix_texts(docs.repartition(3), block=4).collect()))
    assert mix_texts(docs.limit(0)).count() == 0


def test_mix_texts_have_the_words_that_the_plan_takes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{i}.{k}" for k in range(int(rng.integers(0, 90)))), "abc"[int(rng.integers(0, 3))] if i % 7 else None) for i in range(120)]
    rows += [(5, "twice the same row", "a"), (5, "twice the same row", "a"), (None, "no id here", "b"), (6, None, "a"), (7, "", "zero")]
    docs = spark.createDataFrame([(*r, "n", 4) for r in rows], "doc_id long, text string, source string, size string, n_chars int")
    placed, plan, uses = mix_sources(docs, block=16, per_shard=8)
    blocks = {(r["source_no"], r["block"]): r["n"] for r in uses.collect()}
    assert max(blocks.values()) <= 3 and plan.count() == sum(blocks.values())
    spans = document_blocks(placed, 16).collect()
    cover = defaultdict(list)
    for r in spans:
        cover[(r["source_no"], r["block"])].append(r["length"])
    assert all(sum(v) <= 16 for v in cover.values()) and sum(map(sum, cover.values())) == sum(len(plain_words(r[1])) for r in rows)
    expected = Counter()
    for r in spans:
        expected[r["doc_id"]] += r["length"] * blocks.get((r["source_no"], r["block"]), 0)
    mixed = mix_texts(docs, block=16)
    assert mixed.columns == docs.columns
    found = Counter()
    for r in mixed.collect():
        words = plain_words(r["text"])
        found[r["doc_id"]] += len(words)
        assert words and r["n_chars"] == len(r["text"])
        if "." in words[0]:
            assert all(w.startswith(f"{r['doc_id']}.") for w in words) and words == sorted(words, key=lambda w: int(w.split(".")[1]))
    # another number of slots to a shard deals the same totals to the sources
    assert sum(found.values()) == sum(expected.values())
    assert mix_texts(docs.limit(0)).count() == 0


def plain_substrings(docs: list[tuple[int, str]], window: int = 20) -> dict:
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        words = text.encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        out[doc_id] = (len(words), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [1 << 16, 50])
def test_substrings(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    passages = [[f"p{k}.{i}" for i in range(int(rng.integers(15, 120)))] for k in range(8)]
    docs = [(0, ""), (1, "a " * 400), (2, "b c " * 100), (3, "\x0b".join("a" * 30)), (4, " ".join(["é x"] * 25))]
    for i in range(10, 60):
        words = [f"w{x}" for x in rng.integers(0, 10**6 if i % 3 else 3, int(rng.integers(0, 80)))]
        for _ in range(int(rng.integers(0, 4))):
            p, at = passages[int(rng.integers(0, 8))], int(rng.integers(0, len(words) + 1))
            low = int(rng.integers(0, len(p)))
            words[at:at] = p[low:] if rng.random() < 0.5 else p
        docs.append((i, " ".join(words)))
    docs += [(100 + i, docs[20 + i][1]) for i in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op8_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == plain_substrings(docs)


def test_substrings_of_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(40))
    docs = spark.createDataFrame([(None, long, 1), (2, long, 1), (2, "other " + long, 1), (2, long, 1), (3, None, 1), (None, None, 1)], "doc_id long, text string, doc int")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.substring_dedup(docs).collect()), key=repr)
    assert got == sorted([(None, 40, 0, long), (2, 40, 40, ""), (2, 40, 40, ""), (2, 41, 40, "other"), (3, 0, 0, ""), (None, 0, 0, "")], key=repr)
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_the_graph_decides_the_spans(spark, monkeypatch):
    """A long passage in two documents is a few spans, as its edges are compacted; edges that are not compacted are a span each; without edges nothing is found."""
    draw = random.Random(8)
    own, passage = [[f"w{draw.randrange(10**9)}" for _ in range(n)] for n in (150, 600)]
    docs = spark.createDataFrame([(1, " ".join(own + passage)), (2, " ".join(passage[:1] + own[:9] + passage)), (3, " ".join(own[::-1]))], "doc long, text string")
    real, found = substring_dedup.unitigs, {}
    changed = {"compacted": real, "apart": lambda e: e.select("doc", "first", "count", F.col("first").alias("unitig")), "none": lambda e: real(e).limit(0)}
    for name, unitigs in changed.items():
        monkeypatch.setattr(substring_dedup, "unitigs", unitigs)
        found[name] = [tuple(s) for r in substring_dedup.repeated_spans(docs).collect() for s in r["spans"]]
    covered = {name: {(w, d, s + w - f) for f, n, d, s in spans for w in range(f, f + n)} for name, spans in found.items()}
    assert covered["compacted"] == covered["apart"] == {(10 + w, 1, 150 + w) for w in range(581)}
    assert len(found["compacted"]) <= 3 and len(found["apart"]) > 30 and found["none"] == []


def test_verification_sees_a_span_that_differs(spark):
    docs = spark.createDataFrame([(1, 1, "a " * 30, 1), (2, 2, "a " * 29 + "b", 1)], "doc long, doc_id long, text string, copies long")
    kind = "doc long, spans array<struct<first: long, count: long, source_doc: long, source: long>>"
    for count, wrong in ((10, 0), (11, 1)):
        spans = spark.createDataFrame([(2, [(0, count, 1, 0)])], kind)
        assert substring_dedup.differing(spans, substring_dedup._cut(docs, spans)) == wrong


def test_differing_spans_lead_to_other_hashes(spark, monkeypatch):
    long, seeds, answers = [" ".join(f"{c}{i}" for i in range(40)) for c in "xy"], [], iter([1, 0])
    real = substring_dedup.repeated_spans
    monkeypatch.setattr(substring_dedup, "repeated_spans", lambda docs, seed: seeds.append(seed) or real(docs, seed))
    monkeypatch.setattr(substring_dedup, "differing", lambda spans, cut: next(answers))
    docs = spark.createDataFrame([(1, long[0]), (2, long[1]), (3, long[1])], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 40} and seeds == [0, 1]


def test_words_are_hashed_as_they_are():
    hasher, rng = substring_dedup.Hasher(3), np.random.default_rng(1)
    texts = ["", " a\tb ", "é 日本\x0b😀", "a", "b" * 700_000 + " a", "x" * 100 + " b", *[" ".join(rng.choice(["a", "bb", "é"], 300)) for _ in range(3)]]
    hashes, begin = hasher.words(pa.array(["skipped", *texts]).slice(1))
    names: dict = {}
    for i, t in enumerate(texts):
        words = t.encode().split()
        assert begin[i + 1] - begin[i] == len(words)
        for w, h in zip(words, hashes[begin[i] : begin[i + 1]].tolist(), strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
