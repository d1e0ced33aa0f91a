"""The pipeline's stages against versions without Spark, each on its own input."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tagsim.llm import similar_texts
from tagsim.llm.common import stored
from tagsim.llm.mixing import BLOCK, source_targets
from tagsim.llm.similar_texts import COUNTED, WORDS, _cells, _ladder, _looked, count_grid, crowded_pairs, drop_similar, similar_groups, tables, wide_fingerprint
from tests.helpers import SMALL
from tests.llm.test_native import plain_counts
from tests.llm.test_near import grouped
from tests.llm.test_tokens import BYTES, check_packed, plain_words, spark_hash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def key(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})


def sketch(text) -> list[int]:
    words = [spark_hash([w]) for w in plain_words((text or "").translate({i: i + 32 for i in range(65, 91)}))]
    found = {spark_hash(words[i : i + 5]) for i in range(len(words) - 4)}
    if 0 < len(words) < 5:
        h = 0
        for w in words:
            h = spark_hash([h, w])
        found = {h}
    return sorted(found)[:32]


def plain_groups(texts: list) -> dict:
    """The text, by its hash, for which each text counts."""
    own = {t: (spark_hash([t]), sketch(t)) for t in set(texts)}
    first: dict = {}
    for t, (unit, least) in own.items():
        for m in meetings(least):
            first[m] = min(first.get(m, (unit, least)), (unit, least))
    near = {}
    for t, (unit, least) in own.items():
        for other, theirs in (first[m] for m in meetings(least)):
            both = sorted({*least, *theirs})[:32]
            if other != unit and len(set(both) & set(least) & set(theirs)) >= 0.8 * len(both):
                near[unit] = min(near.get(unit, other), other)
    return {t: near.get(near.get(u, u), near.get(u, u)) for t, (u, _) in own.items()}


def meetings(least: list[int]) -> list:
    return [*least[:4], *[(n, *least[:n]) for n in (3, 6)]] if least else []


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), f"test_{name}")
        out.append(docs)
    return [d.collect() for d in out]


def test_all_but_the_last_stage_return_documents(steps):
    for rows in steps[:-1]:
        assert list(rows[0].asDict()) == COLUMNS and all(r["n_chars"] == len(r["text"] or "") for r in rows)


def test_quality_stage_keeps_what_a_plain_version_keeps(steps):
    """Base rules; lines of more than 2% of the host's documents and groups of near copies, five groups at least; depletion."""
    rows = steps[0]
    of = plain_groups([r["text"] for r in rows])
    group = {r["doc_id"]: of[r["text"]] for r in rows}
    in_docs, in_groups, host_docs, host_groups = defaultdict(set), defaultdict(set), Counter(), defaultdict(set)
    for r in rows:
        host_docs[r["source"]] += 1
        host_groups[r["source"]].add(group[r["doc_id"]])
        for line in (r["text"] or "").split("\n"):
            in_docs[(r["source"], key(line))].add(r["doc_id"])
            in_groups[(r["source"], key(line))].add(group[r["doc_id"]])
    expected = {}
    for r in rows:
        n, _, _, _, repeated = plain_counts(r["text"])
        if n < 10 or 100 * repeated > 20 * n:
            continue
        h, kept = r["source"], []
        for line in (r["text"] or "").split("\n"):
            k = (h, key(line))
            if not (k[1] and len(in_groups[k]) >= 5 and len(in_docs[k]) > 0.02 * host_docs[h] and len(in_groups[k]) > 0.02 * len(host_groups[h])):
                kept.append(line)
        left = plain_counts("\n".join(kept))[0]
        if not (left < n and (left < 10 or left < 0.5 * n)):
            expected[r["doc_id"]] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in steps[1]} == expected


def test_quality_stage_drops_the_lines_of_small_hosts(spark):
    def own(i: int, n: int) -> str:
        return " ".join(f"own{i}word{k}" for k in range(n))

    footer = " ".join(f"footer{k}" for k in range(12))
    near = "\n".join(" ".join(f"near{k}word{i}" for i in range(60)) for k in range(12))
    data = [(i, f"{own(i, 60)}\n{footer}", "small") for i in range(11)] + [(20, f"{own(20, 8)}\n{footer}", "small"), (30, f"{own(30, 60)}\n{footer}", "other")]
    data += [(100 + i, f"{near} {i}", "small") for i in range(15)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_stage(spark, docs, SMALL).collect()}
    # 20 is depleted; near copies count as one text and keep their lines
    assert got == {i: own(i, 60) for i in range(11)} | {i: t for i, t, _ in data if i >= 30}


def test_line_stage_drops_frequent_lines_but_the_first(steps):
    seen, first, group = defaultdict(set), {}, plain_groups([r["text"] for r in steps[1]])
    for r in sorted(steps[1]):
        for pos, line in enumerate(r["text"].split("\n")):
            seen[key(line)].add(group[r["text"]])
            first.setdefault(key(line), (r["doc_id"], pos))
    expected = {r["doc_id"]: "\n".join(x for pos, x in enumerate(r["text"].split("\n")) if not key(x) or len(seen[key(x)]) < 10 or first[key(x)] == (r["doc_id"], pos)) for r in steps[1]}
    assert {r["doc_id"]: r["text"] for r in steps[2]} == expected and len(steps[2]) == len(steps[1])
    assert any(len(s) >= 10 for s in seen.values())


def test_one_full_text_of_a_large_group_of_copies_stays(spark):
    text = "\n".join(" ".join(f"line{k}word{i}" for i in range(60)) for k in range(8))
    near = "\n".join(" ".join(f"near{k}word{i}" for i in range(60)) for k in range(12))
    data = [(i, text) for i in range(12)] + [(100 + i, f"{near} {i}") for i in range(12)]
    # a line of ten different documents goes, in copies as elsewhere
    data += [(200 + i, " ".join(f"own{i}word{k}" for k in range(60)) + "\nall rights reserved") for i in range(10)] + [(300 + i, text + "\nall rights reserved") for i in range(2)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    lines = stored(corpus_pipeline.line_stage(spark, docs, SMALL), "test_copies")
    assert [r["doc_id"] for r in lines.collect() if "rights" in r["text"]] == [200]
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_copy_stage(spark, lines, SMALL).collect()}
    assert [i for i, t in kept.items() if t == text] == [0]
    assert {i: t for i, t in kept.items() if 100 <= i < 200} == {100: f"{near} 0"}
    assert len(kept) == 12


@pytest.mark.parametrize("n", [15, 30])
def test_pages_that_share_most_lines_are_no_copies_and_lose_them(spark, n):
    """20 shared and 4 own lines of 12 words each: a similarity of about 0.69."""
    def words(name):
        return " ".join(f"{name}w{k}" for k in range(12))

    shared = [words(f"shared{k}") for k in range(20)]
    data = [(i, "\n".join([*shared[:10], *[words(f"own{i}x{k}") for k in range(4)], *shared[10:]])) for i in range(n)]
    # near copies: a word of each differs, in any line
    base = [[f"base{k}w{j}" for j in range(12)] for k in range(24)]
    copies = [(1000 + i, "\n".join(" ".join(f"edit{i}" if (k, j) == (i % 24, i % 12) else w for j, w in enumerate(line)) for k, line in enumerate(base))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data + copies], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs, SMALL).collect()}
    assert got[0] == data[0][1] and all(got[i].count("\n") == 3 for i in range(1, n))
    assert all(got[i] == t for i, t in copies)


def plain_shingles(text: str | None) -> set:
    words = plain_words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similar(a: set, b: set, s: float = 0.8) -> bool:
    return a == b or len(a & b) >= s * len(a | b)


def test_near_copy_stage_keeps_one_of_each_group(steps):
    """Of all pairs at a similarity of 0.8 or more of five-word shingles."""
    sets = {r["doc_id"]: plain_shingles(r["text"]) for r in steps[2]}
    group = grouped(sets, [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])])
    assert sorted(steps[3]) == sorted(r for r in steps[2] if group[r["doc_id"]] == r["doc_id"])


def test_similar_groups_against_all_pairs(spark):
    """A group of near copies larger than a cell may be without pivots, chains of edits, short texts, unrelated texts. Links are never wrong, and
    few pairs in a hundred may be missed."""
    draw = random.Random(3)

    def edited(words: list[str], n: int) -> list[str]:
        out = list(words)
        for i in draw.sample(range(len(out)), n):
            out[i] = f"new{draw.random()}"
        return out

    base = [[f"b{k}w{draw.randrange(400)}" for _ in range(200)] for k in range(30)]
    data = [edited(base[0], draw.randrange(1, 4)) for _ in range(150)] + [edited(b, n) for b in base[1:] for n in (0, 1, 2, 3, 4, 5, 6)]
    data += [[f"s{i % 7}", *(f"t{k}" for k in range(i % 9))] for i in range(60)] + [[]]
    texts = [" ".join(w) for w in data]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar_groups(docs).collect()}
    sets = [plain_shingles(t) for t in texts]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if similar(sets[a], sets[b])]
    whole = grouped(range(len(sets)), pairs)
    assert all(whole[i] == whole[got[i]] for i in got)
    assert all(got[i] == 0 for i in range(150))
    assert sum(got[a] != got[b] for a, b in pairs) <= 0.02 * len(pairs) and len(pairs) > 5000


@pytest.mark.parametrize("n", [2_000, 10**7, 10**9])
def test_tables_for_any_number_of_texts_find_pairs_of_just_the_similarity(n):
    """Pairs of 180 shingles each, 160 of them shared."""
    grid, draw, found = tables(n, 0.8), np.random.default_rng(n), 0
    for _ in range(600):
        own = np.unique(draw.integers(0, 1 << 63, 400, dtype=np.uint64))[:200]
        draw.shuffle(own)
        a, b = (wide_fingerprint(np.sort(h)) for h in (own[:180], own[20:]))
        found += any((int(a[w]) ^ int(b[w])) & m % (1 << 64) == 0 for w, m in grid)
    assert found >= 0.95 * 600


def test_a_large_group_just_less_alike_makes_few_candidates(spark, monkeypatch):
    """300 texts of a similarity of about 0.7 to each other, and 40 of them with a copy of a few edits: what is checked does not grow with the group's square."""
    draw = np.random.default_rng(5)
    base = [f"base{i}" for i in range(200)]
    texts = []
    for k in range(300):
        own = list(base)
        for i in draw.choice(200, 8, replace=False):
            own[i] = f"own{k}x{i}"
        texts.append(own)
    texts += [[*t[:100], f"copy{k}", *t[101:]] for k, t in enumerate(texts[:40])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    checked, real = [], similar_texts.stored

    def counted(df, name):
        table = real(df, name)
        if name == "similar_candidates":
            checked.append(table.count())
        return table

    monkeypatch.setattr(similar_texts, "stored", counted)
    got = {r["doc_id"]: r["component_id"] for r in similar_groups(docs).collect()}
    sets = [plain_shingles(" ".join(t)) for t in texts]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if similar(sets[a], sets[b])]
    assert 40 <= len(pairs) < 200 and got == grouped(range(len(sets)), pairs)
    assert sum(checked) < 10 * len(texts)


def test_crowded_pairs_hold_all_similar_ones(spark):
    """Of random sets around a few centres, with components of some: no similar pair of two components is left out."""
    draw, sets = np.random.default_rng(9), []
    for centre in range(3):
        core = draw.integers(0, 1 << 62, int(draw.integers(10, 120)))
        for _ in range(60):
            some = core[draw.random(len(core)) > draw.choice([0.0, 0.05, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([some, draw.integers(0, 1 << 62, int(draw.integers(0, 12)))])).tolist())
    part = {k: k - k % 7 for k in range(0, len(sets), 3)}
    table = spark.createDataFrame([(bytes([k]), x) for k, x in enumerate(sets)], "node binary, hashes array<long>")
    parts = spark.createDataFrame([(bytes([k]), bytes([c])) for k, c in part.items()], "node binary, component binary")
    found = [tuple(sorted((r["a"][0], r["b"][0]))) for r in crowded_pairs(table, parts, 0.8).collect()]
    plain = [set(x) for x in sets]
    asked = {(a, b) for b in range(len(sets)) for a in range(b) if similar(plain[a], plain[b]) and part.get(a, a) != part.get(b, b)}
    assert len(found) == len(set(found)) and asked <= set(found) and len(asked) > 500


def meets(table, a, b) -> bool:
    """Whether two fingerprints agree in the table's equal bits, and the counts of its segments lie within Manhattan distance 1."""
    x, y = (int(f[table.word]) for f in (a, b))
    apart = sum(abs((x & m % (1 << 64)).bit_count() - (y & m % (1 << 64)).bit_count()) for m in table.segments)
    return (x ^ y) & table.mask % (1 << 64) == 0 and apart <= 1


@pytest.mark.parametrize("n", [2_000, 10**7, 10**9])
def test_counts_of_segments_find_pairs_of_just_the_similarity(n):
    grid, draw, found = count_grid(n, 0.8), np.random.default_rng(n), 0
    for _ in range(600):
        own = np.unique(draw.integers(0, 1 << 63, 400, dtype=np.uint64))[:200]
        draw.shuffle(own)
        a, b = (wide_fingerprint(np.sort(h)) for h in (own[:180], own[20:]))
        found += any(meets(t, a, b) for t in grid)
    assert found >= 0.95 * 600 and all(len(t.segments) == COUNTED for t in grid)


def test_cells_one_step_up_join_what_lies_within_manhattan_distance_1(spark):
    """Each pair and table once, from one side or the other, and equal counts from both."""
    grid, draw = count_grid(2_000, 0.8)[:3], np.random.default_rng(2)
    start = draw.integers(0, 1 << 63, WORDS, dtype=np.uint64)
    fps = [start ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, (3, WORDS)).astype(np.uint64), axis=0) for _ in range(60)]
    items = spark.createDataFrame([(bytes([i]), *f.view(np.int64).tolist()) for i, f in enumerate(fps)], "node binary, f0 long, f1 long, f2 long, f3 long")
    homes = _cells(items, grid)
    met = _looked(homes).selectExpr("node AS a", "cell", "step").join(homes.selectExpr("node AS b", "cell"), "cell").filter("a != b AND (step > 0 OR a > b)")
    expected = Counter((i, j) for t in grid for j in range(60) for i in range(j) if meets(t, fps[i], fps[j]))
    assert Counter(tuple(sorted((r["a"][0], r["b"][0]))) for r in met.collect()) == expected and len(expected) > 100


def test_ladders_differ_by_the_manhattan_distance_of_counts(spark):
    every = [[k // 3**i % 3 for i in range(COUNTED)] for k in range(3**COUNTED)]
    packed = [(k, sum(c << 2 * i for i, c in enumerate(x))) for k, x in enumerate(every)]
    ladder = {r["k"]: r["l"] for r in spark.createDataFrame(packed, "k int, counts int").select("k", _ladder(F.col("counts")).alias("l")).collect()}
    assert all((ladder[i] ^ ladder[j]).bit_count() == sum(abs(x - y) for x, y in zip(a, b, strict=True)) for i, a in enumerate(every) for j, b in enumerate(every))


def test_unrelated_texts_do_not_make_cells_crowded(spark, monkeypatch):
    """15,000 random fingerprints, near the most for a table's bits: those of a table's fullest cells are more than CROWDED, and none of them goes to the shingles."""
    fps = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, (15_000, WORDS))
    items = spark.createDataFrame([(i.to_bytes(16, "big"), 100, *map(int, f)) for i, f in enumerate(fps)], "node binary, n long, f0 long, f1 long, f2 long, f3 long")
    crowded, real = [], similar_texts.stored

    def seen(df, name):
        table = real(df, name)
        if name == "similar_crowded":
            crowded.append(table.count())
        return table

    monkeypatch.setattr(similar_texts, "stored", seen)
    links = similar_texts.similar_links(items, lambda nodes: nodes.withColumn("text", F.lit("a b c d e")))
    assert crowded == [0] and links.count() == 0
    full = _cells(items, count_grid(15_000, 0.8)).groupBy("cell").count().agg(F.max("count")).first()[0]
    assert full > similar_texts.CROWDED


def test_texts_just_less_alike_in_shared_shingles_are_not_checked(spark):
    """Sets of 100 of 120 shingles, all common to many sets, share 83 in the mean: parities tell that."""
    draw = np.random.default_rng(11)
    core = draw.integers(0, 1 << 62, 120)
    sets = [(bytes([k]), sorted(draw.choice(core, 100, replace=False).tolist())) for k in range(120)]
    table = spark.createDataFrame(sets, "node binary, hashes array<long>")
    parts = spark.createDataFrame([], "node binary, component binary")
    found = {(r["a"][0], r["b"][0]) for r in crowded_pairs(table, parts, 0.8).collect()}
    asked = {(a, b) for a in range(120) for b in range(a) if similar(set(sets[a][1]), set(sets[b][1]))}
    assert asked <= found and len(found) < 120 * 119 / 2 / 2


def test_similar_groups_of_odd_rows(spark):
    body = " ".join(f"word{i}" for i in range(40))
    rows = [(5, None), (3, ""), (None, body), (7, body.upper()), (7, body.upper()), (9, f"{body} more"), (11, "one two"), (12, "one two three")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, node int")
    got = similar_groups(docs)
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got.collect()) == [(0, 7, False), (3, 3, True), (5, 3, False), (7, 7, True), (7, 7, True), (9, 7, False), (11, 11, True), (12, 12, True)]
    kept = drop_similar(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 11, 12]
    assert similar_groups(docs.limit(0)).count() == 0 and drop_similar(docs.limit(0)).count() == 0


def test_mixing_stage_takes_each_source_near_its_target(steps):
    size, taken, by = Counter(), Counter(), defaultdict(list)
    before = {r["doc_id"]: r for r in steps[3]}
    for r in steps[3]:
        size[r["source"]] += len(plain_words(r["text"]))
    for r in steps[4]:
        taken[r["source"]] += len(plain_words(r["text"]))
        by[r["doc_id"]].append(plain_words(r["text"]))
        assert (r["lang"], r["source"]) == (before[r["doc_id"]]["lang"], before[r["doc_id"]]["source"])
    for source, target in zip(sorted(size), source_targets([size[s] for s in sorted(size)]), strict=True):
        assert abs(taken[source] - target) <= 2 * BLOCK
    for doc_id, rounds in by.items():
        words = Counter(plain_words(before[doc_id]["text"]))
        assert len(rounds) <= 3 and all(not Counter(r) - words for r in rounds)


def test_packing_stage_packs_every_document(steps):
    check_packed(steps[5], [(r["doc_id"], r["text"]) for r in steps[4]], {BYTES: Tokenizer.from_file(BYTES)})


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, columns whose names the operators use, and no rows at all."""
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(1, body, "en", "a", 5), (1, body, "en", "a", 5), (None, f"{body} x", None, None, None), (2, None, None, "a", None), (3, "", "en", "b", 0), (4, " ".join(f"w{i} w{i + 1}" for i in range(40)), "en", None, 1)]
    extra = "kept_text string, n_dropped int, spans array<int>, key string, drops double, row_key long, doc string, copies int"
    docs = spark.createDataFrame([(*r, "own", 77, [1], "k", 0.5, 6, "d", 3) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    for some in (docs, docs.limit(0)):
        now = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stored(stage(spark, now, SMALL), f"odd_{name}")
            assert now.columns == docs.columns
            assert all((r["kept_text"], r["n_dropped"], r["spans"], r["key"], r["doc"]) == ("own", 77, [1], "k", "d") for r in now.collect())
        assert (now.count() > 0) == (some is docs)
        assert stage_rows(spark, now) == sum(1 for _ in now.collect())
    quality, lines, near = (corpus_pipeline.STAGES[k][1](spark, docs, SMALL).collect() for k in range(3))
    assert sorted((r["doc_id"] or 0) for r in quality) == [0, 1, 1, 4] and len(lines) == 6
    assert sorted((r["doc_id"] or 0, r["text"] is None) for r in near) == [(1, False), (2, True), (4, False)]


def stage_rows(spark, docs) -> int:
    return corpus_pipeline.packing_stage(spark, docs, SMALL).filter("piece = 0").count()


def test_stages_take_very_long_texts(spark):
    """Texts of 200,000 different words, of one word of 2,000,000 letters and of 30,000 lines; the second one is a near copy of the first."""
    words = [f"w{i}" for i in range(200_000)]
    lines = "\n".join(f"l{i} a{i} b{i} c{i}" for i in range(30_000))
    texts = [" ".join(words), " ".join([*words[:100_000], "changed", *words[100_001:]]), "y" * 2_000_000 + " and a few words that follow the very long one here", lines]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stored(stage(spark, docs, SMALL), f"test_long_{name}")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {i: t for i, t in enumerate(texts) if i != 1}
    mixed = stored(corpus_pipeline.mixing_stage(spark, docs, SMALL), "test_long_mixed")
    packed = corpus_pipeline.packing_stage(spark, mixed, SMALL).collect()
    assert packed and max(r["length"] for r in packed) <= 2048 and before.count() == 4


def test_run_gives_the_last_stages_rows(spark, steps):
    keep = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[c] for c in keep) for r in corpus_pipeline.run(spark, SMALL).collect()) == Counter(tuple(r[c] for c in keep) for r in steps[5])
