"""Spelling variants against all pairs of words."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagsim.llm import spelling
from tagsim.llm.spelling import _group_near, near_words, spelling_groups, typed_words

SCHEMA = "doc_id long, text string"


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_pairs(counts: dict[str, int], ratio: int = 2) -> list[tuple]:
    near = {w: sorted((-counts[v], v) for v in counts if one_edit(w, v)) for w in counts}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= ratio * counts[w] else None for w in counts}
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def plain_words(docs: list[tuple], typo: int = 97) -> Counter:
    found: Counter = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[run if h % typo else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return found


def got(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def letters(alphabet: str, low: int, high: int):
    return st.text(st.sampled_from(alphabet), min_size=low, max_size=high)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(letters("abÀ", 1, 5), st.integers(1, 5), max_size=30))
def test_groups_of_rotations_hold_each_near_pair_once(counts):
    """The scan's groups, made in Python, against all pairs."""
    words, groups = sorted(counts), {}
    for uid, w in enumerate(words):
        for i in range(len(w)):
            groups.setdefault(w[i + 1 :] + "\0" + w[:i], []).append(("", w[i], i == 0 or w[i] != w[i - 1], uid, counts[w]))
        for i in range(len(w) + 1):
            groups.setdefault(w[i:] + "\0" + w[:i], []).append(("", "", True, uid, counts[w]))
    n, best = Counter(), {}
    for members in groups.values():
        assert len({m[1] for m in members}) == len(members)
        for uid, count, top, other in _group_near(members):
            n[words[uid]] += count
            best[words[uid]] = min(best.get(words[uid], (0, 0)), (-top, other))
    for w in words:
        near = sorted((-counts[v], words.index(v)) for v in words if one_edit(w, v))
        assert n[w] == len(near) and best.get(w) == (near[0] if near else None)


@pytest.mark.parametrize("seed", [1, 2])
def test_words_forms_and_roots_are_those_of_all_pairs(spark, seed, monkeypatch):
    import random

    monkeypatch.setattr(spelling, "HELD", 50)
    draw = random.Random(seed)
    base = ["".join(draw.choice("abeÀß") for _ in range(draw.randint(5, 7))) for _ in range(60)]
    variants = [w[:i] + draw.choice(["", "x", w[i] * 2]) + w[i + 1 :] for w in base for i in (draw.randrange(len(w)),)]
    text = [(i, " ".join(draw.choices(base * 4 + variants + ["É" * 9], k=draw.randint(0, 300)))) for i in range(60)]
    # chains of words, each twice as frequent as the one before
    text += [(100, " ".join(" ".join(["zzzz" + "q" * k] * 3 * 2**k) for k in range(1, 7)))]
    text += [(101, None), (None, "ABABA ababa ABABA"), (102, ""), (103, "12 .. 45"), text[0]]
    want = all_pairs({w: n for w, n in plain_words(text).items() if len(w) >= 5 and n >= 3})
    assert sum(f is not None for _, f, *_ in want) > 10 and any(r != f and f for _, f, r, *_ in want)
    df = spark.createDataFrame(text, SCHEMA).selectExpr("text", "doc_id", "'w' AS word", "1 AS n", "2 AS root", "3 AS uid")
    for n in (1, 7):
        assert got(spelling_groups(df.repartition(n))) == want


def test_very_long_texts_and_words(spark):
    word = "ab" * 700
    text = [(1, " ".join([word] * 6 + [word + "c"] * 3 + [word[:300] + "x" + word[301:]] * 3)), (2, "hello " * 300_000 + "hallo " * 100_000 + "y" * 2_000_000)]
    want = all_pairs({w: n for w, n in plain_words(text).items() if len(w) >= 5 and n >= 3})
    assert len(want) >= 5 and got(spelling_groups(spark.createDataFrame(text, SCHEMA))) == want


def test_pieces_cut_no_run(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "Some words, and aVeryLongRunOfLetters1234567890; ends " * 5
    assert typed_words(3, text, re.compile(spelling.RUN)) == plain_words([(3, text)])


def test_empty_tables(spark):
    empty = spelling_groups(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(spelling_groups(spark.createDataFrame([(1, None), (2, "")], SCHEMA))) == []
    assert near_words(spark.createDataFrame([], "uid long, word string, n long")).count() == 0
    with pytest.raises(ValueError, match="twice"):
        spelling_groups(spark.createDataFrame([], SCHEMA), ratio=1)
