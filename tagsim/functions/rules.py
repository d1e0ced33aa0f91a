"""Texts to tags by substring rules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of up to this many keywords are compiled into the plan; a larger dictionary goes to the workers as one automaton.
MAX_KEYWORDS = 500


def matches_any(lowered: Column, keywords: list[str]) -> Column:
    """True if any keyword is a substring, literally and as it stands, of a text that is in lower case already."""
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(k)) for k in keywords], F.lit(False))


def rule_list(rules: DataFrame) -> list[tuple[str, list[str]]]:
    """The tags in order of the dictionary, with their keywords. A dictionary is written by people, so the driver holds it."""
    by: dict[tuple[int, str], list[str]] = {}
    for r in rules.select("tag", "pos", "keyword").collect():
        by.setdefault((r["pos"], r["tag"]), []).append(r["keyword"])
    return [(tag, keywords) for (_, tag), keywords in sorted(by.items())]


def _by_automaton(df: DataFrame, listed: list[tuple[str, list[str]]], lowered: str, out: str) -> DataFrame:
    """All keywords are looked for in one pass over each text; the time does not grow with the dictionary."""
    kept = [c for c in df.columns if c not in (lowered, out)]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    tags = [tag for tag, _ in listed]
    always = {i for i, (_, keywords) in enumerate(listed) if "" in keywords}

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        of: dict[str, set[int]] = {}
        for i, (_, keywords) in enumerate(listed):
            for k in keywords:
                if k:
                    of.setdefault(k, set()).add(i)
        automaton = ahocorasick.Automaton()
        for k, numbers in of.items():
            automaton.add_word(k, tuple(numbers))
        automaton.make_automaton()
        for batch in batches:
            found = []
            for text in batch.column(lowered):
                hit = set(always)
                for _, numbers in automaton.iter(text.as_py()) if of else ():
                    hit.update(numbers)
                found.append([tags[i] for i in sorted(hit)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.list_(pa.string()))], names=[*kept, out])

    return df.mapInArrow(tag, ", ".join(f"`{c}` {types[c]}" for c in kept) + f", `{out}` array<string>")


def infer_tags(df: DataFrame, rules: DataFrame, text_col: str = "text", out: str = "tags") -> DataFrame:
    """df with the tags of its text, in the dictionary's order. Null and empty texts have none (but tags with an empty keyword). One map
    stage, no shuffle."""
    lowered = "__lowered"
    listed = rule_list(rules)
    if not listed:
        return df.withColumn(out, F.array().cast("array<string>"))
    # the text is lowered once, before its many uses
    own = df.withColumn(lowered, F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    if sum(len(keywords) for _, keywords in listed) > MAX_KEYWORDS:
        return _by_automaton(own, listed, lowered, out)
    tags = F.array_compact(F.array(*[F.when(matches_any(F.col(lowered), keywords), F.lit(tag)) for tag, keywords in listed]))
    return own.withColumn(out, tags).drop(lowered)
