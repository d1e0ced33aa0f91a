"""Ids and token counts by the tokenizers library, a dictionary of pieces at a time.

Both vocabularies used here encode the pieces that their pattern cuts a text into one by one. In a text of plain characters (below)
the pieces are known without the library, so each different piece is encoded once in a worker and kept; any other text is encoded
whole. Tests hold the results against the library's on whole texts."""

from __future__ import annotations

import functools
import re
from array import array

from tokenizers import Tokenizer

#: Latin letters with and without marks; all are letters (\p{L}) and none changes its neighbours when lower-cased.
LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ž"
#: Plain characters: space, tab, line feed and return; printable ASCII; these letters; some punctuation. Neither normalisation nor
#: lower-casing joins any with its neighbours. Special tokens hold |, so a text with <| is not plain.
NOT_PLAIN = re.compile(f"[^\t\n\r\x20-\x7e¡«»¿–—‘’“”…{LETTERS}]|<\\|")
#: The pieces that the byte-level vocabulary's own pattern cuts plain texts into. What stands first is most common; no two of the first
#: four can begin alike but for the space.
PIECE = re.compile(rf" ?[{LETTERS}]+|'(?:[st]|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
#: Pieces that a worker keeps at most; then it starts anew. About 170 MB.
MAX_KEPT = 800_000
#: Characters of texts encoded at once.
BATCH_CHARS = 4_000_000


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints in Latin-1, else one from U+0100 on, in order."""
    prints = {b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)}
    others = iter(range(256))
    return {b: chr(b) if b in prints else chr(256 + next(others)) for b in range(256)}


BYTE_LETTERS = _byte_letters()


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@functools.cache
def _kept(path: str, what: str) -> dict:
    return {}


def _with(kept: dict, pieces: set, encode) -> dict:
    """kept, with all of pieces in it."""
    if len(kept) > MAX_KEPT:
        kept.clear()
    new = list(pieces.difference(kept))
    if new:
        kept.update(zip(new, encode(new), strict=True))
    return kept


def _parts(texts: list[str]):
    """Runs of texts of about BATCH_CHARS characters."""
    run, chars = [], 0
    for t in texts:
        run.append(t)
        chars += len(t)
        if chars >= BATCH_CHARS:
            yield run
            run, chars = [], 0
    if run:
        yield run


def encode_bytes(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers, for the byte-level vocabulary."""
    t, out = tokenizer(path), []
    assert array("I").itemsize == 4

    def whole_ids(run: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in t.encode_batch_fast(run, add_special_tokens=False)]

    def piece_ids(pieces: list[str]) -> list[bytes]:
        # a piece needs no normalisation and is not cut again, so the library's model takes it directly
        cut = t.model.tokenize
        return [array("I", [k.id for k in cut(p.encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes() for p in pieces]

    for run in _parts(texts):
        cut = [None if NOT_PLAIN.search(x) else PIECE.findall(x) for x in run]
        kept = _with(_kept(path, "ids"), set().union(*[c for c in cut if c is not None]), piece_ids)
        whole = iter(whole_ids([x for x, c in zip(run, cut, strict=True) if c is None]))
        out += [next(whole) if c is None else b"".join(map(kept.__getitem__, c)) for c in cut]
    return out


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, for the vocabulary that drops white space: in plain texts those of the words between white space."""
    t, out = tokenizer(path), []

    def counts(words: list[str]) -> list[int]:
        return [len(e) for e in t.encode_batch_fast(words, add_special_tokens=False)]

    for run in _parts(texts):
        cut = [None if NOT_PLAIN.search(x) else x.split() for x in run]
        kept = _with(_kept(path, "counts"), set().union(*[c for c in cut if c is not None]), counts)
        whole = iter(counts([x for x, c in zip(run, cut, strict=True) if c is None]))
        out += [next(whole) if c is None else sum(map(kept.__getitem__, c)) for c in cut]
    return out
