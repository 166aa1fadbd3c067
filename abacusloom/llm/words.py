"""Encoding of texts word by word, each distinct word once: what packing and byte-level BPE share.

A text is cut before its single spaces. Under a byte-level pattern of the usual kind (`` ?letters``, `` ?digits``,
`` ?marks``, white space up to its last character) such a cut never lies inside a match and a word's matches
don't depend on its neighbours, unless white space stands on both sides of a space or before a last one; such texts
are cut by the pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa

MOST_BYTES = 96_000_000  # of words and ids kept by a worker; an evicted word is encoded again
ENTRY_BYTES = 200  # of a usual word with its ids; a longest one takes some 600
LONG = 64  # characters from which on a word isn't kept
SLICE_CHARS = 1_000_000  # texts encoded together
SLICE_TEXTS = 2_000
CROSSING = re.compile(r" (?<=\s )(?=\s|\Z)")
BESIDE = re.compile(r"\n(?:(?<=\s\n)|(?=\s|\Z)|(?<=\A\n))")  # a line's end beside white space, or first or last
MARKS = frozenset(".,;:!?")


#: A string stands for the word with a space before it, a tuple of one string for that string as it is.
Key = str | tuple[str]
LINE_END = ("\n",)


def text_of(key: Key) -> str:
    return " " + key if isinstance(key, str) else key[0]


def key_of(text: str) -> Key:
    return text[1:] if text[0] == " " and len(text) > 1 else (text,)


class WordCache:
    """Ids' bytes of words. ``learn(keys, known)`` adds new ones; ``split(text)`` cuts a text that can't be cut before spaces.
    What is kept is bounded in bytes: of the words that are known, those not seen since half of the bound filled up are
    forgotten, and long words are forgotten at once."""

    def __init__(self, learn: Callable[[list[Key], dict[Key, bytes]], None], split: Callable[[str], list[str]], most: int = MOST_BYTES):
        self.learn, self.split, self.most, self.known, self.older, self.held = learn, split, most, {}, {}, 0

    def cut(self, text: str) -> list[Key]:
        if CROSSING.search(text):
            return list(map(key_of, self.split(text)))
        if "\n" in text and not BESIDE.search(text):  # each line's end stands alone between words
            out: list[Key] = []
            for line in text.split("\n"):
                words = line.split(" ")
                if words[0]:
                    out.append((words[0],))
                out += words[1:]
                out.append(LINE_END)
            out.pop()
            return out
        words = text.split(" ")
        if words[0]:
            words[0] = (words[0],)
        else:
            del words[0]
        return words

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > self.most // 2:
            self.older, self.known, self.held = self.known, {}, 0
        known, older = self.known, self.older
        get, before, new, join = known.get, len(known), set(), b"".join
        found: list[bytes | list] = []
        open_ = []  # texts with words that aren't known yet
        for i, words in enumerate(map(self.cut, texts)):
            ids = list(map(get, words))
            try:
                found.append(join(ids))
            except TypeError:  # None is among them
                found.append(ids)
                open_.append((i, words))
                new.update([w for w, x in zip(words, ids, strict=True) if x is None])
        if new:
            if older:
                kept = {w: older[w] for w in new if w in older}
                known.update(kept)
                new.difference_update(kept)
            self.learn(list(new), known)
            for i, words in open_:
                found[i] = join([known[w] if x is None else x for w, x in zip(words, found[i], strict=True)])
            for w in [w for w in new if len(w) >= LONG or type(w) is tuple and len(w[0]) >= LONG]:
                del known[w]
            self.held += ENTRY_BYTES * (len(known) - before)
        return found


@dataclass
class Pieces:
    """New words taken apart: ``plain`` ones of letters with a space before them, other single ``pieces`` to encode, words of letters and one ``marked`` end, and
    ``several``, words of several pieces with those."""

    plain: list[str]
    pieces: list[Key]
    marked: list[str]
    several: list[tuple[Key, list[Key]]]

    def join(self, known: dict[Key, bytes]) -> None:
        """Add the words of several pieces, all of which are known by now."""
        marks = {m: known[(m,)] for m in {w[-1] for w in self.marked}}
        known.update([(w, known[w[:-1]] + marks[w[-1]]) for w in self.marked])
        for w, parts in self.several:
            known[w] = b"".join([known[p] for p in parts])


def cut_words(keys: list[Key], split: Callable[[str], list[str]], known: dict[Key, bytes]) -> Pieces:
    """Matches of the pattern (by ``split``) that aren't known. Letters, and letters before one mark, need no search."""
    plain = [k for k in keys if type(k) is str and k.isalpha()]
    marked = [k for k in keys if type(k) is str and k[-1:] in MARKS and k[:-1].isalpha()]
    plain += {k[:-1] for k in marked}.difference(known, plain)
    pieces: dict[Key, None] = {(m,): None for m in {k[-1] for k in marked} if (m,) not in known}
    several = []
    done = {*plain, *marked}
    for k in keys:
        if k in done:
            continue
        parts = list(map(key_of, split(text_of(k))))
        if parts == [k]:
            pieces[k] = None
        else:
            several.append((k, parts))
            pieces.update((p, None) for p in parts if p not in known and p not in done)
    return Pieces(plain, list(pieces), marked, several)


def slices(column: pa.Array) -> Iterator[list[str]]:
    """Texts of a column, nulls as empty ones, in lists of bounded size (or of one long text)."""
    texts, chars = [], 0
    for value in column:
        texts.append(value.as_py() or "")
        chars += len(texts[-1])
        if chars >= SLICE_CHARS or len(texts) >= SLICE_TEXTS:
            yield texts
            texts, chars = [], 0
    if texts:
        yield texts
