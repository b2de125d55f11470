"""Token ids of texts by the tokenizers library, with a cache of units between blanks.

A text is cut before every single blank that has no white space beside it, between a letter
or digit and a single mark in front of a blank or line feed, and on both sides of a line
feed between other characters. There a byte-level splitting rule always cuts too, so the
ids of the units put together are the ids of the whole text. A text with other white space beside a blank or with the content of
an added token is encoded whole, and so is every text when the tokenizer is of another kind.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from lakewright.llm.common import CACHES, entering

CACHE_UNITS = 400_000
START = "\x01"
#: Begins a unit that has no blank in front of it and follows another unit.
BARE = "\x02"
MARK_BEHIND_WORD = re.compile(r"[.,;:!?](?<=[^\W_].)(?=[ \n])")
LINE_FEED = re.compile(r"\n(?<=\S\n)(?=\S)")
#: Held for a unit that needs the text around it; no unit that is encoded has no ids.
NOT_ALONE = b""
#: Marks that are no letter, digit or white space; the splitting rule keeps a row of them together.
MARKS = ".,;:!?%&$*#()[]\"-+/<>=@^~|{}"


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: visible Latin-1
    characters stand for themselves, the others follow from code point 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in visible else chr(next(rest)) for b in range(256)}


class Encoder:
    """One tokenizer file and its cache, which lives as long as the Python worker and is
    emptied at CACHE_UNITS units; that changes the time taken alone.

    A unit stands for itself behind a blank; one that begins with START stands for the rest
    of it at the beginning of a text or behind a line feed, one that begins with BARE for the
    rest of it behind another unit. A unit that cannot be encoded alone,
    as it is empty or has white space at an end, stands for NOT_ALONE.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = self.tokenizer.pre_tokenizer
        self.by_unit = isinstance(kind, pre_tokenizers.ByteLevel) and not kind.add_prefix_space
        self.by_unit = self.by_unit and self.tokenizer.normalizer is None
        self.letters = {b: letter for b, letter in byte_letters().items() if b != ord("\n")}
        self.units: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn_words(self, words: set[str]) -> None:
        """Words go straight to the merges: the splitting rule makes one piece of each."""
        words = [w for w in words if w not in self.units]
        plain = "\n".join([w[1:] if w[0] == START else f" {w}" for w in words])
        spelled = plain.encode().decode("latin-1").translate(self.letters).split("\n") if words else []
        tokenize = self.tokenizer.model.tokenize
        self.units.update((word, array("I", [t.id for t in tokenize(letters)]).tobytes()) for word, letters in zip(words, spelled))

    def learn(self, units: Iterable[str]) -> None:
        """Ids of units that are not known. A word with marks behind it is the word and the
        marks, since the splitting rule cuts there."""
        words, split, odd = set(), [], []
        for unit in units:
            if unit.isalpha():
                words.add(unit)
                continue
            word = unit.rstrip(MARKS)
            if word.isalpha() or (word[:1] == START and word[1:].isalpha()):
                split.append((unit, word, unit[len(word) :]))
                words.add(word)
                continue
            if unit == f"{BARE}\n":
                odd.append(unit)
                continue
            body = unit[1:] if unit[:1] in (START, BARE) else unit
            if not body or body[0].isspace() or body[-1].isspace():
                self.units[unit] = NOT_ALONE
                continue
            odd.append(unit)
        self.learn_words(words)
        for unit, word, marks in split:
            if marks not in self.marks:
                self.marks[marks] = self.whole(marks) if marks else b""
            self.units[unit] = self.units[word] + self.marks[marks]
        for unit in odd:
            self.units[unit] = self.whole(unit[1:] if unit[0] in (START, BARE) else f" {unit}")

    def units_of(self, text: str) -> list[str]:
        """The units of a text that has neither START nor BARE in it."""
        text = LINE_FEED.sub(f" {BARE}\n {START}", MARK_BEHIND_WORD.sub(rf" {BARE}\g<0>", text))
        units = text.split(" ")
        units[0] = f"{START}{units[0]}"
        return units

    def by_units(self, text: str | None) -> bool:
        return bool(text) and self.by_unit and START not in text and BARE not in text and not any(map(text.__contains__, self.added))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text. All units of the texts are looked up in one row; those that are
        not known are learnt together and put in their places."""
        flat: list[str] = []
        ends: list[int] = []
        for text in texts:
            if self.by_units(text):
                flat += self.units_of(text)
            ends.append(len(flat))
        collecting = gc.isenabled()
        gc.disable()  # nothing made here is cyclic, and looking through millions of units for cycles takes time
        try:
            held = list(map(self.units.get, flat))
            gaps = [i for i, ids in enumerate(held) if ids is None]
            missing = {flat[i] for i in gaps}
            if len(self.units) + len(missing) > CACHE_UNITS:
                self.units.clear()
                self.marks.clear()
            self.learn(missing)
            for i in gaps:
                held[i] = self.units[flat[i]]
        finally:
            if collecting:
                gc.enable()
        del flat, gaps, missing
        begin = 0
        for text, end in zip(texts, ends):
            own, begin = held[begin:end], end
            ids = b"".join(own) if own and NOT_ALONE not in own else self.whole(text) if text else b""
            yield np.frombuffer(ids, "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


CACHES.append(encoder.cache_clear)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The file of an installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(texts: Iterable[str | None], path: str) -> Iterator[np.ndarray]:
    """The ids of each text as unsigned 32-bit integers; null counts as empty.

    The texts are looked at together, so give some megabytes of them at a time.
    """
    entering("tokens")
    yield from encoder(path).encode(list(texts))
