"""SentencePiece encoding and decoding of merge-type models, by backtracking.

A row of pieces is what merging gives if and only if every piece is what its own characters
merge to and each two neighbours merge to just those two. So a text is cut from the left:
an Aho-Corasick automaton tells the longest piece at each place; a piece is taken if it is
compatible with the one before, shorter ones are tried next, and a place where none fits
is marked in a bitfield, the last piece is given back and no piece may end there again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from lakewright.llm.common import CACHES, entering, slices, text_or_empty

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
CACHE_UNITS = 400_000
CACHE_PAIRS = 1_000_000
#: Longer units are rare and not kept.
UNIT_LETTERS = 64
PROBE = "  AÀＡ \t b́ﬁ  "


class Pieces:
    """The pieces of one model file, and what is known of them in this worker."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        if model.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE):
            raise ValueError("the model changes its texts in another way than by one space in front")
        ids = range(model.get_piece_size())
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.names = [model.id_to_piece(i) for i in ids]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in ids]
        self.ids = {self.names[i]: i for i in ids if not special[i]}
        self.scores = [model.get_score(i) for i in ids]
        self.lengths = [len(name) for name in self.names]
        self.bytes = {int(self.names[i][3:5], 16): i for i in ids if model.is_byte(i)}
        if len(self.bytes) != 256 or not all(c in self.ids for name in self.ids for c in name):
            raise ValueError("the model lacks byte pieces or single characters of its pieces")
        self.texts = [self.names[i].replace(SPACE, " ").encode() for i in ids]
        for i in filter(model.is_unknown, ids):
            self.texts[i] = model.decode([i]).encode()
        for byte, i in self.bytes.items():
            self.texts[i] = bytes([byte])
        self.controls = {i for i in ids if model.is_control(i)}
        self.byte_ids = set(self.bytes.values())
        #: Neighbouring characters of pieces; between any others a text can be cut.
        self.joints = {name[n : n + 2] for name in self.ids for n in range(len(name) - 1)}
        self.spaced = [not s and name.startswith(SPACE) for s, name in zip(special, self.names)]
        #: False if a piece goes on over the start of a word; texts are then one unit.
        self.by_unit = not any(SPACE in name.lstrip(SPACE) for name in self.ids)
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.whole: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, text: str) -> list[str]:
        """What the characters of a short text of known characters merge to: always the
        neighbours whose union has the highest score, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            unions = [self.ids.get(a + b, -1) for a, b in zip(parts, parts[1:])]
            place = max(range(len(unions)), key=lambda k: (unions[k] >= 0, self.scores[unions[k]], -k))
            if unions[place] < 0:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def stands(self, piece: int) -> bool:
        """Whether a piece is what its own characters merge to."""
        if piece not in self.whole:
            self.whole[piece] = self.merge(self.names[piece]) == [self.names[piece]]
        return self.whole[piece]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces side by side stay as they are when they are merged again."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            a, b = self.names[left], self.names[right]
            known = self.pairs[left, right] = a[-1] + b[0] not in self.joints or self.merge(a + b) == [a, b]
        return known

    def next_shorter(self, piece: int) -> int:
        """The longest piece that begins a piece and is not the whole of it, or -1."""
        if piece not in self.shorter:
            name = self.names[piece]
            self.shorter[piece] = next((self.ids[name[:n]] for n in range(len(name) - 1, 0, -1) if name[:n] in self.ids), -1)
        return self.shorter[piece]

    def cut(self, longest: array, start: int, stop: int) -> list[int]:
        """The pieces of the characters from `start` to `stop`, all of them known."""
        failed = bytearray((stop - start >> 3) + 1)
        taken: list[int] = []
        at, piece = start, longest[start]
        while at < stop:
            while piece >= 0:
                end = at + self.lengths[piece]
                place = end - start
                if not failed[place >> 3] >> (place & 7) & 1 and self.stands(piece):
                    if not taken or self.compatible(taken[-1], piece):
                        break
                piece = self.next_shorter(piece)
            if piece >= 0:
                taken.append(piece)
                at = end
                piece = longest[at] if at < stop else -1
            else:
                place = at - start
                failed[place >> 3] |= 1 << (place & 7)
                last = taken.pop()
                at -= self.lengths[last]
                piece = self.next_shorter(last)
        return taken

    def encode_part(self, part: str) -> bytes:
        """Ids of a text in which spaces are marked; unknown characters are their bytes."""
        longest = array("i", [-1]) * len(part)
        for last, piece in self.automaton.iter(part):
            longest[last + 1 - self.lengths[piece]] = piece
        if -1 not in longest:
            return array("I", self.cut(longest, 0, len(part))).tobytes()
        ids, at = array("I"), 0
        while at < len(part):
            stop = at
            while stop < len(part) and longest[stop] >= 0:
                stop += 1
            ids.extend(self.cut(longest, at, stop))
            if stop < len(part):
                ids.extend(self.bytes[byte] for byte in part[stop].encode())
            at = stop + 1
        return ids.tobytes()

    def split(self, text: str) -> list[str]:
        """A text cut where no piece has the two characters around the cut side by side."""
        ends = [n for n in range(1, len(text)) if text[n - 1 : n + 1] not in self.joints]
        return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]

    def decode(self, ids: Iterable[int]) -> bytes:
        """UTF-8 text of ids. Byte pieces in a row give characters, or U+FFFD for each byte that
        is part of none; control pieces give nothing; the first space of the first piece goes."""
        ids = list(ids)
        if ids and not 0 <= min(ids) <= max(ids) < len(self.texts):
            raise ValueError("an id is out of range")
        while ids and ids[-1] in self.controls:
            ids.pop()
        first = 0
        while first < len(ids) and ids[first] in self.controls:
            first += 1
        parts = list(map(self.texts.__getitem__, ids[first:]))
        if parts and self.spaced[ids[first]]:
            parts[0] = parts[0][len(b" ") :]
        if self.controls.isdisjoint(ids[first:]):
            text = b"".join(parts)
            try:
                text.decode()
                return text
            except UnicodeDecodeError:
                pass
        out, run = [], b""
        for piece, part in zip(ids[first:], parts):
            if piece in self.byte_ids:
                run += part
                continue
            out.append(bytes_as_characters(run))
            out.append(b"" if piece in self.controls else part)
            run = b""
        return b"".join([*out, bytes_as_characters(run)])


def bytes_as_characters(text: bytes) -> bytes:
    """`text` with U+FFFD for every byte that belongs to no whole character."""
    out, at = [], 0
    while at < len(text):
        lead = text[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            out.append(text[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("\ufffd")
            at += 1
    return "".join(out).encode()


class Units(dict):
    """Ids of units without their first space, worked out when first asked for."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.pieces.encode_part(part)
            if len(part) <= UNIT_LETTERS:
                self.parts[part] = ids
        return ids

    def __missing__(self, unit: str) -> bytes:
        ids = b"".join(map(self.part, self.pieces.split(SPACE + unit)))
        if len(unit) <= UNIT_LETTERS:
            self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as unsigned 32-bit integers of this machine, without begin and end."""
        if not text:
            return b""
        if len(self) > CACHE_UNITS:
            self.clear()
        if len(self.parts) > CACHE_UNITS:
            self.parts.clear()
        if not self.pieces.by_unit:
            return self[text.replace(" ", SPACE)]
        if text[0] != " " and "  " not in text and SPACE not in text:
            units = text.split(" ")
        else:
            units = [unit[1:] for unit in UNIT.findall(SPACE + text.replace(" ", SPACE))]
        return b"".join(map(self.__getitem__, units))


@lru_cache(maxsize=1)
def units(path: str) -> Units:
    return Units(Pieces(path))


CACHES.append(units.cache_clear)


def encode_documents(docs: DataFrame, path: str, marks: bool = True) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (text), one row a document.

    Every whole text is encoded with the model file at `path` on the workers, with begin and end
    ids if `marks`, and the ids are decoded again. A null or empty text has no ids but these
    marks. Rows stay as they are, repeated, without id or very long; other columns are not
    read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("pieces")
        known = units(path)
        pieces = known.pieces
        before, behind = (array("I", [i]).tobytes() if marks else b"" for i in (pieces.begin, pieces.end))
        for batch in slices(batches, "text", 4 << 20):
            ids, texts = [], []
            for text in batch.column("text").to_pylist():
                found = array("I", before + known.encode(text) + behind)
                texts.append(pieces.decode(found))
                if array("I", [1]).tobytes()[0] != 1:
                    found.byteswap()
                ids.append(found.tobytes())
            decoded = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), decoded], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")
