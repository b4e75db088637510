"""Token ids of public BPE vocabularies, by the tokenizers and sentencepiece libraries.

The library's whole encode() runs at about 1.4 MB a second and core, most of it spent on words seen before. So texts are split
here, and the library's BPE model is asked once for each word; a process remembers the answers (a bounded memory: beyond it the
model is asked again). This is done for texts whose characters all lie in a set on which our splitting equals the library's
(ASCII and Latin letters, tested). Any other text, and any text with a special token's string in it, goes through encode() whole.
Byte-level splitting never crosses a blank before a word, so such texts are cut at blanks first, and ids are remembered for what
stands between two of them ("word,"): the pattern then runs only over what wasn't met before.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Callable

import numpy as np
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

#: The pieces of byte-level BPE with Python's re, on plain characters only.
BYTE_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
#: Pieces of the vocabulary with word ends, on plain lower-case characters only.
WORD_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: A character on which the library's splitting, lower-casing or normalising isn't taken for granted.
NOT_PLAIN = re.compile("[^\t-\r\x20-\x7e\xc0-\xffĀ-įı-ňŊ-ž–—‘’“”…€]")
WORD_END = "</w>"
#: How sentencepiece writes a blank; the parts of a text that merges don't leave; pieces that would cross such parts.
BLANK = "\u2581"
PARTS = re.compile(r" *(?:[^\w ]|[\d_])*[^\W\d_]+| *(?:[^\w ]|[\d_])+| +")
CROSSED = re.compile(rf"[^\W\d_](?:[\W\d_])|[^{BLANK}]{BLANK}")
#: Words whose ids a process remembers.
REMEMBERED = 500_000


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Remembered(dict):
    """piece -> bytes of its ids; asks make() for what it doesn't hold and stops growing at REMEMBERED entries."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(self) < REMEMBERED:
            self[piece] = ids
        return ids


class AfterBlank(Remembered):
    """What stands between two blanks -> bytes of the ids that byte-level splitting gives it and the blank before it.

    KeyError where the text must not be cut: white space or nothing after the blank, or signs that aren't plain. What holds the end of
    a line seldom comes again and isn't remembered.
    """

    def __init__(self, make: Callable, known: Remembered, plain: Callable):
        super().__init__(make)
        self.known, self.plain = known, plain

    def __missing__(self, rest: str) -> bytes:
        if not (rest.isascii() and rest.isalpha()) and (not rest or rest[0].isspace() or not self.plain(rest)):
            raise KeyError(rest)
        if rest.isalpha():
            ids = self.make(" " + rest)
        elif rest[:-1].isalpha() and not rest[-1].isspace():
            ids = self[rest[:-1]] + self.known[rest[-1]]
        else:
            head, *pieces = BYTE_PIECES.findall(" " + rest)
            ids = b"".join([self[head[1:]] if pieces else self.make(head), *map(self.known.__getitem__, pieces)])
        if len(self) < 2 * REMEMBERED and "\n" not in rest:
            self[rest] = ids
        return ids


class Encoder:
    """ids(text) are the ids of tokenizers' encode(text, add_special_tokens=False), little-endian unsigned 32-bit. plain_specials: special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str, plain_specials: bool = False):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [] if plain_specials else [x["content"] for x in spec["added_tokens"]]
        end = spec["model"].get("end_of_word_suffix")
        if end not in (None, WORD_END):
            raise ValueError(f"unknown word end {end!r}")
        self.words = end == WORD_END
        model, letters = self.library.model, str.maketrans({chr(b): c for c, b in byte_letters().items()})

        def merged(piece: str) -> bytes:
            return as_bytes([t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(letters))])

        self.known = Remembered(merged)
        self.after_blank = AfterBlank(merged, self.known, self.plain)
        # a special token's string must lie between blanks and be no word
        self.cuts = not self.words and not any(" " in x or x.isalpha() for x in self.special)

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id of a byte-level vocabulary stands for; an added token's string as it is."""
        letters, names = byte_letters(), self.library.get_vocab(with_added_tokens=True)
        out = [b""] * (max(names.values()) + 1)
        for token, i in names.items():
            out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        return out

    def plain(self, text: str) -> bool:
        return NOT_PLAIN.search(text) is None and not any(s in text for s in self.special)

    def _between_blanks(self, text: str) -> bytes:
        """ids() of a text from what stands between its blanks; KeyError if it must not be cut."""
        first, *rest = text.split(" ")
        if not self.plain(first):
            raise KeyError(first)
        return b"".join([*map(self.known.__getitem__, BYTE_PIECES.findall(first)), *map(self.after_blank.__getitem__, rest)])

    def ids(self, text: str) -> np.ndarray:
        if self.cuts:
            try:
                return np.frombuffer(self._between_blanks(text), dtype="<u4")
            except KeyError:
                pass
        if not self.plain(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        pieces = WORD_PIECES.findall(text.lower()) if self.words else BYTE_PIECES.findall(text)
        return np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), dtype="<u4")


    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """ids() of each text, the library asked at once for all the words that aren't known."""

        def made(pieces: list[str]) -> list[bytes]:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

        split = WORD_PIECES if self.words else BYTE_PIECES
        return _by_parts(texts, lambda t: split.findall(t.lower() if self.words else t) if self.plain(t) else None, self.known, made, self.ids)


def _by_parts(texts: list[str], parts_of: Callable, known: Remembered, made: Callable, whole: Callable) -> list[np.ndarray]:
    """Ids of texts from those of their parts (None: the text goes whole). Memory that would overflow is begun anew."""
    parts = [parts_of(t) for t in texts]
    ids = [None if p is None else [*map(known.get, p)] for p in parts]
    lacking = [i for i, found in enumerate(ids) if found and None in found]
    fresh = list({p for i in lacking for p, found in zip(parts[i], ids[i], strict=True) if found is None})
    if len(known) + len(fresh) > REMEMBERED:
        known.clear()
    new = dict(zip(fresh, made(fresh), strict=True))
    known.update(new)
    for i in lacking:
        ids[i] = [new[p] if found is None else found for p, found in zip(parts[i], ids[i], strict=True)]
    return [whole(t) if found is None else np.frombuffer(b"".join(found), dtype="<u4") for t, found in zip(texts, ids, strict=True)]


@functools.lru_cache(maxsize=4)
def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """One encoder a process and vocabulary file."""
    return Encoder(path, plain_specials)


class PieceEncoder:
    """ids(text) are the ids of sentencepiece's encode(text), little-endian unsigned 32-bit.

    Merges never make a piece that the vocabulary lacks. Where its pieces hold no letter before another sign, and nothing before a
    blank, merges never cross such places, so a text is cut there and the library asked once for each part. That is looked up in
    the vocabulary first; a vocabulary that breaks it, or that rewrites texts, has every text encoded whole, as have texts
    with characters that aren't plain.
    """

    def __init__(self, path: str):
        self.library = SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        ordinary = [p for i, p in enumerate(self.pieces) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        self.cuts = not any(CROSSED.search(p) for p in ordinary if not NOT_PLAIN.search(p.replace(BLANK, ""))) and self._rewrites_nothing()
        self.blank = np.array([self.library.piece_to_id(BLANK)], dtype="<u4").tobytes()
        self.known = Remembered(self._part)

    def _rewrites_nothing(self) -> bool:
        plain = "".join(c for c in map(chr, range(1, 0x2100)) if not NOT_PLAIN.search(c)) + "a  b "
        return self.library.normalize(plain) == BLANK + plain.replace(" ", BLANK) and len(self.library.encode("\n\n")) == 3

    def _part(self, part: str) -> bytes:
        if part == " ":
            return self.blank
        ids = self.library.encode(part[1:]) if part[0] == " " else self.library.encode("\n" + part)[2:]  # a blank and the line end come first
        return np.array(ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        if not text or not self.cuts or NOT_PLAIN.search(text):
            return np.array(self.library.encode(text), dtype="<u4")
        return np.frombuffer(b"".join(map(self.known.__getitem__, PARTS.findall(" " + text))), dtype="<u4")

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """ids() of each text, the library asked at once for all the parts that aren't known."""

        def made(parts: list[str]) -> list[bytes]:
            led = [p[0] == " " for p in parts]
            ids = self.library.encode([p[1:] if s else "\n" + p for p, s in zip(parts, led, strict=True)], num_threads=1)
            return [self.blank if p == " " else np.array(x if s else x[2:], dtype="<u4").tobytes() for p, s, x in zip(parts, led, ids, strict=True)]

        return _by_parts(texts, lambda t: PARTS.findall(" " + t) if t and self.cuts and not NOT_PLAIN.search(t) else None, self.known, made, self.ids)

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for."""
        return [bytes([int(p[3:-1], 16)]) if self.library.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]


@functools.lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder a process and model file."""
    return PieceEncoder(path)
