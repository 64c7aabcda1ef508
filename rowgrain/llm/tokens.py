"""Token ids through a cache of pre-tokens, equal to what the tokenizers library gives for the whole text.

Byte-pair merges never cross a pre-token, so a text's ids are those of its pre-tokens one after the other.  Texts of
plain Latin-1 letters are cut by the pattern of the tokenizer's file written out for that alphabet; any other text is
normalised and cut, or encoded as a whole, by the library itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pre-tokens, and stretches of text, kept per task; beyond that a cache starts anew.
CACHE = 600_000
#: Characters of the texts whose distinct stretches are looked up together.
TOGETHER = 1 << 25

#: Outside of these the library cuts the text: white space that classes differ on, and letters beyond Latin-1.
_UNUSUAL = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xff]")
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_CLITIC = "'s|'t|'re|'ve|'m|'ll|'d"
#: Words with their leading space (byte-level files), and words without white space (files that lower-case).
_SPACED = re.compile(rf"{_CLITIC}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\t-\r {_LETTER}{_NUMBER}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_BARE = re.compile(rf"{_CLITIC}|[{_LETTER}]+|[{_NUMBER}]|[^\t-\r {_LETTER}{_NUMBER}]+")


def _shown() -> list[str]:
    """The character that byte-level files use for each byte: printable ones stand for themselves, others are moved up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(moved)) for b in range(256)]


_SHOWN = _shown()
#: The same for the characters of plain text, and a character that is not among them.
_SHOWN_AS, _BETWEEN = {c: "".join([_SHOWN[b] for b in chr(c).encode()]) for c in range(256)}, "\u0400"


class _Kept(dict):
    """Values made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        value = self[key] = self.make(key)
        return value


def _gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches of ``flat`` one after the other."""
    at = np.repeat(start - np.cumsum(length) + length, length)
    at += np.arange(len(at))
    return flat.take(at)


class _Numbered(dict):
    """Numbers of plain pre-tokens as they come, and the ids of each."""

    def __init__(self, lib: Tokenizer):
        super().__init__()
        self.tokenize = lib.model.tokenize
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.ends, self.spaced = array("I"), array("q", [0]), bytearray()

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of ``pieces`` one after the other, their number in each piece, and whether it begins with a space."""
        missing = [p for p in dict.fromkeys(pieces) if p not in self]
        if missing:
            self.update(zip(missing, range(len(self), len(self) + len(missing))))
            self.spaced.extend([p[0] == " " for p in missing])
            for shown in _BETWEEN.join(missing).translate(_SHOWN_AS).split(_BETWEEN):
                self.flat.extend([t.id for t in self.tokenize(shown)])
                self.ends.append(len(self.flat))
        number = np.fromiter(map(self.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        flat, ends = np.array(self.flat, dtype="<u4"), np.array(self.ends)
        length = np.diff(ends)[number]
        return _gathered(flat, ends[number], length), length, np.frombuffer(bytes(self.spaced), dtype=bool)[number]


class Pieces:
    """Pre-tokens and ids of one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has dealt out the cores
        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.lower = spec["normalizer"] is not None
        self.cut = _BARE if self.lower else _SPACED
        self.split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")").split if self.specials else None
        self.pieces = _Kept(self._piece)
        self.numbers = _Numbered(self.lib)
        self.cache = _Kept(self._chunk)

    def _plain(self, text: str) -> list[str] | None:
        if _UNUSUAL.search(text) is not None:
            return None
        return self.cut.findall(text.lower() if self.lower else text)

    def _by_library(self, text: str) -> list[str]:
        """Pre-tokens of an unusual text, cut by the library."""
        if self.lib.normalizer is not None:
            text = self.lib.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens, and special strings as they stand."""
        if self.split is None or not any(s in text for s in self.specials):
            got = self._plain(text)
            return self._by_library(text) if got is None else got
        out: list[str] = []
        for k, part in enumerate(self.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                got = self._plain(part)
                out += self._by_library(part) if got is None else got
        return out

    def counts(self, pretokens: list[str]) -> list[int]:
        """Number of ids of each pre-token."""
        return [len(e.ids) for e in self.lib.encode_batch(pretokens, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isalnum() else "".join([_SHOWN[b] for b in piece.encode()])
        return array("I", [t.id for t in self.lib.model.tokenize(shown)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch of plain text whose pre-tokens are its own."""
        return b"".join(map(self.pieces.__getitem__, self.cut.findall(chunk)))

    def ids(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text (NULL: none), as ``<u4``.

        Where white space is dropped, no pre-token goes over it; where a space belongs to the word after it, none goes
        over the place before a single space.  So stretches between are looked up whole.
        """
        out: list[np.ndarray | None] = []
        plain: list[str] = []
        for text in texts:
            text = text or ""
            odd = _UNUSUAL.search(text) is not None or any(s in text for s in self.specials)
            if odd or (not self.lower and "  " in text):
                out.append(np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4"))
            elif self.lower:
                out.append(np.frombuffer(b"".join(map(self.cache.__getitem__, text.lower().split())), dtype="<u4"))
            else:
                out.append(None)
                plain.append(text)
        got = self._spaced_ids(plain)
        return [next(got) if x is None else x for x in out]

    def _spaced_ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of plain texts without two spaces together: each distinct stretch is cut and looked up once."""
        lo = 0
        while lo < len(texts):
            hi = size = 0
            for hi in range(lo, len(texts)):
                size += len(texts[hi])
                if size > TOGETHER:
                    break
            hi += 1
            some = pc.split_pattern(pa.array(texts[lo:hi], pa.large_string()), " ")
            coded = some.values.dictionary_encode()
            words = coded.dictionary
            odd = pc.match_substring_regex(words, "^$|[\t-\r]$")  # white space would go on into the stretch after it
            rest = words.filter(pc.invert(odd))
            joined = " " + " ".join(rest.to_pylist()) if len(rest) else ""
            if len(self.numbers) >= CACHE:
                self.numbers.forget()
            ids, length, spaced = self.numbers.ids(self.cut.findall(joined))
            first = some.offsets.to_numpy()
            # Single stretches: those that end in white space, and the first of each text, which has no space before it.
            single = [self._chunk(" " + w) for w in words.filter(odd).to_pylist()] + [self._chunk(t.split(" ", 1)[0]) for t in texts[lo:hi]]
            n = np.empty(len(words) + hi - lo, dtype=np.int64)
            place = np.append(odd.to_numpy(zero_copy_only=False), np.ones(hi - lo, dtype=bool))
            n[~place] = np.add.reduceat(length, np.flatnonzero(spaced)) if len(rest) else 0
            n[place] = [len(x) // 4 for x in single]
            start = np.empty_like(n)
            start[~place] = np.cumsum(n[~place]) - n[~place]
            start[place] = len(ids) + np.cumsum(n[place]) - n[place]
            number = coded.indices.to_numpy().astype(np.int64)
            number[first[:-1]] = len(words) + np.arange(hi - lo)
            flat = _gathered(np.concatenate([ids, np.frombuffer(b"".join(single), dtype="<u4")]), start[number], n[number])
            ends = np.concatenate([[0], np.cumsum(n[number])])[first]
            yield from (flat[a:b] for a, b in zip(ends, ends[1:]))
            lo = hi
