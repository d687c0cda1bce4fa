"""Token ids of whole texts by public tokenizer files, with a cache of words in each Python worker.

Rare words cost most of a tokenizer's time and recur, so texts are cut at single spaces, where both kinds of
tokenizer used here always cut too, and the ids of a piece are remembered. A text in which a space is followed
by white space (where that does not hold) is encoded whole. The results are those of the tokenizer itself.
"""

from __future__ import annotations

import os
import re
import uuid
from array import array

#: A space after which a byte-level tokenizer may not cut as it would in a piece of its own.
_UNSAFE = re.compile(r" (?:\s|\Z)")
#: A word of Latin letters and the ASCII symbols after it (not both empty in a piece), which any of the tokenizers encodes one by one.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


# How byte-level tokenizers write each byte as a character (printable ones as themselves, the rest from U+0100 on).
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARACTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
BYTE_OF_CHARACTER = {c: b for b, c in _BYTE_CHARACTERS.items()}


class Encoder:
    """Ids as little-endian unsigned 32-bit integers. `entries` bounds each of the two caches.

    Words that were met before come from the cache; a new plain word goes to the tokenizer's model at once, as
    it is a single unit in any case; all else goes through the whole tokenizer.
    """

    def __init__(self, path: str, entries: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.entries = entries
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        # A tokenizer that drops white space sees a piece without its space.
        self.spaces = bool(self.tokenizer.encode(" ", add_special_tokens=False).ids)
        self.line_break = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> tuple[bytes, bool]:
        """The word's ids, and whether it was met before. When the cache is full, what has not been used since the last time goes."""
        found = self.words.get(word)
        if found is not None:
            return found, True
        found = self.old_words.get(word)
        known = found is not None
        if not known:
            unit = word.replace(" ", "\u0120") if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
            found = array("I", [t.id for t in self.model.tokenize(unit)]).tobytes()
        if len(self.words) >= self.entries // 2:
            self.old_words, self.words = self.words, {}
        self.words[word] = found
        return found, known

    def _plain(self, piece: str, space: str) -> tuple[bytes, bool] | None:
        """The ids of a plain piece after `space`, and whether its word was met before; None if it is not plain."""
        plain = _PLAIN.fullmatch(piece)
        if plain is None:
            return None
        letters, symbols = plain.groups()
        if not letters:
            return self._word(space + symbols)
        found, known = self._word(space + letters if self.spaces else letters.lower())
        return (found + self._word(symbols)[0] if symbols else found), known

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece and of the space before it, if the tokenizer sees spaces."""
        space = " " if self.spaces else ""
        found = self._plain(piece, space)
        if found is None and "\n" in piece:  # one line break between two plain pieces is a unit of its own
            above, _, below = piece.partition("\n")
            parts = [self._plain(above, space), self._plain(below, "") if below else (b"", True)] if above else [None]
            if all(parts):
                return parts[0][0] + self.line_break + parts[1][0]
        ids, keep = found or (self._whole(space + piece), True)
        if keep and len(piece) <= 64:
            if len(self.pieces) >= self.entries:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        start = b""
        if self.spaces:
            if _UNSAFE.search(text):
                return self._whole(text)
            parts = text.split(" ")
            start = self._whole(parts[0]) if parts[0] else b""
            del parts[0]
        else:
            parts = text.replace("\n", " ").split(" ")
        get, miss = self.pieces.get, self._piece
        return start + b"".join([get(p) or miss(p) for p in parts if p])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker; its cache lives on in the next task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def scratch_folder(under: str, name: str) -> str:
    """A fresh name under a shared folder. What is written there is not removed: its reader may be lazy."""
    return f"{under.rstrip('/')}/{name}-{uuid.uuid4().hex}"
