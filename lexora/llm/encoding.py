"""Token ids of whole texts by a public tokenizer of the tokenizers library, each distinct piece encoded once.

The library first splits a text into pieces (words with a space before, numbers, punctuation, white space) and
then encodes every piece for itself. Words repeat, so a worker splits texts here, has the library's model encode
each piece that is new, and remembers it in a bounded memory. Only texts of characters whose class is listed
below are split here; any other text, and one with a special token's string, goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import islice

import numpy as np

#: Pieces remembered by a worker, some 60 MB; the memory is emptied when it is full, and at the end of a task.
REMEMBER = 300_000
#: Characters of a text, or pieces, that are handled at once.
LONG = 1_000_000

#: Code points split here: ASCII with its usual white space, Latin letters and signs, common punctuation.
PLAIN = [0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250), *range(0x2010, 0x2028), 0x2030, 0x2039, 0x203A, 0x20AC]


def _class(letter: str) -> str:
    """A regular expression's character class of the plain code points of a Unicode category."""
    return "".join(re.escape(chr(c)) for c in PLAIN if unicodedata.category(chr(c))[0] == letter)


_L, _N, _S = _class("L"), _class("N"), " \t\n\r"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_PLAIN = re.compile("[" + "".join(re.escape(chr(c)) for c in PLAIN) + "]*")
_PIECES = {
    "byte": re.compile(f"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"),
    "word": re.compile(f"{_SHORT}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"),
}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class Pieces(dict):
    """piece: its ids as little-endian 32-bit numbers; a piece that isn't known is encoded by the model."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))]
        self[piece] = found = np.array(ids, "<u4").tobytes()
        return found


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            config = json.load(f)
        self.kind = "word" if config.get("normalizer") else "byte"
        self.special = [t["content"] for t in config.get("added_tokens", [])]
        self.known = Pieces(self.library.model)

    def release(self) -> None:
        """Forget all pieces: workers outlive tasks and stages."""
        self.known.clear()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text)
        text, pattern, parts = text.lower() if self.kind == "word" else text, _PIECES[self.kind], []
        # A long text's pieces are not all held at once
        rest = iter([pattern.findall(text)]) if len(text) <= LONG else iter(lambda m=pattern.finditer(text): [x.group() for x in islice(m, LONG)], [])
        for pieces in rest:
            if len(self.known) > REMEMBER:
                self.release()
            parts.append(b"".join(map(self.known.__getitem__, pieces)))
        return np.frombuffer(b"".join(parts), "<u4")


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, kept from task to task; its memory of pieces is the task's to release."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
