"""Token ids of whole texts, with each distinct piece of text encoded once.

Tokens of the lower-casing word BPE never span white space, so a text's ids are those of its words,
one after the other.  Words are cut at the space and the line feed only.  A full stop or comma after a letter at a
word's end is a piece of its own to the pre-tokenizer, and is cut off too, so that words are met again more often.
"""

from __future__ import annotations

import os
import re
from array import array

#: Letters that the normaliser changes only by folding case, one letter to one, and the pre-tokenizer keeps in one piece
_PLAIN = frozenset(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xDF), *range(0xE0, 0xF7), *range(0xF8, 0xFF)]))
_STOP = re.compile(r"[.,](?<=[A-Za-zÀ-ÖØ-Þà-öø-þ][.,])(?=[ \n]|\Z)")
#: Pieces that a worker remembers, about 60 MB; when full it starts anew, results are the same
_MOST = 300_000


class _Pieces(dict):
    """Packed ids by piece of text; a piece is encoded when it is first asked for."""

    def __init__(self, tokenizer, code: str):
        self.tokenizer, self.code, self.tokenize = tokenizer, code, tokenizer.model.tokenize
        # bytes as the byte-level pre-tokenizer writes them
        shown = {c: tokenizer.pre_tokenizer.pre_tokenize_str(c.lower()) for c in _PLAIN if not c.isascii()}
        self.shown = {ord(c.lower()): got[0][0] for c, got in shown.items() if len(got) == 1}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _MOST:
            self.clear()
        if piece.isalpha() and (piece.isascii() or _PLAIN.issuperset(piece)) or piece in (".", ","):
            text = piece.lower()
            ids = [t.id for t in self.tokenize(text if text.isascii() else text.translate(self.shown))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        got = self[piece] = array(self.code, ids).tobytes()
        return got


class Encoder:
    """Encodes with a tokenizers file; one per worker and file.  width: bytes of a packed id, 2 if the vocabulary allows."""

    _shared: dict[str, "Encoder"] = {}

    @classmethod
    def shared(cls, path: str) -> Encoder:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.by_words = self._words_stand_alone()
        if self.by_words:
            self.pieces = _Pieces(self.tokenizer, self.code)

    def _words_stand_alone(self) -> bool:
        """Whether this file drops white space and folds case, so that words can be encoded by themselves."""
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        sample = ["Hello", ",", "wörld's", "a1b", "x", ".", "'s", "--", "İß", "<|endoftext|>"]
        joined = "Hello, wörld's \na1b x. 's -- İß <|endoftext|>"
        return one(joined) == sum(map(one, sample), []) and one("ABC DEF") == one("abc def") and type(self.tokenizer.model).__name__ == "BPE"

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def forget(self) -> None:
        """Give back the memory of what was remembered."""
        if self.by_words:
            self.pieces.clear()

    def _one(self, text: str) -> bytes:
        if "<|" not in text:  # what looks like a special token is told by its case
            try:
                text.encode("latin-1")  # there, folding is letter by letter, as the normaliser does it
            except UnicodeEncodeError:
                pass
            else:
                text = text.lower()
        cut = _STOP.sub(r" \g<0>", text)
        return b"".join(map(self.pieces.__getitem__, cut.replace("\n", " ").split(" ")))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text; None is an empty text."""
        if not self.by_words:
            return [self.pack(self.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
        return [self._one(t) if t else b"" for t in texts]
