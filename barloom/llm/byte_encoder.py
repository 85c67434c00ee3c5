"""Ids of whole texts under a byte-level BPE, with each distinct piece of text encoded once.

The pre-tokenizer of such a file takes a space with what follows it, and ends a piece where letters end.  So a text without
two white space characters in a row can be cut before each space and around each line feed, and a piece that ends with a stop after a letter
before that stop; its ids are those of its pieces, one after the other.  All other texts are encoded as they stand.
"""

from __future__ import annotations

import os
from array import array

#: Pieces that a worker remembers, about 200 MB; when full it starts anew, results are the same
_MOST = 1_000_000
_STOPS = frozenset(".,;:!?")
#: Words up to this length, with a space and a stop, come often enough to be kept with their stop
_SHORT = 8


def _shown() -> dict[int, str]:
    """How byte-level pre-tokenizers write each byte: printable latin-1 as itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pieces(dict):
    """Packed ids by piece."""

    def __init__(self, tokenizer, code: str):
        self.tokenizer, self.code, self.tokenize, self.table = tokenizer, code, tokenizer.model.tokenize, _shown()
        self.space = self.table[32]
        self[""] = b""

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _MOST:
            self.clear()
            self[""] = b""
        bare = piece[1:] if piece[0] == " " else piece
        if bare.isalpha():  # one piece to the pre-tokenizer too
            shown = piece.encode().decode("latin-1").translate(self.table) if not bare.isascii() else bare if bare is piece else self.space + bare
            got = array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()
        elif len(bare) > 1 and bare[-1] in _STOPS and bare[:-1].isalpha():
            got = self[piece[:-1]] + self[bare[-1]]
            if len(piece) > _SHORT:
                return got  # its parts are kept
        else:
            got = self.whole(piece)
        self[piece] = got
        return got

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class ByteEncoder:
    """Encodes with a tokenizers file; one per worker and file.  width: bytes of a packed id."""

    _shared: dict[str, "ByteEncoder"] = {}

    @classmethod
    def shared(cls, path: str) -> ByteEncoder:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.pieces = _Pieces(self.tokenizer, self.code)
        kind = json.loads(self.tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        #: by what the file says: no normaliser, its pre-tokenizer's own pattern, plain BPE
        self.by_pieces = kind["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True) and kind["model"]["type"] == "BPE" and not kind["model"]["dropout"]
        self.added = [t["content"] for t in kind["added_tokens"]]

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The packed ids; None is an empty text."""
        if not text:
            return b""
        line = text.replace("\n", " ")
        # what is printable has no white space but spaces, and no NUL
        if not self.by_pieces or "  " in line or not line.isprintable() or any(t in text for t in self.added):
            return self.pieces.whole(text)
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))
