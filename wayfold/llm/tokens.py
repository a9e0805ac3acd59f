"""Public tokenizers applied word by word."""

from __future__ import annotations

import os
import re
import struct

# texts of these characters alone are cut where letters and others meet; the tokenizer cuts there too
_PLAIN = re.compile(r"[\n -&(-~À-ÖØ-öø-ÿ]*")
_RUNS = re.compile(r"[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ\n ]+")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class WordIds(dict):
    """Ids of the pieces of a text between blanks, as little-endian 32-bit bytes.

    For tokenizers that never join text across white space (which then yields
    no ids): a text's ids are those of its pieces, one after another, so each
    distinct piece among the first ``limit`` is encoded once.  The tokenizer is
    one that ignores case and cuts between letters and punctuation.
    """

    def __init__(self, path: str, limit: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.model = self.tokenizer.model
        # small ASCII letters reach the merges unchanged
        probe = "probe"
        self.direct = [t.id for t in self.tokenizer.model.tokenize(probe)] == self.tokenizer.encode(probe, add_special_tokens=False).ids

    def __missing__(self, piece: str) -> bytes:
        if self.direct and piece.isascii() and piece.isalpha() and piece.islower():
            ids = [t.id for t in self.model.tokenize(piece)]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.limit:
            self[piece] = got
        return got

    def pieces(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return _RUNS.findall(text.lower())
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        return [b"".join(map(self.__getitem__, self.pieces(t))) for t in texts]


_ready: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker process."""
    if path not in _ready:
        _ready[path] = WordIds(path)
    return _ready[path]
