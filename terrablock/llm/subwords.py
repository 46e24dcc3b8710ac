"""Public tokenizers inside tasks: a byte-level BPE and a piece BPE with byte fallback, both made from a file's contents,
which the driver reads by path and broadcasts, so that executors need no such file. Nothing is trained here."""

from __future__ import annotations

import json
import re
from functools import cached_property

import numpy as np

#: Default places of the two files; every operator takes them as parameters.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How byte-level BPE of this vocabulary splits texts before merging (a fixed value of the public tokenizer).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The fast encoder's regular expression can't take a longer run of white space; such texts go to the slower one.
LONG_BLANK = re.compile(r"\s{2000}")

_made: dict[tuple[str, int, int], object] = {}


def contents(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def made(kind: type, data: bytes):
    """The tokenizer of these contents, made once in each Python worker."""
    name = (kind.__name__, len(data), hash(data))
    if name not in _made:
        _made[name] = kind(data)
    return _made[name]


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it is visible, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Table:
    """The bytes of each id, one after another: flat, first, size."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        to = np.cumsum(size) - size
        return self.flat[np.repeat(self.first[ids] - to, size) + np.arange(size.sum())]


class ByteBPE:
    """Ids of texts by a byte-level vocabulary in JSON; strings of special tokens inside texts are plain text."""

    def __init__(self, data: bytes):
        import tiktoken

        self.data = data
        letters = byte_letters()
        spec = json.loads(data)
        special = {t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(letters[c] for c in entry): i for entry, i in spec["model"]["vocab"].items() if i not in special}
        self.end = min(special)
        self.n = max(*special, *self.ranks.values()) + 1
        self.fast = tiktoken.Encoding("ids", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_buffer(self.data)
        made.encode_special_tokens = True
        return made

    @cached_property
    def table(self) -> Table:
        entries = [b""] * self.n
        for entry, i in self.ranks.items():
            entries[i] = entry
        return Table(entries)

    def encode(self, text: str) -> list[int]:
        if LONG_BLANK.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceBPE:
    """Ids of texts by a piece model, which writes a blank before each text; bytes outside its pieces have ids of their own."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.n)]
        self.table = Table([b"" if self.model.is_control(i) or self.model.is_unknown(i) else bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)
