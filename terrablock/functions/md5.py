"""MD5 of many short messages at once: prefix and whole number, as in md5('7|3|12345')."""

from __future__ import annotations

import math

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURN = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_WORD = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Digits and sign of a 64-bit number; the longest prefix that leaves the message in one block.
DIGITS, LONGEST = 20, 55 - 20
#: Messages hashed at a time.
CHUNK = 1 << 14


class Numbers:
    """Whole numbers as text, ready to be hashed behind many prefixes."""

    def __init__(self, numbers: np.ndarray):
        text = numbers.astype(f"S{DIGITS}")
        size = np.char.str_len(text)
        letters = text.view(np.uint8).reshape(len(text), DIGITS)
        self.n = len(text)
        self.groups = [(at := np.flatnonzero(size == k), k, letters[at, :k]) for k in np.unique(size).tolist()]  # numbers of one length
        self.words: dict[tuple[int, int], list] = {}

    def block(self, group: int, lead: int) -> list:
        """The words of the messages of a group behind a prefix of so many bytes, without the prefix: an array, or a number where all agree."""
        if (group, lead) not in self.words:
            at, k, letters = self.groups[group]
            raw = np.zeros((len(at), 64), np.uint8)
            raw[:, lead : lead + k] = letters
            raw[:, lead + k] = 0x80
            raw[:, 56:] = np.frombuffer((8 * (lead + k)).to_bytes(8, "little"), np.uint8)
            words = raw.view("<u4")
            self.words[group, lead] = [int(w[0]) if (w == w[0]).all() else np.ascontiguousarray(w) for w in words.T]
        return self.words[group, lead]

    def hashed(self, prefix: bytes, second: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """The first and, if wanted, the second eight hexadecimal digits of each MD5, as whole numbers below 2^32."""
        if len(prefix) > LONGEST:
            raise ValueError("the prefix is too long")
        out = np.empty(self.n, np.uint32), np.empty(self.n, np.uint32) if second else None
        lead = np.frombuffer(prefix.ljust(64, b"\0"), "<u4").tolist()
        for g, (at, _, _) in enumerate(self.groups):
            words = self.block(g, len(prefix))
            for i in range(0, len(at), CHUNK):
                part = at[i : i + CHUNK]
                found = digest([w if isinstance(w, int) else w[i : i + CHUNK] for w in words], lead, len(part), second)
                for x, y in zip(out, found, strict=True):
                    if x is not None:
                        x[part] = y
        return out


def turned(x: int, left: int) -> int:
    return (x << left | x >> (32 - left)) & 0xFFFFFFFF


def digest(words: list, lead: list[int], n: int, second: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Of n blocks of 16 words the first and, if wanted, the second word of the digest, read from the left. The words are the
    sums of words (a number or n of them) and lead (numbers)."""
    a, b, c, d = _BEGIN
    start = 0
    while start < 16 and isinstance(words[start], int):  # the words of the prefix, which all blocks share
        f = d ^ (b & (c ^ d))
        a, b, c, d = d, (b + turned((f + a + _K[start] + words[start] + lead[start]) & 0xFFFFFFFF, _TURN[0][start % 4])) & 0xFFFFFFFF, b, c
        start += 1
    a, b, c, d = (np.full(n, x, np.uint32) for x in (a, b, c, d))
    t, u, v = (np.empty(n, np.uint32) for _ in range(3))
    for i in range(start, 64 if second else 61):  # the first word is made in step 60
        turn, at = i // 16, _WORD[i // 16](i)
        if turn == 0:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif turn == 1:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif turn == 2:
            if i == 32:
                np.bitwise_xor(c, d, out=v)
            np.bitwise_xor(v, b, out=t)
            np.bitwise_xor(b, c, out=v)  # the next step's c and d
        else:
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(t, a, out=t)
        word, more = words[at], lead[at] + _K[i]
        if isinstance(word, int):
            more += word
        else:
            np.add(t, word, out=t)
        np.add(t, np.uint32(more & 0xFFFFFFFF), out=t)
        left = _TURN[turn][i % 4]
        np.left_shift(t, np.uint32(left), out=u)
        np.right_shift(t, np.uint32(32 - left), out=t)
        np.bitwise_or(t, u, out=t)
        np.add(t, b, out=t)
        a, b, c, d, t = d, t, b, c, a
    if not second:
        return (b + np.uint32(_BEGIN[0])).byteswap(), None
    return (a + np.uint32(_BEGIN[0])).byteswap(), (b + np.uint32(_BEGIN[1])).byteswap()
