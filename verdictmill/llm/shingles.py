"""Word shingles of whole texts as 64-bit hashes, computed with numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
_P, _Q = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_P_INVERSE = U(pow(int(_P), -1, 2**64))
#: Bytes of text that are hashed at once; a longer text is hashed alone, as a whole.
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


class _Powers:
    up = _powers(_P, 1)
    down = _powers(_P_INVERSE, 1)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_P, n), _powers(_P_INVERSE, n)


def _blocks(texts: Iterable[str]) -> Iterator[list[bytes]]:
    block, size = [], 0
    for text in texts:
        raw = text.encode().lower()  # bytes: A-Z alone
        if block and size + len(raw) > _BLOCK:
            yield block
            block, size = [], 0
        block.append(raw)
        size += len(raw) + 1
    if block:
        yield block


def word_hashes(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the number of words before each text (and in all)."""
    data = np.frombuffer(b"\n".join(block) + b"\n", np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(white.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(ends) and len(starts) and ends[0] < starts[0]:
        ends = ends[1:]
    _Powers.reach(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _Powers.up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _Powers.down[starts] + (ends - starts).astype(U))
    texts = np.cumsum([0, *(len(raw) + 1 for raw in block)])
    return hashes, np.searchsorted(starts, texts)


def shingle_sets(texts: Iterable[str], words: int = 5) -> Iterator[np.ndarray]:
    """Per text its distinct shingles, sorted; of fewer words the whole sequence; none without words."""
    for block in _blocks(texts):
        hashes, first = word_hashes(block)
        n = len(hashes)
        rolled = np.zeros(max(0, n - words + 1), U)
        for k, q in enumerate(_powers(_Q, words + 1)[1:]):
            rolled += hashes[k : k + len(rolled)] * q
        rolled = mix(rolled)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                yield mix((hashes[a:b] * _powers(_Q, 11 + b - a)[11:]).sum(keepdims=True, dtype=U) + U(b - a))
            else:
                yield np.zeros(0, U)
