"""Sets of hashed word shingles, computed over whole batches of texts with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text that are hashed at once; numbers of several times as many bytes are held meanwhile. A longer text is hashed piece by piece.
BLOCK_BYTES = 1 << 18
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_PLACES = _RANDOM.integers(1, 1 << 63, WIDTH, np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of each number depends on all of them."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (A-Z as a-z, cut at white space and where a text starts), and how many words come before each text."""
    if len(data) <= 2 * BLOCK_BYTES:
        return _piece_hashes(data, starts)
    space = np.flatnonzero(_SPACE[data])
    found, at, begin, words = [], np.zeros(len(starts), np.int64), 0, 0
    while begin < len(data):
        # A piece ends behind the first white space that makes it long enough.
        k = np.searchsorted(space, begin + BLOCK_BYTES)
        end = int(space[k]) + 1 if k < len(space) else len(data)
        own = (starts >= begin) & (starts < end)
        hashes, before = _piece_hashes(data[begin:end], starts[own] - begin)
        at[own] = words + before
        found.append(hashes)
        words += len(hashes)
        begin = end
    at[starts >= len(data)] = words
    return np.concatenate(found), at


def _piece_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    hashes = mixed((sums[end] - sums[begin]) * _powers(_INVERSE, len(data) + 1)[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, starts)


def sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of WIDTH words; of its words as one, if they are fewer."""
    out: list[np.ndarray] = []
    for a, b in _blocks(texts):
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        if not starts[-1]:
            out += [np.zeros(0, np.uint64)] * (b - a)
            continue
        hashes, at = _word_hashes(np.frombuffer(b"".join(data), np.uint8), starts)
        padded = np.concatenate([hashes, np.zeros(WIDTH, np.uint64)])
        whole = np.zeros(len(hashes), np.uint64)
        for k in range(WIDTH):
            whole += padded[k : k + len(hashes)] * _PLACES[k]
        whole = mixed(whole)
        for i, j in zip(at[:-1], at[1:], strict=True):
            if j - i >= WIDTH:
                out.append(np.unique(whole[i : j - WIDTH + 1]))
            elif j > i:
                few = np.sum(hashes[i:j] * _PLACES[: j - i], dtype=np.uint64) + np.uint64(j - i)
                out.append(mixed(np.array([few])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BLOCK_BYTES:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a)) if len(a) else 0


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
