"""Hashes of words and word windows of many texts at once, in numpy.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D) in the
UTF-8 form of a text. Its hash is a polynomial over the bytes modulo 2^64, then mixed.
All functions work on slices of bounded size, so a very long text needs 8 bytes per
word and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 21  # bytes hashed at a time
_U = np.uint64
_CACHE: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(33))
        x = x * _U(0xFF51AFD7ED558CCD)
        x ^= x >> _U(33)
        x *= _U(0xC4CEB9FE1A85EC53)
        x ^= x >> _U(33)
    return x


def _tables(size: int):
    have = _CACHE.get("powers")
    if have is None or len(have[0]) < size:
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = np.full(size, base, _U), np.full(size, inverse, _U)
            up[0] = down[0] = 1
            have = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
        _CACHE["powers"] = have
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        _CACHE["space"] = space
        _CACHE["byte"] = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
    return have[0], have[1], _CACHE["space"], _CACHE["byte"]


def _cuts(buf: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices that end at white space; one longer word makes its slice longer."""
    pos, n = 0, len(buf)
    while pos < n:
        end = min(pos + SLICE, n)
        while end < n and not space[buf[end]]:
            step = min(end + 4096, n)
            gap = np.flatnonzero(space[buf[end:step]])
            end = end + int(gap[0]) if len(gap) else step
        yield pos, end
        pos = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and hash of every word of ``data``."""
    buf = np.frombuffer(data, np.uint8)
    _, _, space, table = _tables(1024)
    starts, hashes = [], []
    for lo, hi in _cuts(buf, space):
        part = buf[lo:hi]
        up, down, space, table = _tables(max(SLICE, len(part)) + 1)
        inside = np.empty(len(part) + 2, np.int8)
        inside[0] = inside[-1] = 0
        inside[1:-1] = ~space[part]
        edge = np.diff(inside)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(a):
            continue
        with np.errstate(over="ignore"):
            total = np.empty(len(part) + 1, _U)
            total[0] = 0
            np.cumsum(table[part] * up[: len(part)], dtype=_U, out=total[1:])
            h = (total[b] - total[a]) * down[a]
            hashes.append(mix(h + (b - a).astype(_U)))
        starts.append(a + lo)
    if not starts:
        return np.empty(0, np.int64), np.empty(0, _U)
    return np.concatenate(starts), np.concatenate(hashes)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of every word, in order; words never span two texts."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    starts, hashes = word_hashes(b"\n".join(texts))
    return np.searchsorted(offsets, starts, side="right") - 1, hashes


def window_hashes(owner: np.ndarray, words: np.ndarray, k: int, n_owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every window of ``k`` words; an owner with fewer words has one window of all its words."""
    if not len(words):
        return owner, words
    with np.errstate(over="ignore"):
        factors = mix(np.arange(1, k + 1, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)
        counts = np.bincount(owner, minlength=n_owners)
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        padded = np.concatenate((words, np.zeros(k - 1, _U)))
        h = np.zeros(len(words), _U)
        for i in range(k):
            h += padded[i : i + len(words)] * factors[i]
        place = np.arange(len(words)) - first[owner]
        keep = place + k <= counts[owner]
        short = np.flatnonzero((counts > 0) & (counts < k))
        out_owner, out = owner[keep], mix(h[keep])
        if len(short):
            whole = []
            for d in short:
                w = words[first[d] : first[d] + counts[d]]
                whole.append((w * factors[: len(w)]).sum(dtype=_U) + _U(counts[d]))
            out_owner = np.concatenate((out_owner, short))
            out = np.concatenate((out, mix(np.array(whole, _U))))
    return out_owner, out


def distinct(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, hash) pairs, sorted by both."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[keep], h[keep]


def slices(texts: list, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most about ``limit`` characters together, one text at least."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
