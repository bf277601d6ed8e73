"""Word shingles of whole texts as 64-bit hashes, with numpy inside a task.

Words are runs of bytes other than space and \\x09-\\x0D after lower-casing A-Z; a document's set holds
the distinct hashes of its runs of five words, or of the whole sequence when there are fewer words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

K = 5
CHUNK = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype="uint8")
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype="uint64")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd number modulo 2**64, kept as far as they were needed."""

    def __init__(self, base: np.uint64):
        self.base, self.known = base, np.ones(1, dtype="uint64")

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            self.known = np.concatenate([self.known, self.known * (self.known[-1:] * self.base)])
        return self.known[:n]


POWERS, INVERSES = Powers(BASE), Powers(BASE_INVERSE)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte's position of every word of ``data``."""
    raw = LOWER[np.frombuffer(data, dtype="uint8")]
    inside = np.zeros(len(raw) + 2, dtype="int8")
    inside[1:-1] = ~SPACE[raw]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(raw) + 1, dtype="uint64")
    np.cumsum((raw.astype("uint64") + np.uint64(1)) * POWERS.upto(len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * INVERSES.upto(len(raw) + 1)[starts]), starts


def _parts(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(document, bytes) in order; a long text comes in several parts, cut at white space."""
    for i, data in enumerate(texts):
        at = 0
        while len(data) - at > 2 * CHUNK:
            end = at + CHUNK
            while end < len(data) and not SPACE[data[end]]:
                end += 1
            yield i, data[at:end]
            at = end
        yield i, data[at:]


def documents_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the document (position in ``texts``) of each."""
    hashes, owners = [np.empty(0, "uint64")], [np.empty(0, "int64")]
    group, size = [], 0

    def flush():
        got, starts = word_hashes(b" ".join(x for _, x in group))
        begins = np.concatenate([[0], np.cumsum([len(x) + 1 for _, x in group])[:-1]])
        hashes.append(got)
        owners.append(np.array([i for i, _ in group])[np.searchsorted(begins, starts, "right") - 1] if len(got) else np.empty(0, "int64"))

    for part in _parts(texts):
        group.append(part)
        size += len(part[1])
        if size >= CHUNK:
            flush()
            group, size = [], 0
    if group:
        flush()
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, owners = documents_words(texts)
    cuts = np.searchsorted(owners, np.arange(len(texts) + 1))
    runs = np.zeros(max(0, len(words) - K + 1), dtype="uint64")
    for j in range(K):
        runs += mix(words[j:j + len(runs)] * STEPS[j] + STEPS[(j + 1) % K])
    runs = mix(runs)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= K:
            out.append(np.unique(runs[a:b - K + 1]))
        elif b > a:
            short = np.array([b - a], dtype="uint64")
            for j in range(a, b):
                short = mix(words[j:j + 1] * STEPS[j - a] + short)
            out.append(short)
        else:
            out.append(np.empty(0, dtype="uint64"))
    return out
