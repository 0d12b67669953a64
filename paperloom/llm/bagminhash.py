"""BagMinHash signatures of word-shingle multisets, and exact multiset overlap.

Every shingle has one Poisson process for each shell of weights (0, 1], (1, 2], (2, 4] and
so on. A process of rate equal to the shell's size marks points in time; each point falls
into a register and, by further bits, onto one integer weight of its shell. A text uses
the points at or below its shingle's multiplicity, and a register holds the earliest. Two
texts agree in a register with a probability of exactly their weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
#: Characters that are worked on at once.
CHUNK = 1_000_000

_GOLDEN, _M1, _M2, _P = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x2545F4914F6CDD1D))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def forget() -> None:
    """Give the words' memory back, for a worker goes on to other work."""
    _words.clear()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-case words between ASCII white space."""
    words = text.lower().encode("utf-8", "replace").split() if text else []
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def _shingles(w: np.ndarray) -> np.ndarray:
    """A hash for each run of five words; all words are one shingle where there are fewer."""
    if len(w) < SHINGLE:
        h = np.zeros(min(1, len(w)), dtype=np.uint64) + np.uint64(len(w))
        for x in w:
            h = h * _P + x
        return _mix(h)
    n = len(w) - SHINGLE + 1
    h = w[:n]
    for k in range(1, SHINGLE):
        h = h * _P + w[k : k + n]
    return _mix(h)


def multiset(text: str | None) -> np.ndarray:
    """Sorted numbers that stand for (shingle, occurrence): set overlap is multiset overlap."""
    s = np.sort(_shingles(word_hashes(text)))
    if len(s) < 2:
        return s
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    nth = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    if nth.any():
        s = np.sort(np.where(nth > 0, _mix(s + nth.astype(np.uint64) * _GOLDEN), s))
    return s


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets as ``multiset`` gives them; 0 if both are empty."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def signatures(texts: list[str | None], registers: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts x registers, bits of times) and whether a text has words at all."""
    found, have = np.zeros((len(texts), registers), dtype=np.uint64), np.zeros(len(texts), dtype=bool)
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHUNK):
            chars += len(texts[end] or "")
            end += 1
        parts = [_shingles(word_hashes(t)) for t in texts[at:end]]
        sizes = np.array([len(p) for p in parts])
        for p in parts:
            p.sort()
        have[at:end] = sizes > 0
        if sizes.sum():
            found[at:end] = _chunk(np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes), len(parts), registers)
        at = end
    return found, have


def _chunk(shingle: np.ndarray, doc: np.ndarray, docs: int, registers: int) -> np.ndarray:
    new = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])))
    start = np.flatnonzero(new)
    weight = np.diff(np.append(start, len(shingle)))
    shingle, doc = shingle[start], doc[start]
    total = np.bincount(doc, weights=weight, minlength=docs)
    # one row for each shell that the multiplicity reaches
    keys, owners, weights, shells = [shingle], [doc], [weight], [np.zeros(len(doc), dtype=np.int64)]
    shell, rest = 1, np.flatnonzero(weight > 1)
    while len(rest):
        keys.append(_mix(shingle[rest] + np.full(len(rest), shell, dtype=np.uint64) * _M2))
        owners.append(doc[rest])
        weights.append(weight[rest])
        shells.append(np.full(len(rest), shell))
        rest = rest[weight[rest] > 1 << shell]
        shell += 1
    rows = tuple(map(np.concatenate, (keys, owners, weights, shells)))
    times = np.full((docs, registers), np.inf)
    with np.errstate(divide="ignore"):
        until = registers * (np.log(registers) + 4) / np.where(total > 0, total, np.inf)
    todo = np.arange(docs)
    while len(todo):
        # every point up to this time is drawn; a text whose registers are all set is done
        wanted = np.zeros(docs, dtype=bool)
        wanted[todo] = True
        _points(*(x[wanted[rows[1]]] for x in rows), until, times)
        todo = todo[np.isinf(times[todo]).any(axis=1) & (total[todo] > 0)]
        until[todo] *= 2
    return times.view(np.uint64)


def _points(key: np.ndarray, doc: np.ndarray, weight: np.ndarray, shell: np.ndarray, until: np.ndarray, times: np.ndarray) -> None:
    registers, flat = np.uint64(times.shape[1]), times.reshape(-1)
    size = np.where(shell > 0, 1 << np.maximum(shell - 1, 0), 1)
    partial = (shell > 0) & ((1 << shell) > weight)
    x, limit, base = np.zeros(len(key)), until[doc], doc * int(registers)
    step = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(key):
            step += np.uint64(1)
            r = _mix(key + step * _GOLDEN)
            x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / size
            live = x <= limit
            key, weight, size, partial, x, limit, base, r = (v[live] for v in (key, weight, size, partial, x, limit, base, r))
            r = _mix(r ^ _P)
            place = base + (r % registers).astype(np.int64)
            if partial.any():
                # bits above choose halves of the shell, again and again, down to one weight
                level = size + 1 + ((r >> np.uint64(32)).astype(np.int64) & (size - 1))
                used = ~partial | (level <= weight)
                np.minimum.at(flat, place[used], x[used])
            else:
                np.minimum.at(flat, place, x)


def bands(found: np.ndarray, number: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature; bands have different keys."""
    with np.errstate(over="ignore"):
        f = found[:, : number * rows].reshape(len(found), number, rows)
        h = np.arange(number, dtype=np.uint64) + np.uint64(1)
        h = np.broadcast_to(h, (len(found), number))
        for k in range(rows):
            h = _mix(h * _P + f[:, :, k])
        return h.view(np.int64)
