"""Suffix sorting in small memory: a difference-cover sample is ranked first, then one
suffix bucket at a time is sorted by its leading bytes, and ties that are longer than the
cover's period are resolved by the ranks of sample suffixes at a common distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from astrolith.llm.common import words_at


def difference_cover(period: int) -> np.ndarray:
    """Residues such that every difference modulo ``period`` is one between two of them."""
    found = [0]
    open_ = np.ones(period, bool)
    open_[0] = False
    residues = np.arange(period)
    while open_.any():
        old = np.array(found)
        # the residue whose differences to the chosen ones fill the most gaps
        gains = [len(set(np.flatnonzero(open_)) & {*((r - old) % period), *((old - r) % period)}) for r in residues]
        r = int(np.argmax(gains))
        found.append(r)
        open_[(r - old) % period] = False
        open_[(old - r) % period] = False
    return np.array(sorted(found))


def cover_distances(cover: np.ndarray, period: int) -> np.ndarray:
    """d[a, b]: the least distance after which suffixes at residues a and b are both sampled."""
    inside = np.zeros(period, bool)
    inside[cover] = True
    out = np.zeros((period, period), np.int64)
    for a in range(period):
        for b in range(period):
            out[a, b] = next(d for d in range(period) if inside[(a + d) % period] and inside[(b + d) % period])
    return out


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of integer keys, equal keys with equal ranks."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.empty(len(keys), np.int64)
    new[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]])) if len(keys) else 0
    return new


class CoverRanks:
    """Ranks of the sampled suffixes of ``text`` by their first ``depth`` bytes
    (None: by all of them). ``period`` is a multiple of 8; ``depth`` of ``period``.

    ``cover`` may be any set of residues that holds a common one for each pair of suffixes
    to be compared: [0] is enough where compared suffixes agree modulo the period.
    """

    def __init__(self, text: np.ndarray, period: int = 16, depth: int | None = None, cover: np.ndarray | None = None):
        self.n, self.period = len(text), period
        self.cover = difference_cover(period) if cover is None else np.asarray(cover)
        self.padded = np.concatenate([text, np.zeros(period + 8, np.uint8)])
        rows = self.n // period + 2
        at = (np.arange(rows)[:, None] * period + self.cover[None, :]).ravel()
        self.slot = np.full(period, -1, np.int64)
        self.slot[self.cover] = np.arange(len(self.cover))
        words = words_at(np.concatenate([self.padded, np.zeros(period + 8, np.uint8)])).byteswap()
        rank = np.zeros(len(at), np.int64)
        where = np.minimum(at, self.n)
        for k in range(0, period, 8):
            rank = _dense_pair(rank, _dense(words[where + k]))
        # a suffix that ends sooner sorts first even where the rest would be zero bytes
        rank = _dense_pair(rank, np.minimum(np.maximum(self.n - at, 0), period))
        width, have = len(self.cover), period
        self.steps = [have]
        while depth is None and len(rank) and rank.max() < len(rank) - 1 and have < self.n + period or depth is not None and have < depth:
            more = have if depth is None else min(have, depth - have)
            ahead = np.zeros(len(rank), np.int64)
            k = more // period * width
            ahead[: max(len(rank) - k, 0)] = rank[k:] + 1
            rank = _dense_pair(rank, ahead)
            have += more
            self.steps.append(have)
        self.rank = rank

    def of(self, at: np.ndarray) -> np.ndarray:
        """The ranks of sampled positions."""
        return self.rank[at // self.period * len(self.cover) + self.slot[at % self.period]]


def _dense_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _dense(a * (int(b.max()) + 1 if len(b) else 1) + b)


def suffix_array(text: bytes, period: int = 16) -> np.ndarray:
    """The order of all suffixes of ``text``. Memory beside the result: the sample's ranks
    and one bucket (the suffixes that start with one byte)."""
    data = np.frombuffer(text, np.uint8)
    ranks = CoverRanks(data, period)
    distance = cover_distances(ranks.cover, period)
    words = words_at(np.concatenate([data, np.zeros(period + 8, np.uint8)])).byteswap()
    out = []
    for first in range(256):
        at = np.flatnonzero(data == first)
        if not len(at):
            continue
        keys = [np.minimum(len(data) - at, period)] + [words[at + k] for k in range(period - 8, -1, -8)]
        order = np.lexsort(keys)
        at, keys = at[order], [k[order] for k in keys]
        same = np.ones(len(at) - 1, bool)
        for k in keys:
            same &= k[1:] == k[:-1]
        out.append(_ties(at, np.concatenate([[0], np.cumsum(~same)]), ranks, distance))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _ties(at: np.ndarray, group: np.ndarray, ranks: CoverRanks, distance: np.ndarray) -> np.ndarray:
    """Order within groups of suffixes that agree in their first ``period`` bytes. Each residue
    class is sorted by its own next sample, then classes are merged by binary search,
    where two suffixes are compared at the distance that suits both of their residues."""
    period = ranks.period

    def before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = distance[a % period, b % period]
        return ranks.of(a + d) < ranks.of(b + d)

    runs = []
    for residue in range(period):
        mine = np.flatnonzero(at % period == residue)
        if len(mine):
            k = ranks.of(at[mine] + distance[residue, residue])
            mine = mine[np.lexsort([k, group[mine]])]
            runs.append((at[mine], group[mine]))
    while len(runs) > 1:
        runs = [_merge(*runs[k], *runs[k + 1], before) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    return runs[0][0]


def _merge(a, ga, b, gb, before):
    low, high = np.searchsorted(ga, gb, "left"), np.searchsorted(ga, gb, "right")
    while (todo := np.flatnonzero(low < high)).size:
        middle = (low[todo] + high[todo]) // 2
        less = before(a[middle], b[todo])
        low[todo[less]] = middle[less] + 1
        high[todo[~less]] = middle[~less]
    place = low + np.arange(len(b))
    at, group = np.empty(len(a) + len(b), a.dtype), np.empty(len(a) + len(b), ga.dtype)
    rest = np.ones(len(at), bool)
    rest[place] = False
    at[place], group[place] = b, gb
    at[rest], group[rest] = a, ga
    return at, group


def repeated_starts(bucket: np.ndarray, place: np.ndarray, contexts: list[np.ndarray], starts: np.ndarray, depth: int, period: int = 16, most: int = 1 << 20) -> Iterator[tuple[int, int, int]]:
    """Which suffixes share their first ``depth`` bytes with another of their bucket.

    Context k lies in bucket ``bucket[k]``; its byte ``place[k]`` is the bucket's anchor, and
    its first ``starts[k]`` bytes start suffixes. Suffixes are compared where they lie at the
    same distance before the anchor, so contexts are laid out with their anchors at
    multiples of the period and one residue covers all that is compared. Yields
    (k, first, last) for runs of shared starts. ``most`` suffixes are sorted at a time.
    """
    sizes = np.array([len(c) for c in contexts])
    base = np.zeros(len(contexts), np.int64)
    end = 0
    for k, (size, p) in enumerate(zip(sizes.tolist(), place.tolist())):
        base[k] = end + (-(end + p)) % period
        end = base[k] + size
    text = np.zeros(end, np.uint8)
    for k, c in enumerate(contexts):
        text[base[k] : base[k] + sizes[k]] = c
    inner = depth // period * period - period  # sampled bytes in any suffix, wherever its next sample lies
    ranks = CoverRanks(text, period, inner, np.array([0]))
    words = words_at(np.concatenate([text, np.zeros(depth + 16, np.uint8)]))
    tail = range(inner, depth, 8)
    yield from _slices(bucket, place, starts, base, ranks, words, period, inner, depth, tail, most)


def _slices(bucket, place, starts, base, ranks, words, period, inner, depth, tail, most):
    far = int(place.max(initial=0)) + 1
    near = int((place - starts).min(initial=0))
    width = max(1, most // max(1, len(bucket)))
    shared: dict[int, list[np.ndarray]] = {}
    for low in range(near, far + 1, width):  # distances before the anchor, in [low, low + width)
        a = np.maximum(place - (low + width - 1), 0)
        b = np.minimum(place - low, starts - 1)
        count = np.maximum(b - a + 1, 0)
        total = int(count.sum())
        if not total:
            continue
        k = np.repeat(np.arange(len(bucket)), count)
        offset = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + a[k]
        at = base[k] + offset
        distance = place[k] - offset
        sample = at + (-at) % period
        key = bucket[k].astype(np.int64) * (far - near + 2) + (distance - near)
        key = _dense_pair(_dense(key), ranks.of(sample))
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        held = np.zeros(total, bool)
        held[1:] |= same
        held[:-1] |= same
        order = order[held]
        if not len(order):
            continue
        columns = [words[at[order]], words[at[order] + 8]] if period == 16 else [words[at[order] + d] for d in range(0, period, 8)]
        columns += [words[at[order] + d] for d in tail] + [ranked[held]]
        final = np.lexsort(columns)
        same = np.ones(max(len(final) - 1, 0), bool)
        for c in columns:
            c = c[final]
            same &= c[1:] == c[:-1]
        held = np.zeros(len(final), bool)
        held[1:] |= same
        held[:-1] |= same
        got = np.sort(order[final[held]])
        for j in np.split(got, np.flatnonzero(np.diff(k[got])) + 1) if len(got) else []:
            shared.setdefault(int(k[j[0]]), []).append(offset[j])
    for k, offsets in shared.items():
        o = np.sort(np.concatenate(offsets))
        gaps = np.flatnonzero(np.diff(o) > 1)
        for first, last in zip(o[np.concatenate([[0], gaps + 1])].tolist(), o[np.concatenate([gaps, [len(o) - 1]])].tolist()):
            yield k, first, last
