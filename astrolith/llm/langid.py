"""Language of code-switched text by a linear-chain conditional random field.

Words are labelled with languages: a word's emission is the mean-scaled sum of the weights of
its character n-grams, affixes and lexicon entries; transitions are learned with them by
full-batch gradient on the exact conditional likelihood (forward-backward). Training
sequences join pieces of several documents, so that switches occur. A document's language
is the one with the largest mean posterior over its words.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.llm.common import least_hashes, text_chunks

#: Bounds of the training sample: whole labelled texts (those of the least hashes), and their bytes.
SAMPLE, SAMPLE_BYTES = 1000, 8 << 20
#: Words of the pieces that training sequences consist of, and pieces of a sequence.
PIECE, PIECES = (4, 24), 3
#: Words that forward-backward passes one after the other; segments of longer texts advance together.
SEGMENT = 512
SLOTS = 1 << 16
#: Occurrences that put a word in the lexicon, and the share of one language that files it there.
LEXICON_LEAST, LEXICON_SHARE = 3, 0.8
STEP_BYTES = 2 << 20
CACHE = 200_000
UNKNOWN = "und"


def _signs() -> str:
    """Ranges of the characters that count as alphanumeric but are neither letters nor decimal digits."""
    points = [k for k in range(128, sys.maxunicode + 1) if (c := chr(k)).isalnum() and not c.isalpha() and not c.isdecimal()]
    runs = [[k, k] for k in points[:1]]
    for k in points[1:]:
        if k == runs[-1][1] + 1:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


_WORD = re.compile(rf"[^\W\d_{_signs()}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all words in a row, and each word's first one: n-grams of one to three
    letters of ``^word$`` (those with a border mark are affixes), affixes of three letters
    with their mark, and the lexicon entry."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    left = ends[owner] - np.arange(len(points))  # letters to the word's end
    slots, owners = [], []
    h = np.zeros(len(points), np.uint64)
    shifted = np.concatenate([points, np.zeros(4, np.uint64)])
    for n in range(1, 5):
        h = (h + shifted[n - 1 : n - 1 + len(points)]) * _MIX
        h ^= h >> np.uint64(29)
        ok = left >= n
        if n == 4:  # only with a border mark: an affix of three letters
            at = np.arange(len(points))
            ok &= (at == starts[owner]) | (left == 4)
        slots.append((h[ok] >> np.uint64(48)).astype(np.int64))
        owners.append(owner[ok])
    known = [(k, lexicon[w]) for k, w in enumerate(words) if w in lexicon]
    slots.append(np.array([SLOTS + c for _, c in known], np.int64))
    owners.append(np.array([k for k, _ in known], np.int64))
    slot, own = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return slot[order], np.searchsorted(own[order], np.arange(len(words)))


def posteriors(emission: np.ndarray, transition: np.ndarray, initial: np.ndarray, lengths: np.ndarray, entry: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over ragged, non-empty sequences that lie in ``emission`` one after the other.
    Returns each word's label posteriors, the summed transition posteriors and each
    sequence's log-normaliser. All sequences take a step together, longest first, so
    those still running are a prefix. ``entry`` and ``leave`` weigh the labels of each sequence's first
    and last word by what lies before and behind, where it is a segment of a longer one."""
    count, k = len(lengths), emission.shape[1]
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    top = emission.max(axis=1, keepdims=True)
    local = np.exp(emission - top)
    move = np.exp(transition)
    first = np.exp(initial)[None, :] if entry is None else entry[order]
    ahead = np.empty_like(local)
    scale = np.empty(len(local))
    steps = int(lengths[0]) if count else 0
    live = np.searchsorted(-lengths, -np.arange(steps), "left")  # sequences longer than t
    for t in range(steps):
        at = begin[: live[t]] + t
        a = local[at] * (ahead[at - 1] @ move if t else first)
        s = a.sum(axis=1)
        ahead[at] = a / s[:, None]
        scale[at] = s
    behind = np.ones_like(local)
    if leave is not None:
        last = begin + lengths - 1
        behind[last] = leave[order] / (ahead[last] * leave[order]).sum(axis=1, keepdims=True)
    both = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        after = local[at + 1] * behind[at + 1] / scale[at + 1][:, None]
        behind[at] = after @ move.T
        both += ahead[at].T @ after
    logz = np.add.reduceat(np.log(scale) + top[:, 0], np.sort(begin)) if count else np.zeros(0)
    return ahead * behind, both * move, logz


def marginals(emission: np.ndarray, transition: np.ndarray, initial: np.ndarray, lengths: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Each word's label posteriors, as of ``posteriors``. Long sequences are cut: the products of
    all segments' steps are built together, carry the weights from segment to segment, and then all
    segments run at once."""
    if not len(lengths) or lengths.max() <= segment:
        return posteriors(emission, transition, initial, lengths)[0]
    k = emission.shape[1]
    cuts = -(-lengths // segment)
    owner = np.repeat(np.arange(len(lengths)), cuts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    sizes = np.minimum(segment, lengths[owner] - place * segment)
    begin = np.cumsum(sizes) - sizes
    move = np.exp(transition)
    wide = np.flatnonzero(cuts[owner] > 1)
    product = np.zeros((len(wide), k, k))
    order = wide[np.argsort(-sizes[wide], kind="stable")]
    for t in range(int(sizes[order[0]])):
        at = begin[order[: np.searchsorted(-sizes[order], -t, "left")]] + t
        local = np.exp(emission[at] - emission[at].max(axis=1, keepdims=True))
        now = (product[: len(at)] @ move if t else np.eye(k)[None]) * local[:, None, :]
        product[: len(at)] = now / now.max(axis=(1, 2), keepdims=True)
    where = np.full(len(owner), -1)
    where[order] = np.arange(len(order))
    entry, leave = np.tile(np.exp(initial), (len(owner), 1)), np.ones((len(owner), k))
    for s in wide.tolist():
        if place[s]:
            before = entry[s - 1] @ product[where[s - 1]] @ move
            entry[s] = before / before.sum()
    for s in wide[::-1].tolist():
        if place[s] < cuts[owner[s]] - 1:
            after = move @ product[where[s + 1]] @ leave[s + 1]
            leave[s] = after / after.sum()
    return posteriors(emission, transition, initial, sizes, entry, leave)[0]


class Tagger:
    def __init__(self, labels: list[str], lexicon: dict[str, int], weights: np.ndarray, transition: np.ndarray, initial: np.ndarray):
        self.labels, self.lexicon = labels, lexicon
        self.weights, self.transition, self.initial = weights, transition, initial

    def emissions(self, words: list[str]) -> np.ndarray:
        slot, first = features(words, self.lexicon)
        size = np.diff(np.append(first, len(slot)))
        return np.add.reduceat(self.weights[slot], first, axis=0) / np.sqrt(size)[:, None]


def train(rows: list[tuple[str, str]], rounds: int = 25, rate: float = 0.3, decay: float = 2e-4, seed: int = 11) -> Tagger | None:
    """A tagger from (text, language) pairs; None if there is nothing to learn."""
    labels = sorted({lang for _, lang in rows})
    texts = [(ws, labels.index(lang)) for text, lang in rows if (ws := [w.lower() for w in _WORD.findall(text)])]
    if not texts:
        return None
    k = len(labels)
    seen: dict[str, Counter] = {}
    for ws, c in texts:
        for w in ws:
            seen.setdefault(w, Counter())[c] += 1
    lexicon = {w: n.most_common(1)[0][0] for w, n in seen.items() if (total := n.total()) >= LEXICON_LEAST and n.most_common(1)[0][1] >= LEXICON_SHARE * total}
    vocabulary = {w: i for i, w in enumerate(seen)}
    slot, first = features(list(vocabulary), lexicon)
    size = np.sqrt(np.diff(np.append(first, len(slot))))
    rng = np.random.default_rng(seed)
    # every word of the texts once: pieces in random order, joined to sequences whose borders show switches
    parts = []
    for ws, c in texts:
        ends = np.cumsum(rng.integers(*PIECE, size=len(ws) // PIECE[0] + 1))
        cut = [0, *ends[ends < len(ws)].tolist(), len(ws)]
        parts += [(ws[a:b], c) for a, b in zip(cut, cut[1:])]
    words, tags, lengths = [], [], []
    for n, at in enumerate(rng.permutation(len(parts)).tolist()):
        ws, c = parts[at]
        words += [vocabulary[w] for w in ws]
        tags += [c] * len(ws)
        if n % PIECES:
            lengths[-1] += len(ws)
        else:
            lengths.append(len(ws))
    word, tag, lengths = np.array(words), np.array(tags), np.array(lengths)
    begins = np.cumsum(lengths) - lengths
    inner = np.setdiff1d(np.arange(1, len(word)), begins)
    wanted = np.zeros((k, k))
    np.add.at(wanted, (tag[inner - 1], tag[inner]), 1)
    opening = np.bincount(tag[begins], minlength=k)
    truth = np.eye(k)[tag]
    weights, transition, initial = np.zeros((SLOTS + k, k)), np.zeros((k, k)), np.zeros(k)
    moments = [np.zeros_like(weights), np.zeros_like(transition), np.zeros_like(initial)]
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(first, len(slot))))
    n = len(word)
    for _ in range(rounds):
        emission = np.add.reduceat(weights[slot], first, axis=0) / size[:, None]
        seen_as, moved, _ = posteriors(emission[word], transition, initial, lengths)
        miss = (truth - seen_as) / n
        per_word = np.stack([np.bincount(word, miss[:, c], len(vocabulary)) for c in range(k)], axis=1) / size[:, None]
        slope = np.stack([np.bincount(slot, per_word[owner, c], SLOTS + k) for c in range(k)], axis=1) - decay * weights / 100
        slopes = (slope, (wanted - moved) / n - decay * transition, (opening - seen_as[begins].sum(axis=0)) / n - decay * initial)
        for value, grad, moment in zip((weights, transition, initial), slopes, moments):
            moment += grad**2
            value += rate * grad / np.sqrt(moment + 1e-12)
    return Tagger(labels, lexicon, weights.astype(np.float32), transition, initial)


class _Reader:
    """A tagger with the emissions of the words it has met."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.tagger.labels)), np.float32)

    def read(self, texts: list[str]) -> list[tuple[str, float]]:
        words = [_WORD.findall(x.lower()) for x in texts]
        fresh = list({w for ws in words for w in ws}.difference(self.place))
        if len(self.place) + len(fresh) > CACHE:
            self.forget()
            fresh = list({w for ws in words for w in ws})
        if fresh:
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
            self.rows = np.concatenate([self.rows, self.tagger.emissions(fresh)])
        lengths = np.array([len(ws) for ws in words])
        some = np.flatnonzero(lengths)
        out = [(UNKNOWN, 0.0)] * len(texts)
        if len(some):
            get = self.place.__getitem__
            at = np.fromiter((get(w) for ws in words for w in ws), np.int64, int(lengths.sum()))
            seen = marginals(self.rows[at].astype(np.float64), self.tagger.transition, self.tagger.initial, lengths[some])
            sizes = lengths[some]
            mean = np.add.reduceat(seen, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            for k, m in zip(some.tolist(), mean):
                out[k] = (self.tagger.labels[int(m.argmax())], float(min(1.0, m.max())))
        return out


_READERS: dict[int, _Reader] = {}


def _predict(tagger: Tagger):
    key = zlib.crc32(tagger.weights.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _READERS.get(key)
        if reader is None:
            _READERS.clear()
            reader = _READERS[key] = _Reader(tagger)
        for batch in text_chunks(batches, "text", STEP_BYTES):
            found = reader.read([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out():
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Tagger | None:
    """Learn from ``sample`` distinct labelled texts that are not held out, the ones of the least
    hashes: a bounded sample of whole texts. Texts that would take it over ``most`` bytes are
    passed over; the smallest one always counts."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("text", "lang")
    mark = F.xxhash64("text", "lang")
    sizes = least_hashes(rows.select(mark.alias("mark"), F.octet_length("text").alias("size")), sample)
    picked, left = [], most
    for n, size in enumerate(sizes.column("size").to_pylist()):
        if size <= left:
            left -= size
            picked.append(n)
    if not picked and sizes.num_rows:
        picked = [int(sizes.column("size").to_numpy().argmin())]
    marks = [sizes.column("mark")[n].as_py() for n in picked]
    texts = rows.withColumn("mark", mark).where(F.col("mark").isin(marks)).dropDuplicates(["mark"]).select("text", "lang").collect() if marks else []
    return train(sorted((r.text, r.lang) for r in texts))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs`` (doc_id, text, lang).

    ``und`` with score 0 where the text is null or has no letter (a character of category L), or where
    there is nothing to learn from; repeated rows get equal results and count once in the sample; null
    ids are not held out; score is the mean posterior of the language. Long texts are read whole, their
    segments side by side.
    """
    tagger = fit(docs, sample)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    if tagger is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predict(tagger), "doc_id long, held_out boolean, lang_pred string, score double")
