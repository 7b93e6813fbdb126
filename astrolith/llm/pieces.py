"""SentencePiece encoding and decoding: the best segmentation by the pieces' scores (the
unigram objective), by Viterbi over many words at once in numpy.

Words of one length advance together. Hashes of all their substrings are looked up among
the sorted hashes of the pieces, and the maximum over the pieces that end at a place is taken for all
words in one step, with the winning length as back-pointer. No piece goes on from a
letter into a space, so words are solved one by one; short ones are remembered. Long words, such as
texts without spaces, pass in blocks, so that the tables of their substrings stay small.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from astrolith.llm.common import mix, text_chunks

VOCABULARY = "piece_bpe_32k.model"
STEP_BYTES = 2 << 20
#: Words that are remembered, and letters of the longest of them.
CACHE, REMEMBERED = 300_000, 48
#: Cells (words times letters) whose substrings are looked up together.
CELLS = 1 << 17
SIEVE_BITS = 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    def __init__(self, path: str, cache: int = CACHE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        names = [model.id_to_piece(k) for k in range(n)]
        self.score = np.array([model.get_score(k) for k in range(n)])
        special = np.array([model.is_control(k) or model.is_unknown(k) or model.is_byte(k) for k in range(n)])
        self.bytes = np.zeros(256, np.uint32)
        self.raw: list[bytes] = [b""] * n
        for k, name in enumerate(names):
            if model.is_byte(k):
                self.bytes[int(name[1:-1], 16)] = k
                self.raw[k] = bytes([int(name[1:-1], 16)])
            elif not special[k]:
                self.raw[k] = name.replace("▁", " ").encode()
        plain = np.flatnonzero(~special)
        self.longest = max(len(names[k]) for k in plain)
        self.letters = np.zeros((n, self.longest), np.uint32)
        hashes = np.zeros(len(plain), np.uint64)
        for row, k in enumerate(plain.tolist()):
            points = np.frombuffer(names[k].encode("utf-32-le"), np.uint32)
            self.letters[k, : len(points)] = points
            *_, (_, last) = self._hashes(points[None, :], len(points))
            hashes[row] = last[0, 0]
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], plain[order]
        # the first key of those that begin with some bits, which lie side by side; most substrings find none
        slot = (self.keys >> np.uint64(64 - SIEVE_BITS)).astype(np.intp)
        self.first = np.full(1 << SIEVE_BITS, -1, np.int32)
        self.first[slot[::-1]] = np.arange(len(slot) - 1, -1, -1)
        self.most = int(np.bincount(slot).max())
        self.unknown = self.score[plain].min() - 10.0
        self.memory: dict[str, bytes] = {}
        self.size = cache

    @staticmethod
    def _hashes(points: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, hashes) of the substrings that start at each place of each row."""
        out = np.full(points.shape, 7, np.uint64)
        for length in range(1, longest + 1):
            count = points.shape[1] - length + 1
            out = out[:, :count] * _STEP
            out += points[:, length - 1 :]
            yield length, mix(out + np.uint64(length))

    def _tables(self, points: np.ndarray, low: int, high: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the pieces that end at the places from low to high - 1 (after their last
        letter), by where they begin, longest first; -1 where there is none."""
        first = max(0, low - longest)
        part = points[:, first : high - 1]
        ids = np.full((high - low, longest, len(points)), -1, np.int32)
        score = np.full(ids.shape, -np.inf)
        for length, h in self._hashes(part, min(longest, part.shape[1])):
            skip = max(0, low - length - first)  # pieces that end before the block
            h = h[:, skip:]
            head = self.first[(h >> np.uint64(64 - SIEVE_BITS)).astype(np.intp)]
            row, col = np.nonzero(head >= 0)
            key, at = h[row, col], head[row, col]
            for k in range(1, self.most):
                at = np.where(self.keys[np.minimum(at + 1, len(self.keys) - 1)] <= key, np.minimum(at + 1, len(self.keys) - 1), at)
            got = self.ids[at]
            same = self.keys[at] == key  # and a hash alone proves nothing
            for k in range(length):
                same &= self.letters[got, k] == part[row, col + skip + k]
            row, col, got = row[same], col[same], got[same]
            end = first + skip + length - low
            if length == 1:
                score[end : end + h.shape[1], longest - 1] = self.unknown
            ids[col + end, longest - length, row] = got
            score[col + end, longest - length, row] = self.score[got]
        return ids, score

    def viterbi(self, points: np.ndarray) -> list[bytes]:
        """Ids (little-endian uint32) of rows of code points, all of one length."""
        rows, n = points.shape
        longest = min(self.longest, n)
        best = np.full((longest + n + 1, rows), -np.inf)  # places count from ``longest``
        best[longest] = 0.0
        begin = np.zeros((n + 1, rows), np.int32)
        chosen = np.full((n + 1, rows), -1, np.int32)
        every = np.arange(rows)
        block = max(1, CELLS // rows)
        for low in range(1, n + 1, block):
            high = min(low + block, n + 1)
            ids, score = self._tables(points, low, high, longest)
            for end in range(low, high):
                total = best[end : end + longest] + score[end - low]
                pick = total.argmax(axis=0)  # on ties the longer piece stays
                best[longest + end] = total[pick, every]
                begin[end] = end - longest + pick
                chosen[end] = ids[end - low, pick, every]
        if rows == 1:
            return [self._one(points[0], begin[:, 0].tolist(), chosen[:, 0].tolist())]
        at = np.full(rows, n)
        steps = []
        while (at > 0).any():
            live = at > 0
            ids = np.where(live, chosen[at, every], -2)
            at = np.where(live, begin[at, every], 0)
            steps.append((ids, at))
        out = []
        grid = np.stack([s[0] for s in steps[::-1]], axis=1) if steps else np.zeros((rows, 0), np.int64)
        place = np.stack([s[1] for s in steps[::-1]], axis=1) if steps else grid
        hard = (grid == -1).any(axis=1)
        for k in range(rows):
            ids = grid[k]
            out.append(self._spelled(points[k], ids.tolist(), place[k].tolist()) if hard[k] else ids[ids >= 0].astype("<u4").tobytes())
        return out

    def _one(self, points: np.ndarray, begin: list[int], chosen: list[int]) -> bytes:
        ids, places, at = [], [], len(points)
        while at > 0:
            ids.append(chosen[at])
            at = begin[at]
            places.append(at)
        return self._spelled(points, ids[::-1], places[::-1])

    def _spelled(self, points: np.ndarray, ids: list[int], places: list[int]) -> bytes:
        """The ids, letters without a piece as pieces of their bytes."""
        parts: list[int] = []
        for i, p in zip(ids, places):
            if i == -1:
                parts += self.bytes[np.frombuffer(chr(points[p]).encode("utf-8", "replace"), np.uint8)].tolist()
            elif i >= 0:
                parts.append(i)
        return np.array(parts, "<u4").tobytes()

    def solve(self, words: set[str]) -> dict[str, bytes]:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        out: dict[str, bytes] = {}
        for n, group in by_length.items():
            step = max(1, CELLS // n)
            for a in range(0, len(group), step):
                part = group[a : a + step]
                points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
                out.update(zip(part, self.viterbi(points)))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. The model's normaliser is the identity: a space is put in front
        and spaces become the space letter."""
        cut = [_WORD.findall("▁" + x.replace(" ", "▁")) if x else [] for x in texts]
        wanted = {w for words in cut for w in words}
        if len(self.memory) > self.size:
            self.memory = {}
        fresh = self.solve(wanted.difference(self.memory))
        self.memory.update(fresh)
        get = self.memory.__getitem__
        out = [b"".join(map(get, words)) for words in cut]
        for w in fresh:
            if len(w) > REMEMBERED:
                del self.memory[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; broken UTF-8 from byte pieces becomes replacement characters."""
        raw = self.raw
        text = b"".join([raw[k] for k in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_WORD = re.compile("▁*[^▁]+|▁+")
_MODELS: dict[str, Pieces] = {}


def model(vocabulary: str = VOCABULARY) -> Pieces:
    import public_tokenizers

    path = public_tokenizers.path(vocabulary)
    return _MODELS.get(path) or _MODELS.setdefault(path, Pieces(path))


def _run(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(vocabulary)
        for batch in text_chunks(batches, "text", STEP_BYTES):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            encoded = pieces.encode(texts)
            decoded = [pieces.decode(x) for x in encoded]
            flat = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
            at = np.cumsum([0, *(len(x) // 4 for x in encoded)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array([zlib.crc32(x) for x in encoded], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                    pa.array([a.replace("▁", " ") == b for a, b in zip(texts, decoded)]),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                ],
                names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip", "ids"],
            )

    return run


def encode_pieces(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, round_trip, ids) of each row of ``docs``
    (doc_id, text): the ids of the whole text, and whether they decode to it again.

    A null or empty text has no ids. The file's pieces and scores are used as they stand; its
    scores are merge ranks, so ids are the best-scored segmentation, not the merge order's.
    Characters without a piece become byte pieces. The space letter itself reads as a space.
    Repeated rows are encoded again, with equal results. Texts are encoded whole.
    """
    return docs.select("doc_id", "text").mapInArrow(_run(vocabulary), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean, ids array<int>")
