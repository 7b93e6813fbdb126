"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths,
and every piece is a sequence of its own in the bucket of its length, so no sequence holds
tokens of two documents and none needs padding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.llm.common import text_chunks

LONGEST = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
STEP_BYTES = 4 << 20
#: Entries of a worker's cache of encoded chunks, and letters of the texts that filled it; it starts anew when full.
CACHE, CACHE_LETTERS = 500_000, 64 << 20

# Fixed by the vocabulary file: its pre-tokenizer's pattern and its special tokens.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zA-ZªµºÀ-ÖØ-öø-ſ]+|[0-9²³¹¼½¾]|[^\\sa-zA-Z0-9ªµº²³¹¼½¾À-ÖØ-öø-ſ]+")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
#: Texts of other characters go to the library as they are: normalisation is an identity on these.
_OTHER = re.compile("[^\t-\r -~\xa0-įı-ſ‐-‧€]")


def _byte_letters() -> list[str]:
    """Byte-level BPE's letter for each byte: printable bytes stand for themselves, the others
    follow from code point 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class _Letters(dict):
    """str.translate table from characters to their bytes' letters."""

    def __init__(self):
        super().__init__()
        self.letters = _byte_letters()

    def __missing__(self, point: int) -> str:
        self[point] = "".join(self.letters[b] for b in chr(point).encode())
        return self[point]


class ChunkEncoder:
    """Ids of whole texts by a word-level BPE vocabulary, with chunks between white space cached.

    The vocabulary drops white space and joins no ids across it, so a text's ids are its
    chunks' ids in a row, and a chunk's are its words'. New words go to the vocabulary's
    model in one call and are told apart by the ids that end a word.
    """

    def __init__(self, path: str, size: int = CACHE):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = Tokenizer(self.library.model)
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        for token, k in self.library.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.letters = _Letters()
        self.size, self.held = size, 0

    def slow(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: set[str]) -> None:
        # a chunk of letters is one word; the others are cut into words, which are remembered too
        plain, cut, wanted = [], {}, set()
        for x in chunks:
            if x.isascii() and x.isalpha():
                plain.append(x)
            else:
                cut[x] = found = _PIECE.findall(x)
                wanted.update(found)
        words = list(wanted.difference(self.words))
        if len(self.words) + len(words) > self.size:
            self.words, words = {}, list(wanted)
        every = plain + [w if w.isascii() else w.translate(self.letters) for w in words]
        if every:
            ids = np.array(self.model.encode(every, is_pretokenized=True).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(every) or stops[-1] != len(ids):
                raise RuntimeError("the vocabulary does not end words as expected")
            raw, at = ids.tobytes(), [0, *(4 * stops).tolist()]
            parts = [raw[a:b] for a, b in zip(at, at[1:])]
            self.chunks.update(zip(plain, parts))
            self.words.update(zip(words, parts[len(plain) :]))
        get = self.words.__getitem__
        for x, found in cut.items():
            self.chunks[x] = b"".join(map(get, found))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            if _OTHER.search(text) or _SPECIAL.search(text):
                out.append(self.slow(text))
                continue
            words = text.lower().split()
            kinds = set(words)
            if missing := kinds.difference(self.chunks):
                if len(self.chunks) > self.size or self.held > CACHE_LETTERS:
                    self.chunks, self.words, missing, self.held = {}, {}, kinds, 0
                self.held += len(text)
                self.learn(missing)
            out.append(b"".join(map(self.chunks.__getitem__, words)))
        return out


def binary_pieces(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: as many of the longest as fit, then the
    binary digits of the rest, large ones first."""
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    size = longest >> 1
    while size:
        if (n - at) & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def _pieces(vocabulary: str, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = public_tokenizers.path(vocabulary)
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, ChunkEncoder(path))
        last = np.array([END_ID], "<u4").tobytes()
        for batch in text_chunks(batches, "text", STEP_BYTES):
            encoded = encoder.encode([x or "" for x in batch.column("text").to_pylist()])
            row, start, length, crc, total, parts = [], [], [], [], [], []
            for k, raw in enumerate(encoded):
                raw += last
                n = len(raw) // 4
                for a, size in binary_pieces(n):
                    piece = raw[4 * a : 4 * (a + size)]
                    row.append(k)
                    start.append(a)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if ids:
                        parts.append(piece)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if ids:
                flat = pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack_binary(docs: DataFrame, vocabulary: str = VOCABULARY, ids: bool = True) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): its place, its sequence, and its ids (if asked for).

    A null or blank text is its end id alone. Repeated rows are packed again. A sequence holds
    one piece, of 1 to 4096 ids in a power of two; the high bits of ``sequence_id`` are the
    bucket (the exponent), the low ones tell pieces apart, so a range of ids is a bucket.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    cut = docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, ids), schema)
    bucket = F.log2("length").cast("int")
    return cut.withColumn("bucket", bucket).withColumn("sequence_id", F.shiftleft(bucket.cast("long"), 56) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
