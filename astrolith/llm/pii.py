"""Personal data: exact base kinds, credentials, and information-theoretic sanitisation of what gives them away.

A term t discloses the protected value e by its pointwise mutual information with it,
``log2(n(e,t) * N / (n(e) * n(t)))``, estimated from co-occurrence over all documents. The
value's own information is ``log2(N / n(e))``; a term that conveys at least ``GENERALISE``
of it is replaced by the general kind of word that it is wherever it stands in a document that
holds e, from ``REMOVE`` on it is cut out. Documents without e keep it: there it tells of nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.llm.common import KEY, SPANS, materialise, row_key, text_chunks

KINDS = ("email", "ip", "card", "phone", "secret", "term")
#: Kinds of the base, which are counted and make up the digest.
BASE = KINDS[:4]
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "secret": "<SECRET>", "term": "<TERM>"}
GENERALISE, REMOVE = 0.8, 0.95
#: Documents in which a term must occur with a value before the estimate counts as evidence.
SUPPORT = 2
STEP_BYTES = 2 << 20
#: Distinct terms, or pairs of values and terms, that a task counts before it hands on its partial sums.
HELD = 200_000

# Fixed patterns of the base kinds, in possessive form where that cannot change a match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"[^\W\d_]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > floor and text[low - 1] in _LOCAL_LETTERS:
            low -= 1
        found = _DOMAIN.match(text, at + 1) if low < at else None
        if found:
            yield low, found.end()
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, in order of start, then of kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if first := _DIGIT.search(text):
        low = first.start()
        for m in _IP.finditer(text, low):
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text, low):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


# Words that a credential is assigned to; its value has twelve signs or more, a digit among them.
_NAMES = ("password", "passwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "access-key")
_SECRET = re.compile(rf"(?:{'|'.join(_NAMES)})\s{{0,3}}[=:]\s{{0,3}}[\"']?(?=[A-Za-z0-9+/_-]*[0-9])([A-Za-z0-9+/_-]{{12,}})", re.IGNORECASE)


def all_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans and those of assigned credentials, in order of start, then of kind."""
    out = base_spans(text)
    low = text.lower()
    if any(name in low for name in _NAMES):
        out = sorted([*out, *(("secret", *m.span(1)) for m in _SECRET.finditer(text))], key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def _value(kind: str, text: str) -> int:
    """One key for a protected value, however it is written."""
    plain = text.lower() if kind in ("email", "ip") else text if kind == "secret" else "".join(c for c in text if c.isdigit())
    return np.uint64(xxhash.xxh3_64_intdigest(f"{kind}:{plain}")).view(np.int64).item()


def _values(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    return sorted({_value(kind, text[a:b]) for kind, a, b in spans})


def _outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """The terms that overlap no span (in order of start)."""
    k = reach = 0
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][1] < m.end():
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= m.start():
            yield m


_FOUND = "uid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, kinds array<string>, starts array<int>, ends array<int>, held array<long>, text string"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in text_chunks(batches, "text", STEP_BYTES):
        columns: list[list] = [[] for _ in range(10)]
        for text in batch.column("text").to_pylist():
            spans = all_spans(text) if text else []
            if not spans:
                row = (0, 0, 0, 0, nothing, [], [], [], [], None)
            else:
                count = Counter(k for k, _, _ in spans)
                row = (*(count[k] for k in BASE), hashlib.sha256(joined([x for x in spans if x[0] in BASE]).encode()).hexdigest(), *map(list, zip(*spans)), _values(text, spans), text)  # texts with spans only are read again
            for c, v in zip(columns, row):
                c.append(v)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["uid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "kinds", "starts", "ends", "held", "text"])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document frequencies of all terms."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

    for batch in text_chunks(batches, "text", STEP_BYTES):
        for text in batch.column("text").to_pylist():
            if text:
                held.update({t.lower() for t in set(_TERM.findall(text))})
        if len(held) > HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document frequencies of the terms with each of a document's ``held`` values."""
    held: dict[int, Counter] = defaultdict(Counter)
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for value, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([value] * len(counts), pa.int64()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["value", "term", "n"])

    for batch in text_chunks(batches, "text", STEP_BYTES):
        for text, values in zip(batch.column("text").to_pylist(), batch.column("held").to_pylist()):
            terms = {m[0].lower() for m in _outside(text, all_spans(text))}
            for value in values:
                size -= len(held[value])
                held[value].update(terms)
                size += len(held[value])
            if size > HELD:
                yield from out()
                held.clear()
                size = 0
    yield from out()


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(value, term, share): the terms that convey ``GENERALISE`` or more of a value's information.
    Both occur in a document wherever they stand in it; a term inside a base span is none."""
    holds = found.select("uid", F.explode("held").alias("value"))
    values = holds.groupBy("value").agg(F.count("*").alias("n_value")).where(f"n_value >= {SUPPORT}")
    total = docs.count()
    # a value in one document has no term with enough support; its texts go before they are read
    held = holds.distinct().join(values, "value").groupBy("uid").agg(F.collect_list("value").alias("held"))
    pairs = found.where("text is not null").select("uid", "text").join(held, "uid").select("text", "held").mapInArrow(_count_pairs, "value long, term string, n long")
    pairs = pairs.groupBy("value", "term").agg(F.sum("n").alias("n_both")).where(f"n_both >= {SUPPORT}")
    both = pairs.join(values, "value").where(f"n_value < {total}")
    share = lambda n_term: F.log2(F.col("n_both") * total / (F.col("n_value") * n_term)) / F.log2(total / F.col("n_value"))
    # a term stands in n_both documents at least: pairs that would not do even then go before the join
    both = materialise(both.where(share(F.col("n_both")) >= GENERALISE), "pairs")
    terms = docs.select("text").mapInArrow(_count_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return both.join(terms, "term").select("value", "term", share(F.col("n_term")).alias("share")).where(f"share >= {GENERALISE}")


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each text's ``told`` terms."""
    kind = pa.struct([("s", pa.int32()), ("order", pa.int32()), ("kind", pa.string()), ("e", pa.int32()), ("remove", pa.bool_())])
    order = KINDS.index("term")
    for batch in text_chunks(batches, "text", STEP_BYTES):
        out = []
        for text, told in zip(batch.column("text").to_pylist(), batch.column("told").to_pylist()):
            share = {x["term"]: x["share"] for x in sorted(told, key=lambda x: x["share"])}
            out.append([{"s": m.start(), "order": order, "kind": "term", "e": m.end(), "remove": share[t] >= REMOVE} for m in _outside(text, all_spans(text)) if (t := m[0].lower()) in share])
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(out, pa.list_(kind))], names=["uid", "extra"])


def personal_spans(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): uid, doc_id, counts and digest of the base
    spans, and ``spans``: all spans as structs (s, order, kind, e, remove), those of credentials and
    disclosing terms included. A null text is empty. Repeated rows count as documents of their own and
    get equal spans. Null ids stay. Texts are read whole."""
    docs = docs.select("doc_id", "text", row_key().alias("uid"))
    found = materialise(docs.select("uid", "doc_id", "text").mapInArrow(_find, _FOUND), "found")
    told = disclosures(docs, found)
    holds = found.select("uid", F.explode("held").alias("value")).distinct()
    told = holds.join(told, "value").groupBy("uid", "term").agg(F.max("share").alias("share")).groupBy("uid").agg(F.collect_list(F.struct("term", "share")).alias("told"))
    more = found.where("text is not null").select("uid", "text").join(told, "uid").select("uid", "text", "told").mapInArrow(_mark, "uid long, extra array<struct<s: int, order: int, kind: string, e: int, remove: boolean>>")
    more = more.dropDuplicates(["uid"])  # repeated rows share it
    kinds = F.array(*(F.lit(k) for k in KINDS))
    base = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.struct(x["starts"].alias("s"), (F.array_position(kinds, x["kinds"]) - 1).cast("int").alias("order"), x["kinds"].alias("kind"), x["ends"].alias("e"), F.lit(False).alias("remove")))
    both = found.join(more, "uid", "left")
    spans = F.array_sort(F.when(F.col("extra").isNull(), base).otherwise(F.concat(base, "extra")))
    return both.select("uid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


def span_text(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _label(kind: str, word: str) -> str:
    """What a span becomes; of a term what kind of word it is, by its capitals."""
    if kind != "term":
        return LABELS[kind]
    return "<NAME>" if word.istitle() else "<INITIALS>" if word.isupper() else LABELS[kind]


def _rewrite(names: list[str]):
    def clean(text: str | None, spans: list[dict] | None) -> str | None:
        if not text or not spans:
            return text
        out, at = [], 0
        for x in spans:
            if x["e"] <= at:
                continue
            # where spans overlap, one label stands for all of them
            if x["s"] >= at:
                out.append(text[at : x["s"]])
                out.append("" if x["remove"] else _label(x["kind"], text[x["s"] : x["e"]]))
            at = x["e"]
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", STEP_BYTES):
            texts = [clean(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column(SPANS).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == "text" else batch.column(k) for k in names], names=names)

    return run


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns: base spans become labels, disclosing terms are generalised
    or removed. Texts without spans stay as they are."""
    names = docs.columns
    spans = personal_spans(docs.select("doc_id", "text")).where("size(spans) > 0").dropDuplicates(["uid"]).select(F.col("uid").alias(KEY), F.col("spans").alias(SPANS))
    return docs.withColumn(KEY, row_key()).join(spans, KEY, "left").select(*names, SPANS).mapInArrow(_rewrite(names), docs.schema)
