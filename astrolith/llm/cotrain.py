"""Document quality by co-training: a classifier of the text's content and one of the page's
metadata learn from a bounded sample of labelled rows. In every round each of them scores all
documents and hands the other its surest pseudo-labels; in the end their calibrated views
are combined.

A document is fit for training if its quality label is 1 and its toxicity label is not 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolith.llm.common import joined_bytes, least_hashes, text_chunks
from astrolith.llm.shingles import word_hashes

#: Labelled rows that training reads at most (those of the least hashes).
LABELLED = 6000
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
#: Rounds of exchange, the chance from which a view is sure, and the pseudo-labels that it hands
#: over in a round: its surest ones among all documents.
ROUNDS, CONFIDENT, EXCHANGED = 3, 0.97, 400
#: Groups in which the surest documents are ranked before they are ranked together.
GROUPS = 64
#: Labelled rows kept out of training to calibrate on: every FOLD-th.
FOLD = 5
THRESHOLD = 0.4
STEP_BYTES = 2 << 20
_SMALL = 512
#: Bytes that part words: space and the signs around them.
_BREAKS = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r.,;:!?\"'()[]", np.uint8))
_SOLID = ~np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
#: Kinds of bytes that make up a page: digits, capitals, signs, line ends, spaces, and all others.
_KINDS = np.zeros(256, np.int64)
_KINDS[48:58], _KINDS[65:91], _KINDS[10], _KINDS[32] = 1, 2, 4, 5
_KINDS[np.frombuffer(b"!#$%&*+/<=>@\\^_`{|}~", np.uint8)] = 3
#: Page features and the greatest value of each.
_PAGE = {"size": 60, "digits": 20, "capitals": 20, "signs": 20, "lines": 20, "per line": 20, "word": 40, "variety": 20, "variety by size": 999}


def _slot(name: str, value: object) -> int:
    return zlib.crc32(f"{name}:{value}".encode("utf-8", "surrogatepass")) % _SMALL


_TABLES = {name: np.array([_slot(name, v) for v in range(most + 1)]) for name, most in _PAGE.items()}


class Views:
    """The two feature sets of a batch's documents: slots of ``content``, what is said, once
    each, and of the ``page``, its language, source, size and layout."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = joined_bytes(batch.column("text"))
        count = batch.num_rows
        words, bounds = word_hashes(data, offsets, breaks=_BREAKS)
        said = np.diff(bounds)
        key = np.unique(np.repeat(np.arange(count), said) * SLOTS + (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
        self.content, self.row = key & (SLOTS - 1), key >> SLOT_BITS
        size = np.diff(offsets)
        counts = np.bincount(np.repeat(np.arange(0, 6 * count, 6), size) + _KINDS[data], minlength=6 * count).reshape(-1, 6)
        digits, capitals, signs, lines, spaces = counts.T[1:]
        n = np.maximum(size, 1)
        kinds = np.bincount(self.row, minlength=count) / np.maximum(said, 1)
        values = {
            "size": 2 * np.log2(n), "digits": 40 * digits / n, "capitals": 25 * capitals / n, "signs": 60 * signs / n, "lines": np.log2(1 + lines), "per line": np.log2(1 + n / (1 + lines)),
            "word": n / (1 + spaces + lines), "variety": 20 * kinds, "variety by size": 20 * kinds + 32 * (np.log2(1 + said) / 2).astype(np.int64),
        }
        known = [np.array([_slot(c, v) for v in batch.column(c).to_pylist()], np.int64) for c in ("lang", "source")]
        self.page = np.stack([*known, *(_TABLES[k][np.minimum(v.astype(np.int64), _PAGE[k])] for k, v in values.items())], axis=1)
        self.blank = np.diff(np.concatenate([[0], np.cumsum(_SOLID[data])])[offsets]) == 0

    def __len__(self) -> int:
        return len(self.page)

    def sets(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return np.split(self.content, np.searchsorted(self.row, np.arange(1, len(self)))), list(self.page)

    def margins(self, models: list[Linear]) -> list[np.ndarray]:
        text, page = models
        return [text.margins(self.content, self.row, len(self)), page.weights[self.page].sum(axis=1) + page.bias]


class Linear:
    """Logistic regression on sets of slots, sparse by proximal full-batch steps."""

    def __init__(self, slots: int, shrink: float):
        self.weights, self.bias, self.shrink = np.zeros(slots), 0.0, shrink

    def margins(self, flat: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
        return np.bincount(rows, self.weights[flat], count) + self.bias

    def fit(self, sets: list[np.ndarray], target: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 0.3) -> Linear:
        flat, rows = _flat(sets)
        total = weight.sum()
        seen = np.zeros(len(self.weights)) + 1e-12
        seen_bias = 1e-12
        for _ in range(rounds):
            miss = weight * (target - 1 / (1 + np.exp(-np.clip(self.margins(flat, rows, len(sets)), -30, 30)))) / total
            slope = np.bincount(flat, miss[rows], len(self.weights))
            seen += slope**2
            seen_bias += miss.sum() ** 2
            step = rate / np.sqrt(seen)
            moved = self.weights + step * slope
            self.weights = np.sign(moved) * np.maximum(np.abs(moved) - step * self.shrink, 0)
            self.weights[seen < 1e-11] = 0
            self.bias += rate * miss.sum() / np.sqrt(seen_bias)
        return self


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*sets, np.zeros(0, np.int64)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


class CoTrained:
    """Both views after co-training, and the weights that calibrate and combine them."""

    def __init__(self, text_sets: list[np.ndarray], page_sets: list[np.ndarray], target: np.ndarray, ask: Callable):
        """``target``: 1 or 0. ``ask(models, quota, told)`` returns (view, label, key, sets): up to
        ``quota[label]`` documents of which ``models[view]`` is surest, without those that ``told[view]`` has."""
        fold = np.arange(len(target))[FOLD - 1 :: FOLD] if len(target) >= 2 * FOLD else np.arange(len(target))
        learn = np.setdiff1d(np.arange(len(target)), fold) if len(target) >= 2 * FOLD else fold
        pick = lambda sets, at: [sets[k] for k in at]
        own = (pick(text_sets, learn), pick(page_sets, learn))
        share = float(target[learn].mean())
        quota = {1.0: max(1, round(EXCHANGED * share)), 0.0: max(1, round(EXCHANGED * (1 - share)))}
        given: tuple[dict, dict] = ({}, {})
        for turn in range(ROUNDS + 1):
            models = []
            for view, (sets, more) in enumerate(zip(own, given)):
                labels = np.array([*target[learn], *(label for _, label in more.values())])
                weight = np.repeat([1.0, 0.5], [len(learn), len(more)])
                models.append(Linear(SLOTS if view == 0 else _SMALL, 2e-4 if view == 0 else 5e-5).fit([*sets, *(x for x, _ in more.values())], labels, weight))
            offers = ask(models, quota, [set(given[1 - view]) for view in (0, 1)]) if turn < ROUNDS else []
            if not offers:
                break
            # each view labels for the other what it is surest of, in the proportions of the labels
            for view, label, key, sets in offers:
                given[1 - view].setdefault(key, (sets[1 - view], label))
        self.text, self.page = models
        text = self.text.margins(*_flat(pick(text_sets, fold)), len(fold))
        page = self.page.margins(*_flat(pick(page_sets, fold)), len(fold))
        self.mix = self._calibrate(self._columns(text, page), target[fold])

    @staticmethod
    def _columns(text: np.ndarray, page: np.ndarray) -> np.ndarray:
        text, page = np.clip(text, -12, 12), np.clip(page, -12, 12)
        return np.stack([text, page, np.minimum(text, page), np.ones(len(text))], axis=1)

    @staticmethod
    def _calibrate(x: np.ndarray, target: np.ndarray, ridge: float = 0.1) -> np.ndarray:
        """Ridge logistic regression by Newton steps: views on one calibrated scale."""
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = _chance(x @ w)
            slope = x.T @ (target - p) - ridge * w
            curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(curve, slope)
            w += step / max(1.0, np.abs(step).max())
            if np.abs(step).max() < 1e-8:
                break
        return w

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The combined chance, and each view's, from the views' margins."""
        return _chance(self._columns(text, page) @ self.mix), _chance(text), _chance(page)

    def slim(self) -> CoTrained:
        self.text.weights = self.text.weights.astype(np.float32)
        return self


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, "text", STEP_BYTES):
        text, page = Views(batch).sets()
        yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(text, pa.list_(pa.int32())), pa.array(page, pa.list_(pa.int32()))], names=["mark", "content", "page"])


def _scorer(model: CoTrained):
    """A batch's combined scores, then each view's."""

    def score(batch: pa.RecordBatch) -> list[np.ndarray]:
        views = Views(batch)
        return [np.where(views.blank, 0.0, x) for x in model.scores(*views.margins([model.text, model.page]))]

    return score


def _score(model: CoTrained):
    score = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", STEP_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in score(batch))], names=["doc_id", "score", "p_content", "p_page"])

    return run


class _Surest:
    """The documents of which each view is surest, for each label at most its quota."""

    def __init__(self, models: list[Linear], quota: dict[float, int], told: list[set]):
        self.models, self.quota = models, quota
        self.told = [np.array(sorted(x), np.int64) for x in told]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(view, label): (np.zeros(0), np.zeros(0, np.int64)) for view in (0, 1) for label in self.quota}
        for batch in text_chunks(batches, "text", STEP_BYTES):
            views = Views(batch)
            marks = batch.column("mark").to_numpy()
            for view, margin in enumerate(views.margins(self.models)):
                fresh = ~views.blank & ~np.isin(marks, self.told[view])
                for label, n in self.quota.items():
                    sure = margin if label else -margin
                    ok = fresh & (_chance(sure) >= CONFIDENT)
                    if not ok.any():
                        continue
                    kept, first = np.unique(np.concatenate([held[view, label][1], marks[ok]]), return_index=True)  # copies count once
                    sure = np.concatenate([held[view, label][0], sure[ok]])[first]
                    top = np.lexsort([kept, -sure])[:n]
                    held[view, label] = sure[top], kept[top]
        for (view, label), (sure, kept) in held.items():
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array([view] * len(kept), pa.int32()), pa.array([label] * len(kept)), pa.array(sure), pa.array(kept)], names=["view", "label", "sure", "mark"])


def _features(rows: DataFrame, marks: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Both feature sets of the documents of some (boundedly many) marks."""
    got = rows.where(F.col("mark").isin(marks)).dropDuplicates(["mark"]).select("mark", "text", "lang", "source").mapInArrow(_featurise, "mark long, content array<int>, page array<int>").toArrow()
    sets = ([np.asarray(x.values.to_numpy(), np.int64) for x in got.column(c)] for c in ("content", "page"))
    return dict(zip(got.column("mark").to_pylist(), zip(*sets)))


def _asker(rows: DataFrame, known: set[int]) -> Callable:
    """Offers from all of ``rows`` (mark, text, lang, source) but the ``known`` marks."""

    def ask(models: list[Linear], quota: dict[float, int], told: list[set]) -> list[tuple]:
        found = rows.mapInArrow(_Surest(models, quota, [x | known for x in told]), "view int, label double, sure double, mark long")
        most = F.when(F.col("label") == 1, quota[1.0]).otherwise(quota[0.0])
        found = found.groupBy("view", "label", "mark").agg(F.max("sure").alias("sure"))
        for part in (["view", "label", F.pmod("mark", F.lit(GROUPS))], ["view", "label"]):
            order = Window.partitionBy(*part).orderBy(F.col("sure").desc(), "mark")
            found = found.withColumn("at", F.row_number().over(order)).where((F.col("at") <= max(quota.values())) & (F.col("at") <= most)).drop("at")
        offers = found.orderBy("view", "label", F.col("sure").desc(), "mark").collect()  # no more than twice EXCHANGED
        sets = _features(rows, sorted({r.mark for r in offers})) if offers else {}
        return [(r["view"], r.label, r.mark, sets[r.mark]) for r in offers]

    return ask


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> CoTrained | None:
    """Co-train from at most ``labelled`` distinct labelled rows, with pseudo-labels from all others;
    None without labels of both kinds."""
    judged = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    judged = judged.select("doc_id", F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1), 1.0).otherwise(0.0).alias("target"))
    rows = docs.where("text is not null").select("doc_id", "text", "lang", "source", F.xxhash64("text", "lang", "source").alias("mark"))
    # ids are picked before texts are read; the rows of an id, however many, are bounded in their turn
    picked = least_hashes(judged, labelled)
    some = F.broadcast(docs.sparkSession.createDataFrame(picked.to_pandas(), judged.schema))
    told = least_hashes(rows.select("doc_id", "mark").join(some, "doc_id").groupBy("mark").agg(F.min("target").alias("target")), labelled)
    target = dict(zip(told.column("mark").to_pylist(), told.column("target").to_pylist()))
    if set(target.values()) != {0.0, 1.0}:
        return None
    rows = rows.drop("doc_id")
    sets = _features(rows, sorted(target))
    order = sorted(target)  # by a hash of the content: the same at every run
    return CoTrained([sets[k][0] for k in order], [sets[k][1] for k in order], np.array([target[k] for k in order]), _asker(rows, set(order))).slim()


def _said() -> Column:
    return F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, p_content, p_page, kept) of each row of ``docs`` (doc_id, text, lang, source).

    score: calibrated chance that the document is fit; kept: at least ``THRESHOLD``. A null or
    blank text scores 0 and is not kept; without labels of both kinds all others score 1.
    Null languages and sources are values of their own; repeated rows get equal results, and count
    once in training. Labels of null ids and without quality tell nothing. Texts are read whole.
    """
    model = fit(docs, labels)
    rows = docs.select("doc_id", "text", "lang", "source")
    if model is None:
        score = F.when(_said(), 1.0).otherwise(0.0)
        found = rows.select("doc_id", score.alias("score"), score.alias("p_content"), score.alias("p_page"))
    else:
        found = rows.mapInArrow(_score(model), "doc_id long, score double, p_content double, p_page double")
    return found.withColumn("kept", F.col("score") >= THRESHOLD)


def _keep(model: CoTrained):
    score = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", STEP_BYTES):
            yield batch.filter(pa.array(score(batch)[0] >= THRESHOLD))

    return run


def keep_fit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their columns."""
    model = fit(docs, labels)
    if model is None:
        return docs.where(_said())
    return docs.mapInArrow(_keep(model), docs.schema)
