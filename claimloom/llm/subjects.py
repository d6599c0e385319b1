"""The subject areas of each document.

Complement naive Bayes over hashed words and word pairs, trained from labelled documents and refined by
expectation-maximization over all documents, sentence by sentence: a sentence's posterior combines its own words with
the areas of its document, so that what stands in documents of every area stays without weight. Each area's posterior
is then calibrated by itself on labelled documents held out of the training; that labels are incomplete and partly wrong
is part of the fit. A sentence belongs to every area whose posterior reaches SURE. A document deals with an area that at least a fifth of its sentences with an area belong to.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codepoints as cps

#: Buckets of hashed features; fixes the model's size at any corpus size.
DIM = 1 << 18
#: Labelled rows the first model is trained on at most (a share of the documents, by hash); the refinement covers all documents.
TRAIN_LABELS = 50_000
ROUNDS = 3
#: Smoothing of the complement counts, as a share of all counts: features rarer than that say little.
ALPHA = 1e-6
#: In refining, the power of a sentence's own evidence beside that of its document's other sentences. Low, or a
#: sentence of no area would talk itself into one.
OWN = 0.3
#: A document deals with an area that has at least 1 / PART of its sentences with an area.
PART = 5
#: Words that a line without an end mark needs to pass for a sentence; headings have fewer.
LINE_WORDS = 7
#: In training, a document with more sentences than this counts as one with so many: no long text outweighs the corpus.
FULL = 50
#: Posterior from which a sentence belongs to an area, and the part of its features that must speak for it: a long
#: sentence of no area may hold a few words of one.
SURE, SPEAKING = 0.7, 0.12
#: One labelled document in HELD (by hash) is kept from the training, for the calibration.
HELD = 5
_BINS, _LOW, _HIGH = 120, -20.0, 40.0
#: Buckets of one row of sums on their way to the driver.
_PART = 1 << 12
_LETTER, _JOIN, _END, _CLOSE, _LINE, _BLANK, _UPPER = 1, 2, 4, 8, 16, 32, 64


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """What each code point is, as flags, and its lower case; characters beyond the tables are none of them."""
    kind, low = np.zeros(0x30000, np.uint8), np.arange(0x30000, dtype=np.uint32)
    for o in (*range(0xD800), *range(0xE000, 0x30000)):
        c = chr(o)
        cat = unicodedata.category(c)
        if cat[0] in "LM":
            kind[o] = _LETTER | (_UPPER if cat == "Lu" else 0)
            x = c.lower()
            if len(x) == 1:
                low[o] = ord(x)
        elif c in "'’-":
            kind[o] = _JOIN | (_CLOSE if c == "’" else 0)
        elif c in ".!?।":
            kind[o] = _END
        elif c in "\"”»)":
            kind[o] = _CLOSE
        elif c in "\r\n":
            kind[o] = _LINE | _BLANK
        elif c.isspace():
            kind[o] = _BLANK
    return kind, low


_POWER = np.cumprod(np.full(256, 0x100000001B3, np.uint64), dtype=np.uint64)


def features(texts: pa.Array, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature buckets of all sentences, start of each sentence among them, document of each sentence).

    Taken `step` texts at a time, so that the arrays stay in the processor's caches.
    """
    parts, n = [], 0
    for k in range(0, len(texts), step):
        f, start, doc = _features(texts.slice(k, step))
        parts.append((f, start + n, doc + k))
        n += len(f)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature buckets of all sentences, start of each sentence among them, document of each sentence).

    Words are runs of letters and marks, joined by apostrophes and hyphens between letters. A sentence ends with an end
    mark before a blank, or is a line of LINE_WORDS words. Capitalised words inside a sentence are names, which tell no
    subject, and are left out. Code points of all texts are handled as one array.
    """
    empty = np.empty(0, np.int64)
    cp, off = cps.explode(texts)
    if not len(cp):
        return empty, empty, empty
    kinds, low = _kinds()
    cp = np.where(cp < 0x30000, cp, 0)
    # a line end between texts keeps them apart
    n_text = len(off) - 1
    row = cps.rows_of(off)
    cp = np.insert(cp, off[1:], 10)
    doc_of = np.insert(row, off[1:], np.arange(n_text))
    k = kinds[cp]
    letter = (k & _LETTER) > 0
    after = np.r_[letter[1:], False]
    word = letter | ((k & _JOIN) > 0) & np.r_[False, letter[:-1]] & after
    i = np.nonzero(word)[0]
    if not len(i):
        return empty, empty, empty
    opens = np.r_[True, i[1:] != i[:-1] + 1]
    start = np.nonzero(opens)[0]
    size = np.diff(np.r_[start, len(i)])
    place = np.arange(len(i)) - np.repeat(start, size)
    h = np.add.reduceat(low[cp[i]].astype(np.uint64) * _POWER[place & 255], start)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    upper = np.add.reduceat(((k[i] & _UPPER) > 0).astype(np.int32), start)
    name = ((k[i[start]] & _UPPER) > 0) & (upper == 1) & (size > 1)
    stop = (k & _END) > 0
    closing = np.r_[(k[1:] & (_BLANK | _CLOSE)) > 0, True]
    mark = np.nonzero(stop & closing | ((k & _LINE) > 0))[0]
    part = np.searchsorted(mark, i[start])  # the mark that ends the word's run; each text ends with one
    new = np.r_[True, part[1:] != part[:-1]]
    words = np.bincount(part, minlength=len(mark))
    good = (words > 1) & (stop[mark] | (words >= LINE_WORDS))
    use = good[part] & (~name | new)
    h, p, at = h[use], part[use], i[start][use]
    if not len(h):
        return empty, empty, empty
    first = np.nonzero(np.r_[True, p[1:] != p[:-1]])[0]
    n = np.diff(np.r_[first, len(h)])
    pair = h.copy()
    pair[:-1] += h[1:] * np.uint64(0xBF58476D1CE4E5B9)
    pair *= np.uint64(0x94D049BB133111EB)
    both = np.empty(2 * len(h), np.int64)
    both[0::2] = (h >> np.uint64(40)) % np.uint64(DIM)
    both[1::2] = (pair >> np.uint64(40)) % np.uint64(DIM)
    keep = np.ones(len(both), bool)
    keep[2 * (first + n) - 1] = False  # a sentence's last word begins no pair
    return both[keep], 2 * first - np.arange(len(first)), doc_of[at[first]]


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def weights(counts: np.ndarray) -> np.ndarray:
    """Complement naive Bayes: how much less usual a feature is outside an area, against the mean of all areas."""
    other = counts.sum(1, keepdims=True) - counts
    total = other.sum(0, keepdims=True, dtype=np.float64)
    alpha = 1.0 + ALPHA * counts.sum(dtype=np.float64)
    other += np.float32(alpha)  # in place: the arrays are all that a round keeps on the driver
    other /= (total + alpha * len(counts)).astype(np.float32)
    np.log(other, out=other)
    np.negative(other, out=other)
    other -= other.mean(1, keepdims=True)
    return other


def _scores(w: np.ndarray, f: np.ndarray, start: np.ndarray, speaking: np.ndarray | None = None) -> np.ndarray:
    """The score of each area for each sentence; `speaking`, if given, is filled with how many features speak for it."""
    out, ends = np.empty((len(start), w.shape[1]), np.float32), np.r_[start, len(f)]
    for k in range(0, len(start), 512):  # few enough sentences for the processor's caches
        j = min(k + 512, len(start))
        x, at = w[f[ends[k]:ends[j]]], start[k:j] - ends[k]
        out[k:j] = np.add.reduceat(x, at, axis=0)
        if speaking is not None:
            speaking[k:j] = np.add.reduceat((x > 1.0).view(np.int8), at, axis=0, dtype=np.int32)
    return out


def _posterior(s: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """The areas of each sentence, mostly from the other sentences of its document and a little from its own words.

    A sentence alone in its document has only its own words to go by, at their low power.
    """
    k = s.shape[1]

    def by_document(p: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(doc, p[:, a], docs) for a in range(k)], 1)[doc]

    p = _softmax(s)
    for _ in range(2):
        p = _softmax(s + np.log(by_document(p) + 0.05))
    others = np.clip(by_document(p) - p, 0, None) + 1e-3
    y = others / others.sum(1, keepdims=True) * p**OWN
    return y / np.maximum(y.sum(1, keepdims=True), 1e-12)


def _sums(df: DataFrame, run, areas: int, size: int) -> np.ndarray:
    """Sums by bucket over all partitions; `size` x `areas` numbers reach the driver, whatever the corpus.

    A task sends the buckets that it has, packed; a group of buckets is summed up as its rows stream in.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros((_PART, areas)), 0
        for b in batches:
            for part, at, value in zip(*[c.to_pylist() for c in b.columns], strict=True):
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(value, np.float32).reshape(-1, areas)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part", "value"])

    got = df.mapInArrow(run, "part int, at binary, value binary").groupBy("part").applyInArrow(merge, "part int, value binary").toArrow()
    out = np.zeros((-(-size // _PART) * _PART, areas), np.float32)
    for part, value in zip(got.column("part").to_pylist(), got.column("value").to_pylist(), strict=True):
        out[part * _PART:(part + 1) * _PART] = np.frombuffer(value, np.float32).reshape(-1, areas)
    return out[:size]


def _emit(total: np.ndarray) -> pa.RecordBatch:
    """The sums of a task; a value of single precision is enough, as thousands of tasks are added in double."""
    parts, places, values = [], [], []
    for k in range(0, len(total), _PART):
        t = total[k:k + _PART]
        i = np.nonzero(t.any(1))[0]
        if len(i):
            parts.append(k // _PART)
            places.append(i.astype(np.uint16).tobytes())
            values.append(t[i].astype(np.float32).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["part", "at", "value"])


def _count(f: np.ndarray, start: np.ndarray, doc: np.ndarray, p: np.ndarray, total: np.ndarray) -> None:
    sentence = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(f)]))
    p = np.ascontiguousarray((p * np.minimum(1.0, FULL / np.bincount(doc)[doc])[:, None]).T)
    for a in range(len(p)):
        total[:, a] += np.bincount(f, p[a][sentence], DIM)


def _labelled(documents: DataFrame, labels: DataFrame, areas: list[str], held: bool, most: int) -> DataFrame:
    """(text, a0, a1, ...): the documents with labels and how many rows give them each area, held out of the training or not; at most about `most` labels."""
    of = F.pmod(F.xxhash64(F.lit("held"), F.col("doc_id")), F.lit(HELD)) == 0
    rows = labels.where(F.col("area").isin(*areas) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "area").where(of if held else ~of)
    n = rows.count()
    if n > most:  # a share of about `most` rows, by hash
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    each = rows.groupBy("doc_id").pivot("area", areas).count().na.fill(0)
    each = each.select("doc_id", *[F.col(f"`{a}`").cast("double").alias(f"a{k}") for k, a in enumerate(areas)])
    return documents.join(F.broadcast(each), "doc_id").select("text", *[f"a{k}" for k in range(len(areas))])  # about `most` short rows at the most


def first_counts(documents: DataFrame, labels: DataFrame, areas: list[str], most: int = TRAIN_LABELS) -> np.ndarray:
    """Feature counts by area from labelled documents; a document's labels share it in proportion to their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIM, len(areas)), order="F")
        for b in batches:
            share = np.stack([b.column(k + 1).to_numpy() for k in range(len(areas))], 1)
            share = share / np.maximum(share.sum(1, keepdims=True), 1e-9)
            f, start, doc = features(b.column(0))
            if len(f):
                _count(f, start, doc, share[doc], total)
        yield _emit(total)

    return _sums(_labelled(documents, labels, areas, False, most), run, len(areas), DIM)


def refine(documents: DataFrame, w: np.ndarray) -> np.ndarray:
    """One round of expectation-maximization over all documents: new feature counts."""
    areas, held = w.shape[1], documents.sparkSession.sparkContext.broadcast(w)  # DIM x areas numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = held.value, np.zeros((DIM, areas), order="F")
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                f, start, doc = features(part.column(0))
                if len(f):
                    _count(f, start, doc, _posterior(_scores(w, f, start), doc, part.num_rows), total)
        yield _emit(total)

    out = _sums(documents.select("text"), run, areas, DIM)
    held.destroy()  # the weights of this round are needed no more
    return out


def calibrate(documents: DataFrame, labels: DataFrame, areas: list[str], w: np.ndarray, most: int = TRAIN_LABELS) -> tuple[np.ndarray, float]:
    """((areas, 2), error): slope and offset of each area's own logistic posterior, and the expected calibration error.

    Fitted to whether held-out labels give the area to the documents of the sentences, by score. A label may be missing
    or wrong, and a labelled document has sentences of other areas, so the share of documents so labelled runs from a
    floor to a ceiling, both fitted for all areas in common; the posterior is the part between. Slopes and offsets are
    drawn a little towards the common ones, as an area may have few labels.
    """
    held, k = documents.sparkSession.sparkContext.broadcast(w), len(areas)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * _BINS, k))
        for b in batches:
            given = np.stack([b.column(a + 1).to_numpy() for a in range(k)], 1) > 0
            f, start, doc = features(b.column(0))
            if not len(f):
                continue
            s = _scores(held.value, f, start)
            weight = np.minimum(1.0, FULL / np.bincount(doc)[doc])
            i = np.clip(((s - _LOW) / (_HIGH - _LOW) * _BINS).astype(int), 0, _BINS - 1)
            for a in range(k):
                total[:_BINS, a] += np.bincount(i[:, a], weight, _BINS)
                total[_BINS:, a] += np.bincount(i[:, a], given[doc, a] * weight, _BINS)
        yield _emit(total)

    got = _sums(_labelled(documents, labels, areas, True, most), run, k, 2 * _BINS).astype(np.float64)
    held.destroy()
    n, y = got[:_BINS], got[_BINS:]
    x = (_LOW + (np.arange(_BINS) + 0.5) * (_HIGH - _LOW) / _BINS)[:, None] / 10
    # floor and ceiling as log odds, then common slope and offset, then what each area adds to them
    theta = np.concatenate([[-2.0, 2.0, 5.0, -3.0], np.zeros(2 * k)])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, 3001):  # gradient steps with momentum on the binned likelihood
        low, top = 1 / (1 + np.exp(-theta[:2]))
        p = 1 / (1 + np.exp(-np.clip(x * (theta[2] + theta[4:4 + k]) + theta[3] + theta[4 + k:], -30, 30)))
        q = np.clip(low + (top - low) * p, 1e-6, 1 - 1e-6)
        d = (n * q - y) / (q * (1 - q)) / max(n.sum(), 1.0)
        dz = d * (top - low) * p * (1 - p)
        g = np.concatenate([[(d * (1 - p)).sum() * low * (1 - low), (d * p).sum() * top * (1 - top), (dz * x).sum(), dz.sum()], (dz * x).sum(0) + 1e-3 * theta[4:4 + k] / k, dz.sum(0) + 1e-3 * theta[4 + k:] / k])
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        theta -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    error = float(np.abs(n * q - y).sum() / max(n.sum(), 1.0))
    return np.stack([(theta[2] + theta[4:4 + k]) / 10, theta[3] + theta[4 + k:]], 1), error


class Classifier:
    """Areas, feature weights, calibration and its error on held-out labels."""

    def __init__(self, areas: list[str], w: np.ndarray, curve: np.ndarray, error: float = 0.0):
        self.areas, self.w, self.curve, self.error = areas, w, curve, error

    def sentences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(document, posterior of each area) of every sentence; 0 where too few features speak for the area."""
        f, start, doc = features(texts)
        if not len(f):
            return doc, np.empty((0, len(self.areas)))
        speaking = np.empty((len(start), len(self.areas)), np.int32)
        s = _scores(self.w, f, start, speaking)
        p = 1 / (1 + np.exp(-np.clip(s * self.curve[:, 0] + self.curve[:, 1], -30, 30)))
        return doc, np.where(speaking >= SPEAKING * np.diff(np.r_[start, len(f)])[:, None], p, 0.0)


def train(documents: DataFrame, labels: DataFrame, subject_areas: DataFrame, rounds: int = ROUNDS) -> Classifier:
    """A classifier for the areas of `subject_areas` (a fixed, small table)."""
    areas = sorted(r.area for r in subject_areas.select("area").where("area is not null").distinct().collect())
    w = weights(first_counts(documents, labels, areas))
    for _ in range(rounds):
        w = weights(refine(documents, w))
    return Classifier(areas, w, *calibrate(documents, labels, areas, w))


def document_areas(documents: DataFrame, labels: DataFrame, subject_areas: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, area, sentences, share, posterior): the areas that each document deals with.

    `sentences` counts the document's sentences of the area, `share` their part of all sentences with an area,
    `posterior` their mean posterior. A null or empty text, and one without a sentence of any area, has no row; a
    repeated document comes out once for each of its rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = "doc_id long, area string, sentences int, share double, posterior double"
    if subject_areas.where("area is not null").limit(1).count() == 0:
        return docs.sparkSession.createDataFrame([], out)
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, subject_areas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Classifier = held.value
        k = len(c.areas)
        names = np.array(c.areas, object)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                chunk = b.slice(at, 4096)
                doc, p = c.sentences(chunk.column(1))
                row, area = np.nonzero(p >= SURE)
                key = doc[row] * k + area
                n = np.bincount(key, minlength=chunk.num_rows * k).reshape(-1, k)
                q = np.bincount(key, p[row, area], chunk.num_rows * k).reshape(-1, k)
                total = np.bincount(doc, (p >= SURE).any(1), chunk.num_rows)[:, None] if len(doc) else np.zeros((chunk.num_rows, 1))
                d, a = np.nonzero((n > 0) & (n * part >= total))
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0).take(pa.array(d)), pa.array(names[a].tolist(), pa.string()), pa.array(n[d, a].astype(np.int32)), pa.array(n[d, a] / total[d, 0]), pa.array(q[d, a] / n[d, a])],
                    ["doc_id", "area", "sentences", "share", "posterior"])

    return docs.mapInArrow(run, out)


def corpus_by_area(documents: DataFrame, labels: DataFrame, subject_areas: DataFrame) -> DataFrame:
    """(area, documents, sentences): the corpus measured by subject; every area has a row."""
    d = document_areas(documents, labels, subject_areas).groupBy("area").agg(F.count(F.lit(1)).alias("documents"), F.sum("sentences").alias("sentences"))
    return subject_areas.select("area").where("area is not null").distinct().join(d, "area", "left").na.fill(0)


def calibration(documents: DataFrame, labels: DataFrame, subject_areas: DataFrame) -> DataFrame:
    """(area, slope, offset, error): the calibration of each area, and the expected calibration error over all of them."""
    spark = documents.sparkSession
    c = train(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, subject_areas)
    return spark.createDataFrame([(a, float(x), float(y), c.error) for a, (x, y) in zip(c.areas, c.curve, strict=True)], "area string, slope double, offset double, error double")
