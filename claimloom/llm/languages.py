"""The language of each text and of each stretch of a text in several languages, with a confidence.

Nearest-centroid classification: a word is a normalised TF-IDF vector of hashed character n-grams, a text the sum of its
words. Each language has several centroids, clustered from a bounded sample of labelled rows; a stretch belongs to the
language of the centroid with the highest cosine and to none where every centroid is too far. The labels are only a
start: the centroids re-label the sample, so that wrong labels lose their say. The n-gram statistics behind the
weights are counted over all rows.

Stretches come from the best path over the words of a text, with a price on each change of language, so that a borrowed
word or a name makes none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookalikes import canonical_array

LANGUAGES = ("en", "hinglish", "hi", "mr", "bn", "ta")
#: Buckets of hashed n-grams; fixes the size of the model at any corpus size.
DIM = 1 << 15
SIZES = (1, 2, 3, 4)
#: Rows of the labelled sample that the centroids are fitted on.
TRAIN_ROWS = 8_000
CENTROIDS = 5
#: Price of a change of language, in cosines of words.
CHANGE = 0.55
#: A stretch belongs to no known language if it is farther from its nearest centroid than nearly all stretches of that length and
#: language in the sample from theirs: its cosine is below ROOM times this quantile of theirs. Lengths in words, each for stretches up to the next.
REJECT, ROOM, LENGTHS = 0.002, 0.85, (1, 3, 5, 8)
#: Words a stretch has at least, in a text of several stretches.
LEAST_WORDS = 3
#: In fitting, a sample row's own label holds unless another language is more than so many times as like.
TRUST = 1.3
MEMO = 300_000

_SKIP = regex.compile(r"[#@][\p{L}\p{M}\p{N}_]+|https?://\S+|www\.\S+")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_PIECE = regex.compile(r"[.।!?|\n]+|\s[-/–—]\s")

# Names of the languages in labels, and words for a label that is not known.
NAMES = {
    "en": ("en", "eng", "english"), "hinglish": ("hinglish",), "hi": ("hi", "hin", "hindi"), "mr": ("mr", "mar", "marathi"),
    "bn": ("bn", "ben", "bengali", "bangla"), "ta": ("ta", "tam", "tamil"),
}
UNKNOWN = ("", "auto", "und", "unknown", "unk", "none", "null", "nan", "na", "n/a", "other", "mul", "mis", "zxx", "xx", "?", "-", "undetermined", "not known")


def label(c: Column) -> Column:
    """A language label in one spelling: a language of LANGUAGES, '' for not known, else its own first part.

    `hi-Latn` and the like are hinglish. Case, blanks and region or script parts make no difference.
    """
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x{A0}]+", " ")))
    first = F.regexp_extract(low, r"^([^-_ ]*)", 1)
    out = F.when(low.isin(*UNKNOWN) | first.isin(*UNKNOWN), "")
    out = out.when(first.isin(*NAMES["hi"]) & low.rlike("latn|latin|roman"), "hinglish")
    for lang, names in NAMES.items():
        out = out.when(first.isin(*names), lang)
    return out.otherwise(first)


def words_of(text: str) -> list[str]:
    """The words of a text, lower case; hash tags, mentions and addresses are no words."""
    if "#" in text or "@" in text or "http" in text or "www." in text:
        text = _SKIP.sub(" ", text)
    return _WORD.findall(text.lower())


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of every word, with the word's ends marked."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    row = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(cp))  # characters up to the end of the word
    rows, buckets = [], []
    h = np.zeros(len(cp), np.uint64)
    for n in range(1, max(SIZES) + 1):
        h = h * np.uint64(0x100000001B3)
        h[:len(cp) - n + 1] += cp[n - 1:]
        if n in SIZES:
            ok = left >= n
            if n == 1:
                ok &= cp > 3
            x = h[ok] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            buckets.append(((x ^ (x >> np.uint64(31))) % np.uint64(DIM)).astype(np.int64))
            rows.append(row[ok])
    return np.concatenate(rows), np.concatenate(buckets)


class Model:
    """Weights by bucket, centroids (DIM x centroids), the language of each centroid, and the least cosine of each language for each of LENGTHS."""

    def __init__(self, weight: np.ndarray, centroids: np.ndarray, owner: np.ndarray, floors: np.ndarray | None = None):
        self.weight, self.centroids, self.owner = weight, centroids, owner
        self.floors = np.full((len(LANGUAGES), len(LENGTHS)), 1e-9) if floors is None else floors

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Cosine of each word with each centroid."""
        row, bucket = _grams(words)
        w = self.weight[bucket]
        norm = np.sqrt(np.bincount(row, w * w, len(words)))
        order = np.argsort(row, kind="stable")
        at = np.searchsorted(row[order], np.arange(len(words)))
        out = np.empty((len(words), self.centroids.shape[1]), np.float32)
        step = 20_000
        ends = np.r_[at, len(row)]
        for k in range(0, len(words), step):
            j = min(len(words), k + step)
            part = order[ends[k]:ends[j]]
            out[k:j] = np.add.reduceat(self.centroids[bucket[part]] * w[part, None], at[k:j] - ends[k], axis=0)
        return out / np.maximum(norm, 1e-9)[:, None]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Over all rows of `texts` (column text): the words that hold an n-gram of each bucket. DIM numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM, np.int64)
        for b in batches:
            seen: Counter[str] = Counter()
            for t in canonical_array(b.column(0)).to_pylist():
                if t:
                    seen.update(words_of(t))
            if seen:
                row, bucket = _grams(list(seen))
                one = np.unique(row * DIM + bucket)
                total += np.bincount(one % DIM, np.fromiter(seen.values(), np.int64)[one // DIM], DIM).astype(np.int64)
        i = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(total[i])], ["b", "n"])

    got = texts.select("text").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIM, np.int64)
    out[got["b"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def fit(sample: list[tuple[str, str]], counts: np.ndarray, centroids: int = CENTROIDS, rounds: int = 6) -> Model:
    """The model from (text, language) rows and the n-gram counts of the corpus; languages without a row get no centroid."""
    total = max(int(counts.max(initial=1)), 2)
    weight = np.log1p(total / np.clip(counts, 1, None)).astype(np.float32)
    number: dict[str, int] = {}
    piece_words, piece_of, given = [], [], []
    for text, lang in sample:
        if lang not in LANGUAGES:
            continue
        for piece in _PIECE.split(text):
            ws = words_of(piece)
            if len(ws) >= 2:
                piece_of += [len(given)] * len(ws)
                piece_words += [number.setdefault(w, len(number)) for w in ws]
                given.append(LANGUAGES.index(lang))
    if not given:
        return Model(weight, np.zeros((DIM, 1), np.float32), np.zeros(1, np.int64))
    pw, po, label_ = np.array(piece_words), np.array(piece_of), np.array(given)
    row, bucket = _grams(list(number))
    w = weight[bucket]
    value = w / np.sqrt(np.bincount(row, w * w, len(number)))[row]
    per_piece = 1.0 / np.bincount(po, minlength=len(label_))

    def centroid(mask: np.ndarray) -> np.ndarray:
        count = np.bincount(pw, per_piece[po] * mask[po], len(number))
        c = np.bincount(bucket, value * count[row], DIM)
        return (c / max(np.linalg.norm(c), 1e-9)).astype(np.float32)

    def scores(cs: np.ndarray) -> np.ndarray:
        words = Model(weight, cs, np.zeros(cs.shape[1])).word_scores(list(number))
        out = np.empty((len(label_), cs.shape[1]))
        for k in range(cs.shape[1]):
            out[:, k] = np.bincount(po, words[pw, k], len(label_)) * per_piece
        return out

    first = label_
    present = [k for k in range(len(LANGUAGES)) if (label_ == k).any()]
    for _ in range(rounds):
        cs = np.stack([centroid((label_ == k).astype(float)) for k in present], 1)
        sure = scores(cs)
        sure[np.array(present)[None] == first[:, None]] *= TRUST
        label_ = np.array(present)[sure.argmax(1)]
        present = [k for k in present if (label_ == k).any()]
    owner, parts = [], []
    for k in present:
        mine = np.nonzero(label_ == k)[0]
        part = np.full(len(label_), -1)
        # the pieces least like their language start a centroid of their own
        order = scores(centroid((label_ == k).astype(float))[:, None])[mine, 0].argsort(kind="stable")
        part[mine[order]] = np.arange(len(mine)) * centroids // len(mine)
        for _ in range(rounds):
            cs = np.stack([centroid((part == j).astype(float)) for j in range(centroids)], 1)
            part[mine] = scores(cs)[mine].argmax(1)
        for j in range(centroids):
            if (part == j).any():
                owner.append(k)
                parts.append(centroid((part == j).astype(float)))
    model = Model(weight, np.stack(parts, 1), np.array(owner))
    scored = model.word_scores(list(number))[pw].astype(np.float64)
    sums = np.concatenate([np.zeros((1, scored.shape[1])), np.cumsum(scored, 0)])
    mine = model.owner[None] == label_[po][:, None]
    for j, n in enumerate(LENGTHS):  # all stretches of n words of a piece that look most like its language, by their nearest centroid
        at = np.nonzero(po[n - 1:] == po[:len(po) - n + 1])[0] if len(po) >= n else np.empty(0, int)
        mean = (sums[at + n] - sums[at]) / n
        near, top = mean.argmax(1) if len(at) else at, mean.max(1, initial=-1.0)
        own = mine[at, near]
        lang, top = model.owner[near[own]], top[own]
        for k in np.unique(lang):
            model.floors[k, j] = max(ROOM * np.quantile(top[lang == k], REJECT), 1e-9)
    return model


class Segmenter:
    """Parts texts into stretches of one language, many texts at a time."""

    def __init__(self, model: Model):
        self.m = model
        self.memo: dict[str, int] = {}
        self.table = np.empty((0, model.centroids.shape[1]), np.float32)
        self.langs = np.unique(model.owner)

    def _numbers(self, lists: list[list[str]]) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo, self.table = {}, self.table[:0]
        memo = self.memo
        fresh = list({w for ws in lists for w in ws if w not in memo})
        if fresh:
            for w in fresh:
                memo[w] = len(memo)
            self.table = np.concatenate([self.table, self.m.word_scores(fresh)])
        return np.array([memo[w] for ws in lists for w in ws], np.int64)

    def run(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, segment number from 1, language number, confidence) of every stretch."""
        lists = [words_of(t) if t else [] for t in texts]
        n = np.array([len(x) for x in lists])
        if not n.sum():
            return np.empty(0, int), np.empty(0, int), np.empty(0, int), np.empty(0)
        s = self.table_of(lists)
        owner, langs = self.m.owner, self.langs
        e = np.stack([s[:, owner == k].max(1) for k in langs], 1)
        path = self._paths(e, n)
        row = np.repeat(np.arange(len(n)), n)
        path = self._absorb(path, row)
        new = np.r_[True, (path[1:] != path[:-1]) | (row[1:] != row[:-1])]
        at = np.nonzero(new)[0]
        size = np.diff(np.r_[at, len(path)])
        mean = np.add.reduceat(s, at, axis=0) / size[:, None]
        by = np.stack([mean[:, owner == k].max(1) for k in langs], 1)
        best = by.argmax(1)
        seg_row, top = row[at], by.max(1)
        floor = self.m.floors[langs[best], np.searchsorted(LENGTHS, size, side="right") - 1]
        share = np.clip(by, 0, None) ** 2
        conf = share.max(1) / np.maximum(share.sum(1), 1e-9)
        ok = top >= floor
        seg_row, best, conf = seg_row[ok], best[ok], conf[ok]
        if not len(seg_row):
            return seg_row, seg_row, seg_row, conf
        same = np.r_[False, (best[1:] == best[:-1]) & (seg_row[1:] == seg_row[:-1])]
        group = np.cumsum(~same) - 1
        first = np.nonzero(~same)[0]
        conf = np.bincount(group, conf) / np.bincount(group)
        seg_row, best = seg_row[first], best[first]
        start = np.r_[True, seg_row[1:] != seg_row[:-1]]
        order = np.arange(len(seg_row)) - np.maximum.accumulate(np.where(start, np.arange(len(seg_row)), 0)) + 1
        return seg_row, order, langs[best], conf

    def table_of(self, lists: list[list[str]]) -> np.ndarray:
        i = self._numbers(lists)
        return self.table[i]

    def _paths(self, e: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The best language of every word, all texts side by side, one word position at a time."""
        at = np.r_[0, np.cumsum(n)]
        order = np.argsort(-n, kind="stable")
        longest = int(n.max())
        best = np.zeros((len(n), e.shape[1]))
        back = np.zeros((len(e), e.shape[1]), np.int8)
        live = np.searchsorted(-n[order], -np.arange(longest), side="left")  # texts with more than k words
        for k in range(longest):
            r = order[:live[k]]
            i = at[r] + k
            if k:
                b = best[r]
                top = b.argmax(1)
                jump = b[np.arange(len(r)), top] - CHANGE
                stay = b >= jump[:, None]
                back[i] = np.where(stay, np.arange(e.shape[1])[None], top[:, None])
                best[r] = np.where(stay, b, jump[:, None]) + e[i]
            else:
                best[r] = e[i]
        path = np.zeros(len(e), np.int64)
        now = best.argmax(1)
        for k in range(longest - 1, -1, -1):
            r = order[:live[k]]
            i = at[r] + k
            path[i] = now[r]
            now[r] = back[i, now[r]]
        return path

    @staticmethod
    def _absorb(path: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Stretches of fewer than LEAST_WORDS words join the one before, else the one after."""
        path = path.copy()
        new = np.r_[True, (path[1:] != path[:-1]) | (row[1:] != row[:-1])]
        at = np.nonzero(new)[0]
        end = np.r_[at[1:], len(path)]
        for j in np.nonzero(end - at < LEAST_WORDS)[0]:
            a, b = at[j], end[j]
            if a > 0 and row[a - 1] == row[a]:
                path[a:b] = path[a - 1]
            elif b < len(path) and row[b] == row[a]:
                path[a:b] = path[b]
        return path


def model_of(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from rows (tbl, id, text, label): counts over all of them, centroids from about `train_rows` labelled ones."""
    counts = bucket_counts(rows)
    known = rows.where(F.col("label").isin(*LANGUAGES) & F.col("text").isNotNull())
    known = known.where((F.col("label") != "hi") | F.col("text").rlike(r"\p{IsDevanagari}"))  # else the label may stand for Latin letters
    n = known.count()
    if n > train_rows:  # a share of about `train_rows` rows, by hash
        known = known.where(F.pmod(F.xxhash64("id", "tbl"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))
    got = known.select("text", "label").collect()
    texts = canonical_array(pa.array([r.text for r in got], pa.string())).to_pylist()
    return fit(list(zip(texts, [r.label for r in got], strict=True)), counts)


def stretches(rows: DataFrame, model: Model) -> DataFrame:
    """(tbl, id, label, text_langs, seg_no, language, confidence): every stretch of every row's text.

    `rows` has (tbl, id, text, label). A text without words, an empty and a null text have no stretch.
    """

    held = rows.sparkSession.sparkContext.broadcast(Segmenter(model))  # of fixed size; a worker keeps it with the words it has seen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg: Segmenter = held.value
        names = np.array(LANGUAGES, object)
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                row, no, lang, conf = seg.run(canonical_array(part.column(2)).to_pylist())
                take = pa.array(row, pa.int64())
                many = np.bincount(row, minlength=part.num_rows)[row] if len(row) else row
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), part.column(3).take(take), pa.array(many, pa.int32()), pa.array(no, pa.int32()), pa.array(names[lang].tolist(), pa.string()), pa.array(np.round(conf, 6), pa.float64())],
                    ["tbl", "id", "label", "stretches", "seg_no", "language", "confidence"])

    return rows.select("tbl", "id", "text", "label").mapInArrow(run, "tbl string, id long, label string, stretches int, seg_no int, language string, confidence double")


def claim_rows(canonical_claims: DataFrame, multilingual_claims: DataFrame) -> DataFrame:
    """The texts of both tables with their labels in one spelling."""
    a = canonical_claims.select(F.lit("canonical_claims").alias("tbl"), F.col("claim_ref").cast("long").alias("id"), F.col("original_text").alias("text"), label(F.col("language")).alias("label"))
    b = multilingual_claims.select(F.lit("multilingual_claims").alias("tbl"), F.col("claim_key").cast("long").alias("id"), F.col("original_text").alias("text"), label(F.col("source_language")).alias("label"))
    return a.unionByName(b)


def claim_languages(canonical_claims: DataFrame, multilingual_claims: DataFrame) -> DataFrame:
    """Every stretch of every row of both tables, with its language and confidence."""
    rows = claim_rows(canonical_claims, multilingual_claims)
    return stretches(rows, model_of(rows))


def wrong_labels(canonical_claims: DataFrame, multilingual_claims: DataFrame) -> DataFrame:
    """(tbl, rec_id, seg_no, language): rows with a missing or wrong label, and all rows of several languages.

    In multilingual_claims the label of Hindi also stands for Hindi in Latin letters.
    """
    s = claim_languages(canonical_claims, multilingual_claims)
    right = (F.col("label") == F.col("language")) | (F.col("tbl") == "multilingual_claims") & (F.col("label") == "hi") & (F.col("language") == "hinglish")
    return s.where((F.col("stretches") > 1) | ~right).select("tbl", F.col("id").alias("rec_id"), "seg_no", "language")
