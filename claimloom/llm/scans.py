"""Text of scanned pages repaired into continuous paragraphs.

Lines that only the page added are found by where they recur: a header or footer stands at the same edge on further
pages of its file, or has the wording of lines that the corpus has at page edges and hardly elsewhere; a line of any length
or form among the outer ones counts if it recurs on several pages of its file. Words broken at
a line's end are joined. Misread words are corrected by a noisy channel: a candidate's probability is that of its
character confusions, estimated from the corpus, times its likelihood after the word before it under the corpus's
word pairs, or, for words that no list has, that of its letters; the best sequence of each line is decoded by Viterbi over
the candidates of its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# What scanners take for what, as (true, read).
CONFUSIONS = (
    ("e", "c"), ("a", "@"), ("t", "+"), ("i", "1"), ("l", "1"), ("o", "0"), ("s", "5"), ("g", "9"), ("b", "6"), ("l", "i"), ("i", "l"), ("h", "b"),
    ("f", "ſ"), ("s", "ſ"), ("u", "ii"), ("n", "ri"), ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("w", "vv"), ("c", "e"), ("b", "h"), ("i", "!"), ("l", "|"), ("i", "|"),
    ("s", "$"), ("c", "("), ("g", "q"), ("q", "g"), ("u", "v"), ("v", "u"), ("f", "t"), ("t", "f"), ("b", "8"), ("z", "2"), ("n", "u"), ("u", "n"),
)
# One form for characters that are taken for each other, so chosen that both sides of every confusion have the same.
COARSE = {
    "i": "i", "l": "i", "1": "i", "|": "i", "!": "i", "r": "i", "u": "ii", "v": "ii", "n": "ii", "m": "iii", "w": "iiii", "e": "c", "c": "c", "(": "c", "d": "ci", "a": "a", "@": "a",
    "t": "f", "f": "f", "+": "f", "ſ": "f", "s": "f", "5": "f", "$": "f", "o": "o", "0": "o", "g": "g", "9": "g", "q": "g", "b": "b", "h": "b", "6": "b", "8": "b", "z": "z", "2": "z",
}
DIGITS = {"l": "1", "i": "1", "|": "1", "!": "1", "o": "0", "z": "2", "s": "5", "b": "6", "g": "9", "q": "9", "B": "8", "S": "5", "O": "0", "I": "1", "Z": "2", "$": "5", "G": "6", "A": "4", "T": "7"}
_HYPHENS = "-¬‐‑­"
_NUM, _DIGIT = "<num>", "\x01"
#: A word or pair of words is in the list of every task from this share of the corpus on (and from LEAST occurrences), so
#: that the model has at most 1 / SHARE words and as many pairs, whatever the corpus.
SHARE = 2e-6
LEAST = 4
#: Probability of a confusion before any is counted.
PRIOR = 2e-3
#: Weight of word pairs against single words.
PAIRS = 0.7
_UNKNOWN, _NAME = 1e-9, 1e-6
#: Log odds that a name is spelt as it is read; letters are judged from so many on.
NAME_GAIN, LEAST_LETTERS = 1.0, 2000
#: Spellings kept while a word is spelt letter by letter.
BEAM = 16
_FLUSH = 400_000
#: A recurring line is of the page if at least this part of its wording's occurrences stand at page edges.
EDGE = 0.8
#: Words of a line that its wording alone may make a header or footer. Longer ones, lines that end like a sentence and lines
#: further in, up to LINES from each edge, must recur on RECUR pages of their file.
EDGE_WORDS, LINES, RECUR = 11, 3, 3
#: Words that such a line has at least: the last word or two of a paragraph recur by chance.
LOOSE_WORDS = 3

_ROMAN = r"(?:x{0,3}|xl|l|lx{1,3}|xc)(?:i{1,3}|iv|v|vi{1,3}|ix)|x{1,3}|xl|l|lx{1,3}|xc"
_NUMBER_LINE = re.compile(rf"\W*(?:(?:page|p|pg|no)\b\W*)?(?:[0-9][0-9lIoOSsBbz|]*|[lIoOzSsb|][0-9][0-9lIoOSsBbz|]*|{_ROMAN})(?:\s*(?:of|/)\s*[0-9lIoOSsBbz|]+)?\W*", re.I)
_PAGE_WORD = re.compile(r"\W*p[@ae]9?g?[ec]?\b|\W*p\.", re.I)
_STRIP = ".,;:\"'()[]{}!?%“”‘’«»*…|"
_DIGITISH = re.compile(r"[0-9lIoOzZsSbBgqi|!$]+")


def is_number_line(line: str) -> bool:
    """A line of only a page number, bare, framed, roman, or after `Page`."""
    s = line.strip()
    if not s:
        return False
    return bool(_NUMBER_LINE.fullmatch(s)) or bool(_PAGE_WORD.match(s) and re.fullmatch(r"\W*[Pp]\S{0,3}\W*\s*[0-9lIoOSsBbz|]{1,4}(?:\s*[o0]f\s*[0-9lIoOSsBbz|]{1,4})?\W*", s))


_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "5": "s", "9": "g", "6": "b", "h": "b", "@": "a", "+": "t", "ſ": "f", "c": "e", "|": "l", "!": "l"})


@lru_cache(1 << 16)
def skeleton(word: str) -> str:
    """One form for all readings of a word."""
    w = word.lower()
    for a, b in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ri", "n")):
        w = w.replace(a, b)
    return re.sub(r"[^a-z]", "", w.translate(_FOLD))


def _is_number(token: str) -> bool:
    return bool(_DIGITISH.fullmatch(token)) and any(c.isdigit() for c in token)


@lru_cache(1 << 18)
def _bare(word: str) -> str | None:
    """The one form of a word of a line; None for numbers and marks."""
    t = word.strip(_STRIP)
    return None if not t or _is_number(t) or re.fullmatch(_ROMAN, t) else skeleton(t)


def line_key(line: str) -> str:
    """A line without its numbers, in one form for all readings."""
    return " ".join(filter(None, map(_bare, line.split())))


def line_wording(line: str, known: set[str]) -> str:
    """`line_key` with its names as N; `known` has the forms of the usual words."""
    return " ".join([k if k in known else "N" for k in map(_bare, line.split()) if k is not None])


def tokens(line: str) -> list[str]:
    """The words of a line without the punctuation around them; a hyphen at the line's end stays."""
    return [t for t in (w.strip(_STRIP) for w in line.split()) if t]


@lru_cache(1 << 16)
def shape(token: str) -> str:
    """A token as the language model has it: lower case, numbers as one."""
    t = token.lower()
    return _NUM if t.replace(".", "").replace(",", "").isdigit() else t


def edge_lines(lines: list[str]) -> list[tuple[int, str, bool]]:
    """(line number from 1, 'T' or 'B', strict) of the lines that may be a header or footer: LINES at each edge, numbers left out.

    Strict are outermost lines in the form of a header; their wording may tell. A line is listed once for each edge.
    """
    full = [k for k, x in enumerate(lines) if x.strip()]
    out = []
    for zone, order in (("T", full), ("B", full[::-1])):
        rank = 0
        for n, k in enumerate(order[:LINES + 1]):
            if is_number_line(lines[k]):
                continue
            s = lines[k].strip()
            strict = not rank and n < 2 and len(s.split()) <= EDGE_WORDS and s[-1] not in ".,;\"?!" and (s[0].isupper() or s[0].isdigit() or n == 0 and zone == "T") and not (zone == "B" and len(full) > 2 and s[0].islower())
            out.append((k + 1, zone, strict))
            rank += 1
            if rank == LINES:
                break
    return out


def _counted(total: Counter, names: list[str]) -> Iterator[pa.RecordBatch]:
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names)
        total.clear()


def word_counts(pages: DataFrame) -> tuple[dict[str, int], dict[str, int], DataFrame | None]:
    """The usual words of the corpus with their counts, at most 1 / SHARE; counted over all pages.

    Then how many digits numbers have, and how often which other character stands among them.

    And the table (w, n) of all words from LEAST occurrences on, where the share leaves some of them out of the list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter[str] = Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            total: Counter[str] = Counter()
            for w, n in raw.items():
                t = w.strip(_STRIP)
                if t and t[-1] not in _HYPHENS:
                    x = shape(t)
                    total[x] += n
                    if x == _NUM:
                        total[_DIGIT] += n * sum(c.isdigit() for c in t)
                    elif _is_number(t):
                        for c in t:
                            total[_DIGIT + c if not c.isdigit() else _DIGIT] += n
            raw.clear()
            yield from _counted(total, ["w", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    raw.update(text.split())
            if len(raw) > _FLUSH:
                yield from counted()
        yield from counted()

    got = cut(pages.select("extracted_text").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))
    digit = F.col("w").startswith(_DIGIT)  # digits, and characters that stand among them: a handful
    digits = {r.w: r.n for r in got.where(digit).collect()}
    got = got.where(~digit)
    all_ = got.agg(F.sum("n")).first()[0] or 0
    words = {r.w: r.n for r in got.where(F.col("n") >= max(LEAST, all_ * SHARE)).collect()}
    return words, digits, got.where(F.col("n") >= LEAST) if all_ * SHARE > LEAST else None


def is_name(token: str) -> bool:
    return len(token) > 3 and token[0].isupper() and token[1:].islower() and token.isalpha()


def trigrams(word: str) -> list[str]:
    w = f"^{word.lower()}$"
    return [w[k:k + 3] for k in range(len(w) - 2)]


def pair_counts(pages: DataFrame, words: dict[str, int]) -> tuple[dict[tuple[str, str], int], dict[str, int]]:
    """The usual pairs of usual words, and the letter triples of names (capitalised words that are not usual).

    Both are counted over all pages; there are at most as many triples as the letters allow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        names: Counter[str] = Counter()
        usual: dict[str, str | None] = {}  # a token's shape; None for marks and for words out of the list

        def look(w: str) -> str | None:
            t = w.strip(_STRIP)
            x = shape(t) if t else ""
            if x in words:
                return x
            return "" if not t else None

        def spelt() -> Iterator[pa.RecordBatch]:
            for w, n in names.items():
                t = w.strip(_STRIP)
                if is_name(t) and t.isascii():
                    for g in trigrams(t):
                        total[g] += n
            names.clear()
            yield from _counted(total, ["w", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    last = None
                    for w in line.split():
                        if w in usual:
                            x = usual[w]
                        else:
                            if len(usual) > _FLUSH:
                                usual.clear()
                            x = usual[w] = look(w)
                        if x is None:
                            names[w] += 1
                        elif x and last:
                            total[f"{last} {x}"] += 1
                        if x != "":
                            last = x
            if len(total) + len(names) > _FLUSH:
                yield from spelt()
        yield from spelt()

    least = max(2, sum(words.values()) * SHARE)
    got = pages.select("extracted_text").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | ~F.contains("w", F.lit(" ")))
    rows = got.collect()
    return {tuple(r.w.split(" ", 1)): r.n for r in rows if " " in r.w}, {r.w: r.n for r in rows if " " not in r.w}


_FIRST = {c: [x for x in CONFUSIONS if x[0][0] == c] for c in {a[0] for a, _ in CONFUSIONS}}
_COARSE = str.maketrans(COARSE)


def coarse(word: str) -> str:
    """One form for a word and everything that confusions make of it, however many there are."""
    return word.translate(_COARSE)


def explained(true: str, read: str, cost: dict[tuple[str, str], float] | None = None) -> tuple[float, tuple[tuple[str, str], ...]] | None:
    """(log probability, confusions) of the likeliest way in which `true` is read as `read`, None if there is none; without costs the fewest."""
    at: list[dict[int, tuple[float, tuple]]] = [{} for _ in range(len(true) + 1)]
    at[0][0] = 0.0, ()
    for i, c in enumerate(true):
        for j, (p, how) in at[i].items():
            if read.startswith(c, j):
                old = at[i + 1].get(j + 1)
                if old is None or p > old[0]:
                    at[i + 1][j + 1] = p, how
            for a, b in _FIRST.get(c, ()):
                if read.startswith(b, j) and true.startswith(a, i):
                    q, old = p + (cost[a, b] if cost else -1.0), at[i + len(a)].get(j + len(b))
                    if old is None or q > old[0]:
                        at[i + len(a)][j + len(b)] = q, (*how, (a, b))
    return at[-1].get(len(read))


def inverse(token: str) -> dict[str, tuple[str, str]]:
    """What a token may have been, with the one confusion that made it."""
    found: dict[str, tuple[str, str]] = {}
    for true, read in CONFUSIONS:
        at = token.find(read)
        while at >= 0:
            found.setdefault(token[:at] + true + token[at + len(read):], (true, read))
            at = token.find(read, at + 1)
    found.pop(token, None)
    return found


def _outweighs(w: str) -> int:
    """By what factor a word must be more usual than `w` to explain it as a misreading."""
    return 3 if _ODD.search(w) else 8 if len(w) >= 6 else 25


def _spread_words(schema: str, make) -> object:
    """For mapInArrow: the rows that `make` has for each row, as columns of `schema`."""
    kinds = [(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.string()) for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                rows = [x for r in zip(*[c.to_pylist() for c in b.slice(at, 512).columns], strict=True) for x in make(*r)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return run


def page_words(text: str | None) -> set[str]:
    """What the decoder may look up for a page: its words, words joined over a line's end, and parts at hyphens."""
    found, last = set(), None
    for line in (text or "").split("\n"):
        ts = tokens(line)
        if not ts:
            continue
        if last:
            found |= {(last + ts[0]).lower(), f"{last}-{ts[0]}".lower()}
        found.update(t.lower() for t in ts)
        end = line.split()[-1].lstrip(_STRIP)
        last = end.rstrip(_HYPHENS) if end and end[-1] in _HYPHENS else None
    return found | {p for t in found if "-" in t for p in t.split("-") if p}


def rare_words(pages: DataFrame, words: dict[str, int], counted: DataFrame) -> DataFrame:
    """(id, rare): for each page the words outside the list, with counts, that its words are or may be misreadings of.

    A word that a far more usual one explains is none. All by joins with the complete counted table on the coarse form.
    Words of the list need no rarer candidate: read as they stand they are likelier at any place.
    """
    form = "w string, n long, c string"
    every = cut(counted.where(~F.col("w").eqNullSafe(_NUM)).mapInArrow(_spread_words(form, lambda w, n: [(w, n, coarse(w))]), form))
    rare = every.join(F.broadcast(every.sparkSession.createDataFrame([(w,) for w in words], "w string")), "w", "left_anti")  # at most 1 / SHARE words
    met = rare.join(every.select("c", F.col("w").alias("v"), F.col("n").alias("m")), "c").where("w <> v and m >= 3 * n").select("w", "n", "v", "m")
    wrong = met.mapInArrow(_spread_words("w string", lambda w, n, v, m: [(w,)] if m >= _outweighs(w) * n and len((explained(v, w) or (0, ()))[1]) == 1 else []), "w string").distinct()
    rare = cut(rare.join(wrong, "w", "left_anti"))
    has = cut(pages.select("raw_input_id", "extracted_text").mapInArrow(_spread_words("id string, t string", lambda i, text: [(i, t) for t in page_words(text) if t not in words]), "id string, t string"))
    tokens_ = has.select("t").distinct().mapInArrow(_spread_words("t string, c string", lambda t: [(t, coarse(t))]), "t string, c string")
    may = tokens_.join(rare, "c").select("t", "w", "n").mapInArrow(_spread_words("t string, w string, n long", lambda t, w, n: [(t, w, n)] if explained(w, t) else []), "t string, w string, n long")
    return has.join(may, "t").groupBy("id").agg(F.collect_set(F.struct("w", "n")).alias("rare"))  # the words of one page


_ODD = re.compile(r"[0-9@+ſ|!$(]")


class Spelling:
    """Likelihood of letters, each after the two before it; unseen ones weigh little."""

    def __init__(self, triples: Counter[str]):
        self.triples, self.before = triples, Counter()
        for t, n in triples.items():
            self.before[t[:2]] += n
        self.size = self.before.total()
        self.known: dict[str, float] = {}

    def of(self, word: str) -> float:
        total, known = 0.0, self.known
        for k in range(len(word) - 2):
            g = word[k:k + 3]
            p = known.get(g)
            if p is None:
                p = known[g] = math.log((self.triples.get(g, 0) + 0.05) / (self.before.get(g[:2], 0) + 2.0))
            total += p
        return total


class Channel:
    """Words, pairs of words and confusion probabilities of a corpus."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], letters: dict[str, int] | None = None, digits: dict[str, int] | None = None):
        self.total = max(sum(words.values()), 1)
        digits = digits or {}
        each = digits.get(_DIGIT, 0) / 10  # occurrences of one digit
        #: Probability that a digit is read as a character.
        self.digits = {c: min(max((digits.get(_DIGIT + c, 0) + PRIOR * 50) / (each + 50), 1e-5), 0.05) for c in DIGITS}
        self.names = Spelling(Counter(letters or {}))
        self.words, self.pairs = dict(words), pairs
        self._purify()
        self.alphabet = Spelling(Counter(g for w in self.words if w.isalpha() and w.isascii() for g in trigrams(w)))
        self.memo: dict[str, list[tuple[str, float]]] = {}
        self.named: set[str] = set()
        self.settled: dict[str, bool] = {}
        self.rare: list[str] = []

    def turn(self, rare: list[dict] | None) -> None:
        """Takes the rarer words of the next page in place of those of the last one."""
        for w in self.rare:
            del self.words[w]
            self.forms[coarse(w)].remove(w)
        new = {r["w"]: r["n"] for r in rare or () if r["w"] not in self.words}
        self.rare = list(new)
        self.words |= new
        for w in new:
            self.forms.setdefault(coarse(w), []).append(w)

    def _purify(self) -> None:
        """Confusion probabilities from words that a far more usual word explains; those words leave the model.

        Of short words a pair alike by chance is likelier, so the usual one must be more so.
        """
        seen, might = Counter(), Counter()
        forms: dict[str, list[str]] = {}
        trues = {a for a, _ in CONFUSIONS}
        for w, n in self.words.items():
            if w != _NUM:
                forms.setdefault(coarse(w), []).append(w)
                for true in trues:
                    if true in w:
                        might[true] += n * w.count(true)
        wrong = set()
        for group in forms.values():
            group.sort(key=lambda w: -self.words[w])
            for k, w in enumerate(group):
                least = _outweighs(w) * self.words[w]
                for v in group[:k]:  # the more usual ones, the most usual first
                    if self.words[v] < least:
                        break
                    way = explained(v, w)
                    if way and len(way[1]) == 1:
                        wrong.add(w)
                        seen[way[1][0]] += self.words[w]
                        break
        self.chance = {c: min(max((seen[c] + PRIOR * 50) / (might[c[0]] + 50), 1e-5), 0.05) for c in CONFUSIONS}
        self.cost = {c: math.log(p) for c, p in self.chance.items()}
        for w in wrong:
            del self.words[w]
        #: Words by their coarse form.
        self.forms = {f: [w for w in group if w not in wrong] for f, group in forms.items()}

    def candidates(self, token: str) -> list[tuple[str, float]]:
        """(word, log probability of being read as `token`); the token itself comes first."""
        got = self.memo.get(token)
        if got is not None:
            return got
        t = token.lower()
        out = [(t, 0.0)]
        if not t.replace(".", "").replace(",", "").isdigit():
            if t not in self.words or len(t) <= 2:
                digits = "".join(DIGITS.get(c, DIGITS.get(c.lower(), c)) for c in token)
                if digits.isdigit() and (any(c.isdigit() for c in t) or t not in self.words):
                    out.append((digits, sum(math.log(self.digits.get(c, self.digits.get(c.lower(), PRIOR))) for c in token if not c.isdigit())))
            most = 1 if t in self.words or is_name(token) else len(t)  # confusions
            for v in self.forms.get(coarse(t), ()):
                way = explained(v, t, self.cost) if v != t else None
                if way and len(way[1]) <= most:
                    out.append((v, way[0]))
            if len(out) == 1 and t not in self.words:
                if _ODD.search(t):
                    out += self._spelled(t)
                elif is_name(token):
                    out += self._named(t)
                    self.named.add(token)
        if len(self.memo) > _FLUSH:
            self.memo.clear()
        self.memo[token] = out
        return out

    def is_settled(self, word: str) -> bool:
        """Whether a word of a line, punctuation around it included, has no reading but its own."""
        got = self.settled.get(word)
        if got is None:
            t = word.strip(_STRIP)
            if len(self.settled) > _FLUSH:
                self.settled.clear()
            got = self.settled[word] = not t or word[-1] not in _HYPHENS and len(self.candidates(t)) == 1
        return got

    def _spelled(self, t: str) -> list[tuple[str, float]]:
        """For an unknown word with characters that no word has: its likeliest spellings by letters, parts at a hyphen each by itself."""
        parts = t.split("-")
        if len(parts) > 1:
            v, cost = [], 0.0
            for p in parts:
                rest = [(x, c) for x, c in self.candidates(p) if not _ODD.search(x)] or [(p, 0.0)]
                x, c = max(rest, key=lambda o: o[1] + self.single(o[0]))
                v.append(x)
                cost += c
            v = "-".join(v)
            return [(v, cost)] if v != t and not _ODD.search(v) else []
        if sum(c.isdigit() for c in t) * 2 > len(t) or not any(c.isalpha() for c in t):
            return []
        beam = [("", 0.0)]
        for c in t:
            ways = [(true, self.cost[true, read]) for true, read in CONFUSIONS if read == c] if _ODD.search(c) else [(c, 0.0)]
            beam = [(v + x, cost + y) for v, cost in beam for x, y in ways]
            beam = sorted(beam, key=lambda o: -o[1] - self.alphabet.of("^" + o[0]))[:BEAM]
        good = [(v, cost + self.alphabet.of(f"^{v}$")) for v, cost in beam if v.replace("'", "").isalpha()]
        best = max((c for _, c in good), default=0.0)
        return [(v, c - best + math.log(PRIOR)) for v, c in good]

    def _named(self, t: str) -> list[tuple[str, float]]:
        """The names of a single confusion whose letters follow each other more usually; the odds are against a change."""
        if self.names.size < LEAST_LETTERS:
            return []
        here = self.names.of(f"^{t}$") + NAME_GAIN
        found = [(v, self.names.of(f"^{v}$") - here + self.cost[how]) for v, how in inverse(t).items() if v.isalpha()]
        return [x for x in found if x[1] > -3.0]  # beyond what any confidence of the page makes up for

    def single(self, v: str) -> float:
        n = self.words.get(shape(v), 0)
        return math.log(n / self.total) if n else math.log(_UNKNOWN)

    def after(self, u: str | None, v: str, name: bool) -> float:
        """Log likelihood of `v` after `u`."""
        s = shape(v)
        n = self.words.get(s, 0)
        p = n / self.total if n else (_NAME if name else _UNKNOWN)
        if u is not None and n:
            m = self.words.get(u, 0)
            if m:
                p = (1 - PAIRS) * p + PAIRS * self.pairs.get((u, s), 0) / m
        return math.log(p)

    def decode(self, line: list[tuple[str, list[str]]], doubt: float) -> list[str]:
        """The best words of a line; an entry is (token as read, its spellings: several for a joined word)."""
        if all(len(sp) == 1 and len(self.candidates(sp[0])) == 1 for _, sp in line):
            return [sp[0].lower() for _, sp in line]  # nothing to choose
        states: dict[str | None, tuple[float, tuple]] = {None: (0.0, ())}
        for place, (token, spellings) in enumerate(line):
            name = token[:1].isupper() and token[1:].islower() and place > 0
            if len(states) == 1 and len(spellings) == 1 and len(self.candidates(spellings[0])) == 1:
                v, x = spellings[0].lower(), shape(spellings[0])  # one way to here and one on: nothing to weigh
                (_, path), = states.values()
                states = {x if x in self.words or x == _NUM else None: (0.0, (path, v))}
                continue
            options: dict[str, float] = {}
            for sp in spellings:
                for v, cost in self.candidates(sp):
                    same = v == sp.lower()
                    if same and _ODD.search(v) and any(c.isalpha() for c in v):
                        cost = math.log(1e-6)
                    elif not same:
                        cost += doubt
                    if cost > options.get(v, -1e9):
                        options[v] = cost
            new: dict[str | None, tuple[float, tuple]] = {}
            for v, cost in options.items():
                known = v in self.words
                s = shape(v) if known or shape(v) == _NUM else None
                for u, (score, path) in states.items():
                    x = score + cost + self.after(u, v, name and (v == token.lower() or token in self.named))
                    if s not in new or x > new[s][0]:
                        new[s] = (x, (path, v))
            states = new
        path = max(states.values(), key=lambda x: x[0])[1]
        out: list[str] = []
        while path:
            path, v = path
            out.append(v)
        return out[::-1]


def _edges(pages: DataFrame, known: set[str]) -> DataFrame:
    """Lines that may be a header or footer, and lines of the same kind from the middle of pages (line_no 0).

    A line that only its recurrence in the file can tell has no wording.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, file, page, text in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                lines = (text or "").split("\n")
                edges = edge_lines(lines)
                at = {k: zone for k, zone, strict in edges if strict}
                for k, zone, strict in edges:
                    if not strict and (key := line_key(lines[k - 1])).count(" ") + 1 >= LOOSE_WORDS:
                        rows.append((i, file, page, k, zone, key, None))
                for k, x in enumerate(lines, 1):
                    n = len(x.split())
                    if not n or n > EDGE_WORDS or k not in at and (x.rstrip()[-1] in ".,;\"?!" or is_number_line(x)):
                        continue
                    key = line_key(x)
                    if key:
                        rows.append((i, file, page, k if k in at else 0, at.get(k, "M"), key, line_wording(x, known)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string()] * 3 + [pa.int32()] + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "file", "page", "line_no", "zone", "key", "wording"])

    return pages.select("raw_input_id", "file", "page", "extracted_text").mapInArrow(run, "id string, file string, page string, line_no int, zone string, key string, wording string")


def running_lines(pages: DataFrame, words: dict[str, int]) -> DataFrame:
    """(id, line_no): the headers and footers.

    A line in the form of a header counts if it stands at that edge on two pages of its file, or its wording does in five
    files of the corpus, and its wording rarely stands elsewhere; any other line near an edge, of LOOSE_WORDS words or more, if it
    stands there on RECUR pages of its file. Counts are combined before each shuffle.
    """
    least = max(30, sum(words.values()) * 1e-5)
    known = {skeleton(w) for w, n in words.items() if n >= least and w != _NUM}
    e = _edges(pages, known)
    # lines and files by 64-bit hashes: their texts need not travel
    e = cut(e.select("id", "line_no", "zone", F.xxhash64("file").alias("file"), F.xxhash64("page").alias("page"), F.xxhash64("key").alias("key"), F.when(F.col("wording").isNotNull(), F.xxhash64("wording")).alias("wording")))
    per_file = e.where("wording is not null").groupBy("wording", "file").agg(F.sum((F.col("line_no") > 0).cast("long")).alias("edge"), F.count(F.lit(1)).alias("all"))
    told = per_file.groupBy("wording").agg(F.sum("edge").alias("edge"), F.sum("all").alias("all"), F.count(F.lit(1)).alias("files")).where(F.col("edge") >= EDGE * F.col("all"))
    # many lines may share a wording: the wordings meet distinct pairs of wording and file, the lines meet those pairs
    pair = per_file.where("edge > 0").select("wording", "file").join(told.select("wording", "files"), "wording")
    at = e.where("line_no > 0").select("id", "line_no", "zone", "file", "page", "key", "wording")
    by_file = at.groupBy("file", "zone", "key", "page").agg(F.max(F.col("wording").isNotNull()).alias("s")).groupBy("file", "zone", "key").agg(F.count(F.lit(1)).alias("all_pages"), F.count_if("s").alias("pages"))
    recurs = at.drop("page").join(by_file.where(f"pages >= 2 or all_pages >= {RECUR}"), ["file", "zone", "key"])
    usual = at.where("wording is not null").select("id", "line_no", "file", "wording").join(pair.where("files >= 5"), ["file", "wording"])
    strict = recurs.where("pages >= 2").join(pair, ["file", "wording"], "left_semi")
    got = usual.select("id", "line_no").unionByName(strict.select("id", "line_no")).unionByName(recurs.where(f"all_pages >= {RECUR}").select("id", "line_no"))
    return got.distinct()


def scaled(confidence: float | None) -> float | None:
    """A confidence between 0 and 1, also where it was given in percent."""
    if confidence is None or confidence != confidence or confidence < 0:
        return None
    return min(confidence / 100 if confidence > 1 else confidence, 1.0)


class Page:
    """One page taken apart: its page lines, its broken words, its words as they should read."""

    def __init__(self, text: str | None, running: set[int], number: int | None, confidence: float | None, channel: Channel):
        self.lines = (text or "").split("\n")
        self.running, self.numbers = running, set()
        self.found: list[tuple[int, str, str]] = []
        self._page_numbers(number)
        c = scaled(confidence)
        doubt = 0.0 if c is None else math.log(min(max((1.05 - c) * 4, 0.25), 2.0))
        self.read: dict[int, list[tuple[str, str]]] = {}
        self._words(channel, doubt)
        self.found += [(k, "running_line", "") for k in running] + [(k, "page_number", "") for k in self.numbers]
        self.found = sorted(set(self.found))

    def _page_numbers(self, number: int | None) -> None:
        full = [k for k, x in enumerate(self.lines, 1) if x.strip()]
        for order in (full, full[::-1]):
            for n, k in enumerate(order[:2]):
                line = self.lines[k - 1]
                if k in self.running:
                    continue
                if not is_number_line(line):
                    break
                bare = re.fullmatch(r"[0-9]+", line.strip())
                if bare and n + 1 < len(order):  # a column of numbers in a table is no page number
                    beside = self.lines[order[n + 1] - 1].strip()
                    if re.fullmatch(r"[0-9]+", beside) and int(line) != number:
                        break
                self.numbers.add(k)
                break

    def _words(self, channel: Channel, doubt: float) -> None:
        body = [k for k, x in enumerate(self.lines, 1) if x.strip() and k not in self.running and k not in self.numbers]
        settled, raw = channel.is_settled, {k: self.lines[k - 1].rstrip() for k in body}
        toks: dict[int, list[str]] = {}

        def tokens_of(k: int) -> list[str]:
            if k not in toks:
                toks[k] = tokens(raw[k])
            return toks[k]

        for place, k in enumerate(body):
            if k not in toks and all(map(settled, raw[k].split())):
                continue  # nothing to choose and nothing broken: the line reads as it stands
            ts, entries = tokens_of(k), []
            half = None
            if ts and place + 1 < len(body) and raw[k][-1] in _HYPHENS and len(raw[k]) > 1 and (raw[k][-2].isalnum() or raw[k][-2] in "@+ſ'"):
                after = tokens_of(body[place + 1])
                if after and (after[0][0].isalnum() or after[0][0] in "@+ſ"):
                    first = raw[k].split()[-1].lstrip(_STRIP).rstrip(_HYPHENS)
                    if first and any(c.isalpha() for c in first):
                        half = (first, after[0])
                        ts = ts[:-1]
                        toks[body[place + 1]] = after[1:]
            entries = [(t, [t]) for t in ts]
            if half:
                a, b = half
                forms = [a + b] if raw[k][-1] != "-" and raw[k][-1] not in "‐‑" else [a + b, f"{a}-{b}"]
                if raw[k][-1] in "¬­" and channel.words.get(f"{a}-{b}".lower(), 0) > channel.words.get((a + b).lower(), 0):
                    forms.append(f"{a}-{b}")
                entries.append((a + b, forms))
            if not entries:
                self.read[k] = []
                continue
            best = channel.decode(entries, doubt)
            self.read[k] = [(e[0], v) for e, v in zip(entries, best, strict=True)]
            for (token, forms), v in zip(entries, best, strict=True):
                broken = half and token == half[0] + half[1] and forms is entries[-1][1]
                if broken:
                    self.found.append((k, "split_word", v))
                if v not in [f.lower() for f in forms]:
                    self.found.append((k, "misread", v))

    def paragraphs(self) -> str:
        """The page as continuous text: page lines gone, broken words whole, misread words right, blank lines parting."""
        out, current, skip = [], [], False
        for k, line in enumerate(self.lines, 1):
            if k in self.running or k in self.numbers:
                continue
            if not line.strip():
                if current:
                    out.append(" ".join(current))
                current = []
                continue
            words = line.split()
            if skip:
                tail, words, skip = words[0], words[1:], False
                current[-1] += tail[len(tail.rstrip(_STRIP)):]
            read = list(self.read.get(k, []))
            split = any(n == k and d == "split_word" for n, d, _ in self.found)
            for j, w in enumerate(words):
                core = w.strip(_STRIP)
                if not core:
                    current.append(w)
                    continue
                token, v = read.pop(0) if read else (core, core.lower())
                if split and j == len(words) - 1:
                    fixed, skip = v, True
                    lead = w[:len(w) - len(w.lstrip(_STRIP))]
                    current.append(lead + (fixed.capitalize() if core[0].isupper() else fixed))
                    continue
                fixed = core if v == token.lower() else (v.capitalize() if core[0].isupper() and not core.isupper() else v.upper() if core.isupper() and len(core) > 1 else v)
                at = w.find(core)
                current.append(w[:at] + fixed + w[at + len(core):])
        if current:
            out.append(" ".join(current))
        return "\n\n".join(out)


def _pages(image_ingestion: DataFrame) -> DataFrame:
    """The pages with their file: from the metadata, else from the identifier; and the page number where it is known.

    A page without an identifier can't be told from others and is left out.
    """
    meta = F.col("metadata")
    of_id = F.regexp_extract("raw_input_id", r"(\d+)-\d+\D*$", 1)
    file = F.coalesce(F.try_element_at(meta, F.lit("file")), F.when(of_id != "", F.concat(F.lit("scan-"), of_id)), F.col("raw_input_id"))
    number = F.coalesce(F.try_element_at(meta, F.lit("page")).try_cast("int"), F.regexp_extract("raw_input_id", r"(\d+)\D*$", 1).try_cast("int"))
    page = F.coalesce(number.cast("string"), F.col("raw_input_id"))  # scans of one page have the same
    return image_ingestion.where("raw_input_id is not null").select("raw_input_id", "extracted_text", F.col("ocr_confidence").cast("double").alias("confidence"), file.alias("file"), number.alias("number"), page.alias("page"))


def _decoded(image_ingestion: DataFrame, make, schema: str) -> DataFrame:
    pages = _pages(image_ingestion)
    words, digits, counted = word_counts(pages)
    pairs, letters = pair_counts(pages, words)
    marks = running_lines(pages, words).groupBy("id").agg(F.collect_set("line_no").alias("running"))  # at most 2 LINES a page
    joined = pages.join(marks.withColumnRenamed("id", "raw_input_id"), "raw_input_id", "left")
    if counted is None:
        joined = joined.withColumn("rare", F.lit(None).cast("array<struct<w:string,n:bigint>>"))
    else:
        joined = joined.join(rare_words(pages, words, counted).withColumnRenamed("id", "raw_input_id"), "raw_input_id", "left")
    joined = joined.select("raw_input_id", "extracted_text", "confidence", "number", "running", "rare")
    # built once and broadcast, at most 1 / SHARE words and as many pairs; each worker keeps it with what it has looked up
    model = joined.sparkSession.sparkContext.broadcast(Channel(words, pairs, letters, digits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel: Channel = model.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                rows = []
                for i, text, conf, number, running, rare in zip(*[c.to_pylist() for c in b.slice(at, 1024).columns], strict=True):
                    channel.turn(rare)
                    rows += make(i, Page(text, set(running or ()), number, conf, channel))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])
        channel.turn(None)

    kinds = [(x.split()[0], pa.int32() if x.split()[1] == "int" else pa.string()) for x in schema.split(", ")]
    return joined.mapInArrow(run, schema)


def defects(image_ingestion: DataFrame) -> DataFrame:
    """(raw_input_id, line_no, defect, word): every defect of every page.

    A null or empty text has none. Missing metadata are made up for by the identifier; a null confidence changes nothing.
    """
    return _decoded(image_ingestion, lambda i, p: [(i, *f) for f in p.found], "raw_input_id string, line_no int, defect string, word string")


def repaired(image_ingestion: DataFrame) -> DataFrame:
    """(raw_input_id, text): every page as continuous paragraphs; a null or empty text comes out empty."""
    return _decoded(image_ingestion, lambda i, p: [(i, p.paragraphs())], "raw_input_id string, text string")
