"""One consistent form for text that looks the same but is written with different characters.

Arrow text becomes numpy code-point arrays; lookup tables indexed by code point say what each becomes, and expansion
offsets place the results; marks are ordered and composed by array operations. No string call is made per row.

What cannot be seen is made equal: invisible characters, kinds of blank, full-width forms, letters of other scripts
drawn alike, ligatures and other codings of one letter. What can be seen stays: case, accents, dots, raised digits,
fractions, added marks, joiners that choose the shape of a conjunct, and the styles of mathematical letters (bold, italic,
script), but for the upright sans-serif ones.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import codepoints as cps

_TOP = 0x110000
ZWNJ, ZWJ = 0x200C, 0x200D

# Letters of other scripts that are drawn as the Latin letter beside them.
ALIKE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Һ": "h", "а": "a", "е": "e", "ѕ": "s", "і": "i",
    "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ҽ": "e", "Ӏ": "I", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
    "Օ": "O", "Ս": "U", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S",
    "Ꭲ": "T", "Ꮃ": "W", "Ꮓ": "Z", "Ꭰ": "D", "Ꮐ": "G", "Ꮢ": "R", "Ꮩ": "V", "Ꭵ": "i", "ꭺ": "ᴀ", "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G",
    "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X",
    "ꓬ": "Y", "ꓜ": "Z", "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X",
    "Ѵ": "V", "ѵ": "v", "ѡ": "w", "ɑ": "a", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ⅼ": "l", "ɡ": "g", "ℎ": "h",
    "‚": ",", "٫": ",", "ǃ": "!", "։": ":", "꞉": ":", "∶": ":", "ː": ":", "․": ".", "ꓸ": ".",
}
# Further codings of one letter, as the parts it is drawn of.
PARTS = {
    "आ": "अा", "ओ": "अाे", "औ": "अाै", "ऑ": "अाॅ", "ऐ": "एे", "ो": "ाे", "ौ": "ाै", "ॉ": "ाॅ", "ॊ": "ाॆ", "ऒ": "अाॆ",
    "আ": "অা", "ௗ": "ள", "ஔ": "ஒள", "ৎ": "ত্‍", "આ": "અા", "ઓ": "અાે", "ઔ": "અાૈ", "ો": "ાે", "ૌ": "ાૈ",
}
# Viramas, whose following joiner may choose a conjunct's shape.
VIRAMAS = (0x094D, 0x09CD, 0x0A4D, 0x0ACD, 0x0B4D, 0x0C4D, 0x0CCD, 0x0D4D, 0x0DCA)
TAMIL_VIRAMA = 0x0BCD


def _target(c: str) -> str:
    """What one character becomes, decomposed; '' drops it."""
    o, kind = ord(c), unicodedata.category(c)
    if o in (ZWNJ, ZWJ) or c in "\n\r":
        return c
    if kind in ("Zs", "Zl", "Zp") or c in "\t\x0b\x0c\x85":
        return " "
    if o == 0x2800:
        return " "
    if kind in ("Cf", "Cc") or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or 0x180B <= o <= 0x180F or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
        return ""
    if o in (0x2010, 0x2011):
        return "-"
    d = unicodedata.decomposition(c)
    tag = d.split(" ", 1)[0] if d.startswith("<") else ""
    letters = kind in ("Lu", "Ll", "Lt", "Nl", "Lo") and not 0x3130 <= o <= 0x318F
    if tag in ("<wide>", "<narrow>") or tag == "<compat>" and letters or tag == "<font>" and 0x1D5A0 <= o <= 0x1D5D3:
        return "".join(map(_target, unicodedata.normalize("NFKD", c)))
    parts = unicodedata.normalize("NFD", c)
    if parts == c:
        parts = ALIKE.get(c, PARTS.get(c, c))
    # each part may itself be one of these, so the form is the same whichever way a letter is coded
    return c if parts == c else "".join(x if x == c else _target(x) for x in parts)


@cache
def tables() -> dict[str, np.ndarray]:
    """Lookup tables by code point, built from the Unicode data and the fixed values above."""
    count, start = np.ones(_TOP, np.uint8), np.zeros(_TOP, np.int64)
    data: list[int] = []
    order, letter = np.zeros(_TOP, np.uint8), np.zeros(_TOP, bool)
    pairs: dict[int, int] = {}
    single = np.arange(_TOP, dtype=np.uint32)
    for o in (*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)):
        c = chr(o)
        order[o] = unicodedata.combining(c)
        letter[o] = unicodedata.category(c) == "Lo"
        t = _target(c)
        if len(t) == 1:
            single[o] = ord(t)
        else:
            count[o], start[o] = len(t), len(data)
            data += map(ord, t)
        d = unicodedata.decomposition(c)
        if d and not d.startswith("<") and " " in d and unicodedata.normalize("NFC", c) == c:
            a, b = (int(x, 16) for x in d.split())
            pairs[a << 21 | b] = o
    for c, p in PARTS.items():
        x = _target(c) if len(c) == 1 else ""
        if len(x) == 2 and c != "ௗ":
            pairs[ord(x[0]) << 21 | ord(x[1])] = ord(c)
    for a, b, c in (("ा", "े", "ो"), ("ा", "ै", "ौ"), ("ा", "ॅ", "ॉ"), ("आ", "े", "ओ"), ("आ", "ै", "औ"), ("आ", "ॅ", "ऑ"), ("अ", "ा", "आ"), ("ए", "े", "ऐ"), ("अ", "ो", "ओ"), ("अ", "ौ", "औ"), ("अ", "ॉ", "ऑ"), ("অ", "া", "আ")):
        pairs[ord(a) << 21 | ord(b)] = ord(c)
    keys = np.array(sorted(pairs), np.uint64)
    second = np.zeros(_TOP, bool)
    second[(keys & np.uint64(0x1FFFFF)).astype(np.int64)] = True
    return {"count": count, "start": start, "data": np.array(data or [0], np.uint32), "single": single, "order": order, "letter": letter,
            "keys": keys, "made": np.array([pairs[int(k)] for k in keys], np.uint32), "second": second}


def _expand(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = tables()
    n = t["count"][cp].astype(np.int64)
    if (n == 1).all():
        return t["single"][cp], off
    at = np.r_[0, np.cumsum(n)]
    src = np.repeat(np.arange(len(cp)), n)
    out = t["single"][cp[src]]
    many = np.nonzero(n[src] > 1)[0]
    out[many] = t["data"][t["start"][cp[src[many]]] + many - at[src[many]]]
    return out, at[off]


def _joiners(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drops joiners that shape no conjunct."""
    row = cps.rows_of(off)
    ends = np.zeros(len(cp), bool)
    ends[:-1] = (cp[:-1] == 13) & (cp[1:] == 10) & (row[1:] == row[:-1])  # both line ends look the same
    if ends.any():
        cp, off = cps.keep(cp, off, ~ends)
    is_joiner = (cp == ZWNJ) | (cp == ZWJ)
    if not is_joiner.any():
        return cp, off
    row = cps.rows_of(off)
    # of a run of joiners only the first can count
    first = is_joiner & ~np.r_[False, is_joiner[:-1] & (row[1:] == row[:-1])]
    cp, off = cps.keep(cp, off, ~is_joiner | first)
    row = cps.rows_of(off)
    i = np.nonzero((cp == ZWNJ) | (cp == ZWJ))[0]
    n = len(cp)
    at = lambda d: np.where((i + d >= 0) & (i + d < n) & (row[np.clip(i + d, 0, n - 1)] == row[i]), cp[np.clip(i + d, 0, n - 1)], 0)
    before, after, before2 = at(-1), at(1), at(-2)
    letter = tables()["letter"]
    shapes = np.isin(before, VIRAMAS) & letter[after] | np.isin(after, VIRAMAS) & letter[before]
    shapes |= (before == TAMIL_VIRAMA) & ((after == 0x0BB7) & (before2 == 0x0B95) | (after == 0x0BB0) & ((before2 == 0x0BB8) | (before2 == 0x0BB6)))
    # the coding of khanda ta keeps its joiner also before a blank
    shapes |= (before == 0x09CD) & (before2 == 0x09A4) & (cp[i] == ZWJ)
    mask = np.ones(n, bool)
    mask[i[~shapes]] = False
    return cps.keep(cp, off, mask)


def _arrange(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Marks after one base in their canonical order."""
    o = tables()["order"][cp]
    if not (o[1:] < o[:-1])[o[1:] > 0].any():
        return cp
    row = cps.rows_of(off)
    part = np.cumsum((o == 0) | np.r_[True, row[1:] != row[:-1]])
    i = np.nonzero(o > 0)[0]
    out = cp.copy()
    out[i] = cp[i][np.lexsort((o[i], part[i]))]
    return out


def _compose(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = tables()
    while True:
        row_start = np.zeros(len(cp) + 1, bool)
        row_start[off] = True
        i = np.nonzero(t["second"][cp] & ~row_start[:-1])[0]
        if not len(i):
            return cp, off
        key = cp[i - 1].astype(np.uint64) << np.uint64(21) | cp[i].astype(np.uint64)
        k = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        hit = t["keys"][k] == key
        i, k = i[hit], k[hit]
        if not len(i):
            return cp, off
        free = np.r_[True, i[1:] != i[:-1] + 1]  # of a chain of pairs the first is taken, the rest next time
        i, k = i[free], k[free]
        cp = cp.copy()
        cp[i - 1] = t["made"][k]
        mask = np.ones(len(cp), bool)
        mask[i] = False
        cp, off = cps.keep(cp, off, mask)


def canonical_array(col: pa.Array) -> pa.Array:
    """The consistent form of every string of an Arrow array; null stays null, '' stays ''."""
    null = col.is_null().to_numpy(zero_copy_only=False)
    cp, off = cps.explode(col)
    if len(cp):
        cp, off = _expand(cp, off)
        cp, off = _joiners(cp, off)
        cp, off = _compose(_arrange(cp, off), off)
    return cps.implode(cp, off, null)


def canonical(df: DataFrame, identifier: str, columns: list[str]) -> DataFrame:
    """`df` reduced to `identifier` and `columns`, each with its consistent form beside it as `<column>_canonical`.

    Other columns of `df`, whatever their names, take no part.
    """
    got = df.select(identifier, *columns)
    kind = dict(got.dtypes)[identifier]
    schema = f"`{identifier}` {kind}, " + ", ".join(f"`{c}` string, `{c}_canonical` string" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, names = [b.column(identifier)], [identifier]
            for c in columns:
                out += [b.column(c), canonical_array(b.column(c))]
                names += [c, f"{c}_canonical"]
            yield pa.RecordBatch.from_arrays(out, names)

    return got.mapInArrow(run, schema)


def _looks(df: DataFrame, identifier: str, columns: list[str]) -> DataFrame:
    """(id, field, l1, l2, f1, f2): the look and the spelling of every text, each as two hashes; nulls and texts in which nothing can be seen are left out."""
    c = canonical(df.where(F.col(identifier).isNotNull()), identifier, columns)
    two = lambda x, n: [F.xxhash64(x).alias(f"{n}1"), F.xxhash64(F.lit(1), F.col(x)).alias(f"{n}2")]
    each = [F.when(F.trim(f"{x}_canonical") != "", F.struct(F.lit(x).alias("field"), *two(f"{x}_canonical", "l"), *two(x, "f"))) for x in columns]
    return c.select(F.col(identifier).cast("long").alias("id"), F.explode(F.array(*each)).alias("s")).where("s is not null").select("id", "s.*")


LOOK = ["field", "l1", "l2"]


def same_look(df: DataFrame, identifier: str, columns: list[str]) -> DataFrame:
    """(field, id_low, id_high): pairs of rows whose `field` looks the same but is not the same string.

    Nulls, and texts in which nothing can be seen, take no part. Groups are joined by their distinct spellings, so that
    many copies of one spelling are never compared with each other; rows are attached to the pairs of spellings after.
    `look_classes` has the same as classes, without pairs.
    """
    rows = cut(_looks(df, identifier, columns))
    ends = [f(c).alias(f"{c}{n}") for c in ("f1", "f2") for n, f in (("a", F.min), ("b", F.max))]
    many = rows.groupBy(*LOOK).agg(*ends).where("f1a != f1b or f2a != f2b").select(*LOOK)
    live = cut(rows.join(many, LOOK, "left_semi"))
    forms = live.select(*LOOK, "f1", "f2").distinct()
    named = lambda f, a: f.withColumnsRenamed({"f1": f"{a}1", "f2": f"{a}2"})
    pair = named(forms, "x").join(named(forms, "y"), LOOK).where(F.struct("x1", "x2") < F.struct("y1", "y2")).drop("l1", "l2")
    own = live.drop("l1", "l2")
    got = pair.join(named(own, "x").withColumnRenamed("id", "i"), ["field", "x1", "x2"]).join(named(own, "y").withColumnRenamed("id", "j"), ["field", "y1", "y2"])
    return got.where("i != j").select("field", F.least("i", "j").alias("id_low"), F.greatest("i", "j").alias("id_high"))


def look_classes(df: DataFrame, identifier: str, columns: list[str]) -> DataFrame:
    """(field, class_id, rows, spellings): the classes of texts that look the same, by their smallest identifier.

    Counted in two steps, by spelling and then by look, with partial sums in each; a look of many rows is no large group.
    """
    rows = _looks(df, identifier, columns)
    by_form = rows.groupBy(*LOOK, "f1", "f2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return by_form.groupBy(*LOOK).agg(F.min("id").alias("class_id"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("spellings")).drop("l1", "l2")
