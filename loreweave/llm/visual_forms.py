"""One consistent form for texts that look the same.

Text is exploded to positioned code points: a unit per base with its combining
marks, and a single unit for a run of code points that no mapping touches; a text
without any code point that could change is one unit. The code points of the other
units are joined with a broadcast table that holds their decomposition and
look-alikes; combining marks are ordered by class, base and marks are recomposed
by a second broadcast table, and the units are put together again by position.
Both tables come from the Unicode data, about 14,000 rows, whatever the texts.

Texts are shuffled once, by key; the exploded rows stay where they are.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.storage import materialize

#: Letters of the Latin, Greek and Cyrillic scripts with the glyph of the letter before them.
LOOK_ALIKES = {
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "уү", "æ": "ӕ", "ə": "ә", "ɔ": "ͻ", "ɵ": "өѳ", "ʒ": "ӡ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν",
    "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ", "Æ": "Ӕ", "Ə": "Ә",
    "Ɔ": "Ͻ", "Ɵ": "ӨѲ", "Ɛ": "Ԑ", "Ʒ": "Ӡ", "Γ": "Г", "Λ": "Ʌ", "Π": "П", "Σ": "Ʃ", "Φ": "Ф", "Ψ": "Ѱ",
    "α": "ɑ", "ε": "ɛԑ", "ι": "ɩ", "κ": "к", "μ": "µ", "ψ": "ѱ",
    "в": "ʙ", "г": "ᴦ", "и": "ᴎ", "л": "ᴧ", "м": "ᴍ", "н": "ʜ", "п": "ᴨ", "т": "ᴛ", "я": "ᴙ", "ԍ": "ɢ",
}
#: Invisible code points that aren't format or control characters.
_HIDDEN = r"\x{34f}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{3164}\x{ffa0}\x{fe00}-\x{fe0f}\x{e0100}-\x{e01ef}"
#: Format characters that do show, controls that shape a text, and the joiner.
_SHOWN = r"\t\n\x0b\f\r\x85\x{600}-\x{605}\x{6dd}\x{70f}\x{890}\x{891}\x{8e2}\x{110bd}\x{110cd}\x{200d}"
_JOINER = r"\x{200d}"
#: Code points that neither change nor combine: ASCII and the unified ideographs.
_SETTLED = r"[\x00-\x7f\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
#: A Hangul syllable in separate letters, which is composed as a whole.
_JAMO = ((0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2))
_HANGUL = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11a8}-\x{11c2}]?"


def _all_characters() -> list[str]:
    return [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]


def _plain(c: str, twins: dict[str, str]) -> str:
    """Decomposition of one code point: canonical, width, ligatures, spaces, look-alikes."""
    kind, _, rest = unicodedata.decomposition(c).rpartition("> ")
    name = unicodedata.name(c, "")
    joined = kind == "<compat" and "LIGATURE" in name and "ARABIC" not in name
    whole = "".join(chr(int(x, 16)) for x in rest.split()) if joined or kind in ("<wide", "<narrow") else c
    if unicodedata.category(whole[0]) == "Zs" and whole != "\u1680":
        whole = " "
    return "".join(twins.get(x, x) for x in unicodedata.normalize("NFD", whole))


def decompositions() -> dict[str, str]:
    """What each code point becomes, for those that don't stay as they are."""
    twins = {x: base for base, others in LOOK_ALIKES.items() for x in others}
    return {c: plain for c in _all_characters() if c > "\x7f" and (plain := _plain(c, twins)) != c}


def _char_class(characters: list[str]) -> str:
    """A regular-expression class body with ranges."""
    points = sorted(set(map(ord, characters)))
    ranges, start = [], points[0]
    for a, b in zip(points, [*points[1:], -1]):
        if b != a + 1:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{a:x}}}")
            start = b
    return "".join(ranges)


def _paged_class(characters: list[str]) -> str:
    """A character class by pages, so that most code points are refused by a few comparisons."""
    pages: dict[int, dict[int, list[str]]] = {}
    for c in characters:
        pages.setdefault(ord(c) >> 12, {}).setdefault(ord(c) >> 7, []).append(c)
    page = lambda at, bits, body: f"[\\x{{{at << bits:x}}}-\\x{{{((at + 1) << bits) - 1:x}}}&&[{body}]]"
    return "(?![\\x00-\\x7f])[" + "".join(page(at, 12, "".join(page(low, 7, _char_class(some)) for low, some in inner.items())) for at, inner in pages.items()) + "]"


class Forms:
    """Both tables and the pattern of a unit, built once on the driver."""

    def __init__(self) -> None:
        self.mapped = decompositions()
        self.marks = {c: unicodedata.combining(c) for c in _all_characters() if unicodedata.combining(c)}
        combining = [*self.marks, *(c for c, plain in self.mapped.items() if plain[0] in self.marks)]
        mark = rf"[\p{{M}}\x{{ff9e}}\x{{ff9f}}&&[{_char_class(combining)}]]"
        self.unit = f"(?s){_SETTLED}++(?!{mark})|{_SETTLED}+(?={_SETTLED}{mark})|{_HANGUL}|.{mark}*"
        self.composed: dict[str, str] = {}
        for c, plain in self.mapped.items():
            if len(plain) > 1 and unicodedata.normalize("NFC", c) == c and unicodedata.decomposition(c)[:1] != "<":
                self.composed.setdefault(plain, c)
        moved = [c for c, plain in self.mapped.items() if self.composed.get(plain, plain) != c]
        jamo = [chr(x) for first, last in _JAMO for x in range(first, last + 1)]
        self.odd = _paged_class([*combining, *moved, *jamo])

    def mapping(self, spark: SparkSession) -> DataFrame:
        """part, to: the code points it becomes, each with its class."""
        rows = [(c, [(self.marks.get(x, 0), x) for x in plain]) for c, plain in self.mapped.items()]
        rows += [(c, [(k, c)]) for c, k in self.marks.items() if c not in self.mapped]
        return spark.createDataFrame(rows, "part string, to array<struct<class:int,ch:string>>")

    def composition(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.composed.items()), "apart string, whole string")


_FORMS: list[Forms] = []


def _forms() -> Forms:
    if not _FORMS:
        _FORMS.append(Forms())
    return _FORMS[0]


def _without_hidden(text: Column) -> Column:
    """Without invisible characters; the joiner stays only between two symbols, where it makes one of them."""
    gone = F.regexp_replace(text, rf"[\p{{Cf}}\p{{Cc}}{_HIDDEN}&&[^{_SHOWN}]]", "")
    return F.regexp_replace(gone, rf"([\p{{So}}\p{{Sk}}]{_JOINER}(?=\p{{So}}))|{_JOINER}", "$1")


def visual_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """The key column, the text and its ``form``; keys must be unique.

    A null text has a null form, an empty one or one of invisible characters only
    an empty form. Letter case, digits, accents, symbols, raised and lowered
    characters and the number of spaces are kept; the form of a form is itself.
    Other columns are ignored.
    """
    spark, forms = df.sparkSession, _forms()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).repartition("key")
    plain = rows.select("key", _without_hidden(F.col("text")).alias("plain"))
    plain = plain.withColumn("moves", F.coalesce(F.col("plain").rlike(forms.odd), F.lit(False)))
    units = F.when(F.col("moves"), F.regexp_extract_all("plain", F.lit(forms.unit), F.lit(0))).otherwise(F.array("plain"))
    cut = plain.select("key", "moves", F.posexplode_outer(units).alias("unit_no", "unit"))
    parts = F.when(~F.col("moves") | F.col("unit").rlike(f"^{_SETTLED}+$"), F.array("unit")).otherwise(F.split("unit", ""))
    points = cut.select("key", "unit_no", F.posexplode(parts).alias("point_no", "part"))
    points = points.join(F.broadcast(forms.mapping(spark)), "part", "left")
    to = F.coalesce("to", F.array(F.struct(F.lit(0).alias("class"), F.col("part").alias("ch"))))
    ordered = F.transform(to, lambda x, i: F.struct(x["class"].alias("class"), F.col("point_no").alias("point_no"), i.alias("i"), x["ch"].alias("ch")))
    built = points.select("key", "unit_no", ordered.alias("to")).groupBy("key", "unit_no").agg(F.array_sort(F.flatten(F.collect_list("to"))).alias("to"))
    built = built.select("key", "unit_no", F.array_join(F.transform("to", lambda x: x["ch"]), "").alias("apart"))
    table = forms.composition(spark)
    built = built.join(F.broadcast(table), "apart", "left")
    first = F.broadcast(table.select(F.col("apart").alias("two"), F.col("whole").alias("start")))
    built = built.withColumn("two", F.when(F.col("whole").isNull() & (F.length("apart") > 2), F.substring("apart", 1, 2))).join(first, "two", "left")
    shown = F.coalesce("whole", F.concat("start", F.substring("apart", 3, 1 << 30)), "apart")
    joined = built.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_no", shown.alias("s")))), lambda x: x["s"]), "").alias("form"))
    return rows.join(joined, "key", "left").select(F.col("key").alias(key), F.col("text").alias(text), F.when(F.col("text").isNotNull(), F.coalesce("form", F.lit(""))).alias("form"))


def alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of keys whose texts differ but look the same: key_a < key_b.

    Texts without a visible character are in no pair. Null keys take no part;
    the rows of an empty table give none.
    """
    formed = visual_forms(df, key, text).where(F.col("form").rlike(r"[^\s\p{Z}\p{C}]"))
    rows = formed.select(
        F.col(key).alias("key"), F.xxhash64("form").alias("f0"), F.xxhash64(F.lit(7), "form").alias("f1"), F.xxhash64(text).alias("t0"), F.xxhash64(F.lit(7), text).alias("t1")
    )
    rows = materialize(rows, "forms")
    # Different texts of one form are paired first, then their keys: copies of one text never meet each other.
    texts = rows.select("f0", "f1", "t0", "t1").distinct()
    several = texts.groupBy("f0", "f1").agg(F.count("*").alias("n")).where("n > 1").select("f0", "f1")
    kept = texts.join(several, ["f0", "f1"], "left_semi")
    a, b = kept.alias("a"), kept.alias("b")
    same = (F.col("a.f0") == F.col("b.f0")) & (F.col("a.f1") == F.col("b.f1"))
    smaller = (F.col("a.t0") < F.col("b.t0")) | ((F.col("a.t0") == F.col("b.t0")) & (F.col("a.t1") < F.col("b.t1")))
    pairs = a.join(b, same & smaller).select(F.col("a.t0").alias("a0"), F.col("a.t1").alias("a1"), F.col("b.t0").alias("b0"), F.col("b.t1").alias("b1"))
    left = rows.select(F.col("t0").alias("a0"), F.col("t1").alias("a1"), F.col("key").alias("x"))
    right = rows.select(F.col("t0").alias("b0"), F.col("t1").alias("b1"), F.col("key").alias("y"))
    keys = pairs.join(left, ["a0", "a1"]).join(right, ["b0", "b1"])
    return keys.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
