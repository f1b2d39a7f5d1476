"""Language of a text by script, then by letters and words of Latin-script languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code-point ranges of each script and the language it stands for, first match wins.
SCRIPTS = {
    "Chinese": "4E00-9FFF 3400-4DBF 20000-2A6DF F900-FAFF", "Japanese": "3040-30FF 31F0-31FF FF65-FF9F", "Korean": "AC00-D7AF 1100-11FF 3130-318F",
    "Arabic": "0600-06FF 0750-077F 08A0-08FF FB50-FDFF FE70-FEFF", "Hebrew": "0590-05FF FB1D-FB4F", "Thai": "0E00-0E7F", "Hindi": "0900-097F",
    "Bengali": "0980-09FF", "Tamil": "0B80-0BFF", "Telugu": "0C00-0C7F", "Kannada": "0C80-0CFF", "Malayalam": "0D00-0D7F", "Gujarati": "0A80-0AFF",
    "Punjabi": "0A00-0A7F", "Burmese": "1000-109F", "Khmer": "1780-17FF", "Lao": "0E80-0EFF", "Georgian": "10A0-10FF 2D00-2D2F", "Armenian": "0530-058F",
    "Amharic": "1200-137F", "Tibetan": "0F00-0FFF", "Sinhala": "0D80-0DFF", "Russian": "0400-052F", "Greek": "0370-03FF 1F00-1FFF",
}
#: Of each Latin-script language in order, letters and words that must both occur (empty: not needed).
LATIN = (
    ("Vietnamese", "ảạắằẳẵặấầẩẫậđẻẽẹếềểễệỉĩịỏọốồổỗộơớờởỡợủũụưứừửữựỷỹỵ", ""),
    ("Turkish", "ğış", "bir|ve|için|ile|bu|da|de|değil|ama"),
    ("Polish", "ąćęłńóśźż", ""),
    ("Czech", "ěšžřďťňů", ""),
    ("Romanian", "ăâîșț", "și|este|sau|care|pentru"),
    ("Hungarian", "őű", ""),
    ("German", "", "und|der|die|das|ist"),
    ("French", "", "le|la|les|est|une|des"),
    ("Portuguese", "ãõç", "o|a|os|as|de|do|da|é|em|um|uma|não|que"),
    ("Spanish", "", "el|los|las|del|por"),
    ("Spanish", "ñ¿¡", ""),
    ("Italian", "", "il|della|gli|che|è"),
    ("Dutch", "", "het|een|van|dat"),
    ("Swedish", "åäö", "och|att|det|en|ett|är|för|med"),
    ("Norwegian", "åæø", "og|er|det|en|et|for|med|på"),
    ("Danish", "åæø", "og|er|det|en|et|til|med|af"),
    ("Finnish", "äö", "ja|on|ei|se|että|tai|kun|niin"),
    ("Indonesian", "", "yang|dari|untuk|dengan|adalah"),
    ("Swahili", "", "na|ya|wa|ni|kwa|katika|hii|hiyo"),
)
#: Letters (weight 3, 1) and words of Persian, letters and words of Arabic.
PERSIAN = ("پچژگ", "کی", "این|است|که|برای|های|را|در|به|از|می|یک")
ARABIC = ("كيةىإأؤئ", "ال|في|من|على|هذا|هذه|إلى|التي|الذي|كان")


def script_class(name: str) -> str:
    """Regular-expression class of a script, understood by Java and by RE2."""
    spans = [s.split("-") for s in SCRIPTS[name].split()]
    return "[" + "".join(f"\\x{{{a}}}-\\x{{{b}}}" for a, b in spans) + "]"


def word_pattern(words: str) -> str:
    """Any of the words between characters other than ASCII word characters.

    A word that begins or ends with another letter needs an ASCII word character
    beside it there, as boundaries between ASCII classes have it.
    """
    inner, outer = "[A-Za-z0-9_]", "[^A-Za-z0-9_]"
    groups: dict[tuple[bool, bool], list[str]] = {}
    for word in words.split("|"):
        groups.setdefault((word[0].isascii(), word[-1].isascii()), []).append(word)
    # One group per kind of boundary: the boundary is tried once, then the words.
    return "|".join(f"{f'(?:^|{outer})' if left else inner}(?:{'|'.join(group)}){f'(?:$|{outer})' if right else inner}" for (left, right), group in groups.items())


def script_counts(text: Column) -> dict[str, Column]:
    return {name: F.regexp_count(text, F.lit(script_class(name))) for name in SCRIPTS}


def _latin(text: Column, rare: Column, words_of: Column) -> Column:
    """The first rule that holds; in lower case, ``rare`` are the text's characters beyond ASCII, where all the
    rules' letters are, and ``words_of`` its runs of ASCII word characters."""
    lower = F.lower(text)
    value = F.lit("English")
    for name, letters, words in reversed(LATIN):
        plain = [w for w in words.split("|") if w and w.isascii()]
        other = [w for w in words.split("|") if w and not w.isascii()]
        rule = F.arrays_overlap(words_of, F.array(*[F.lit(w) for w in plain])) if plain else F.lit(not words)
        if other:
            rule = rule | lower.rlike(word_pattern("|".join(other)))
        value = F.when((rare.rlike(f"[{letters}]") & rule) if letters else rule, F.lit(name)).otherwise(value)
    return value


def _arabic_or_persian(text: Column) -> Column:
    spaced = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))

    def words_of(words: str) -> Column:
        found = F.filter(F.array(*[F.lit(f" {w} ") for w in words.split("|")]), lambda w: F.contains(spaced, w))
        return 2 * F.size(found)

    persian = 3 * F.regexp_count(text, F.lit(f"[{PERSIAN[0]}]")) + F.regexp_count(text, F.lit(f"[{PERSIAN[1]}]")) + words_of(PERSIAN[2])
    arabic = F.regexp_count(text, F.lit(f"[{ARABIC[0]}]")) + words_of(ARABIC[1])
    return F.when((persian >= 3) & (persian > arabic), F.lit("Persian")).otherwise(F.lit("Arabic"))


def with_language(df: DataFrame, text: str, into: str = "language") -> DataFrame:
    """``df`` with the English name of each text's language; English if nothing else shows, null for null.

    Japanese letters beside ideographs mean Japanese; else the script with most
    code points, at least two, decides (the earlier listed one of a tie); then the
    rules for Latin letters are tried in order. A text of ASCII characters only
    skips the counting.
    """
    names = F.array(*[F.lit(n) for n in SCRIPTS])
    none = F.array(*[F.lit(0)] * len(SCRIPTS))
    # ASCII goes first, so that the classes are tried on few characters of most texts.
    rare = df.withColumn("_rare", F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    counts = F.when(F.col("_rare") != "", F.array(*script_counts(F.col("_rare")).values())).otherwise(none)
    counted = rare.withColumn("_counts", counts).withColumn("_most", F.array_max("_counts"))
    script = F.when(F.col("_most") >= 2, F.element_at(names, F.array_position("_counts", F.col("_most")).cast("int")))
    at = {n: i for i, n in enumerate(SCRIPTS)}
    both = (F.col("_counts")[at["Japanese"]] > 0) & (F.col("_counts")[at["Chinese"]] > 0)
    counted = counted.withColumn("_script", F.when(both, F.lit("Japanese")).otherwise(script))
    counted = counted.withColumn("_words", F.when(F.col("_script").isNull(), F.split(F.lower(text), "[^a-z0-9_]+")))
    value = F.when(F.col("_script") == "Arabic", _arabic_or_persian(F.col(text))).otherwise(F.coalesce("_script", _latin(F.col(text), F.lower("_rare"), F.col("_words"))))
    return counted.withColumn(into, F.when(F.col(text).isNotNull(), value)).drop("_rare", "_counts", "_most", "_script", "_words")


#: Languages that a guard takes for each other, languages that it tells from all others, and the characters that it looks at.
EAST_ASIAN, DISTINCT, GUARDED = ("Chinese", "Traditional Chinese", "Japanese", "Korean"), ("Arabic", "Persian", "Hindi", "Thai", "Hebrew"), 1500


def guarded_sample(text: Column) -> Column:
    """What a language guard looks at: the first 1500 characters without frontmatter, code and maths."""
    body = F.regexp_replace(text, r"(?s)\A.{3}.*?\n---\n", "")
    for part in (r"(?s)```.*?```", r"(?s)\$\$.*?\$\$", r"\$[^$\n]*\$"):
        body = F.regexp_replace(body, part, "")
    return F.substring(body, 1, GUARDED)


def language_matches(sample: Column, language: Column, target: str) -> Column:
    """Whether a sample in a language fits a target language; samples under 20 characters pass.

    East Asian languages fit one another, languages with a script of their own only themselves (Arabic and Persian each
    for itself, too, but such a text passes for a target of the same script), and all others, Russian and Greek among them, one another.
    """
    if target in EAST_ASIAN:
        fits = language.isin(*EAST_ASIAN)
    elif target in DISTINCT:
        fits = language == target
    else:
        fits = ~language.isin(*EAST_ASIAN, *DISTINCT)
    return (F.length(F.trim(sample)) < 20) | fits
