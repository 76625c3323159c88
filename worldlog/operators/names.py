"""Names in other scripts: transliteration by the longest match, marks set aside, the script of a name, variants to search by."""

from __future__ import annotations

import unicodedata
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Simplified romanizations, and a rough phonetic way back, whose long forms come first.
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu",
    "я": "ya", "є": "ye", "і": "i", "ї": "yi", "ґ": "g", "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz",
}
GREEK_TO_LATIN = {
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p",
    "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}
LATIN_LONG = (("shch", "щ"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я"), ("yo", "ё"), ("ye", "е"))
LATIN_TO_CYRILLIC = {
    "a": "а", "b": "б", "c": "к", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и", "j": "й", "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п",
    "q": "к", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "в", "x": "кс", "y": "й", "z": "з",
}
SCRIPTS = (("Latn", r"\p{IsLatin}"), ("Cyrl", r"\p{IsCyrillic}"), ("Grek", r"\p{IsGreek}"))
CYRILLIC_LANGUAGES = ("ru", "uk", "bg", "sr")


def _by_letter(text: Column, table: dict[str, str]) -> Column:
    """Each letter by ``table``, whose keys are small; what a capital stands for begins with one. Others stay."""
    to = F.create_map(*map(F.lit, chain.from_iterable(table.items())))

    def one(c: Column) -> Column:
        mapped = F.try_element_at(to, F.lower(c))
        raised = F.concat(F.upper(F.substring(mapped, 1, 1)), F.substring(mapped, 2, 9))
        return F.coalesce(F.when(c != F.lower(c), raised).otherwise(mapped), c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def cyrillic_to_latin(text: Column) -> Column:
    return _by_letter(text, CYRILLIC_TO_LATIN)


def greek_to_latin(text: Column) -> Column:
    return _by_letter(text, GREEK_TO_LATIN)


def latin_to_cyrillic(text: Column) -> Column:
    """Long forms first, the longest before others, small or with a capital first letter; then letter by letter."""
    pairs = [p for a, b in LATIN_LONG for p in ((a, b), (a.capitalize(), b.upper()))]
    return _by_letter(reduce(lambda col, p: F.replace(col, F.lit(p[0]), F.lit(p[1])), pairs, text), LATIN_TO_CYRILLIC)


def _bare(text: str | None) -> str | None:
    return None if text is None else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def without_marks(text: Column | str) -> Column:
    """Texts by compatibility decomposition, without the marks: of any script, which built-in functions do not decompose."""

    @F.pandas_udf("string")
    def bare(texts: pd.Series) -> pd.Series:
        return texts.map(_bare)

    return bare(text)


def script_counts(text: Column) -> Column:
    """(script, n) of the letters of a text: Latin, Cyrillic, Greek, other."""
    counts = [F.regexp_count(text, F.lit(f"[{p}&&\\p{{L}}]")) for _, p in SCRIPTS]
    other = F.regexp_count(text, F.lit(r"\p{L}")) - reduce(lambda a, b: a + b, counts)
    return F.array(*(F.struct(F.lit(s).alias("script"), n.alias("n")) for s, n in [*zip([s for s, _ in SCRIPTS], counts, strict=True), ("other", other)]))


def dominant_script(text: Column) -> Column:
    """The script of most letters; of equals the first of Latin, Cyrillic, Greek, other; Latin without any letter."""
    counts = script_counts(text)
    most = F.array_max(F.transform(counts, lambda c: c["n"]))
    return F.filter(counts, lambda c: c["n"] == most)[0]["script"]


def name_variants(rows: DataFrame, key: str, name: str, aliases: str, labels: str, languages: list[str] | None = None) -> DataFrame:
    """key, family, value, language, script: variants of names to search by, each once (case and white space aside, first wins).

    ``aliases`` is an array of names, ``labels`` one of (language, label). Latin names get a Cyrillic form only for languages
    that are written so. Null names have no variants.
    """
    languages = languages or []
    first = languages[0] if languages else ""
    read = rows.filter(F.col(name).isNotNull()).select(key, F.col(name).alias("_n"), F.col(aliases).alias("_a"), F.col(labels).alias("_l"), without_marks(name).alias("_f"), dominant_script(F.col(name)).alias("_s"))
    n, s = F.col("_n"), F.col("_s")
    one = lambda family, value, language, script: F.struct(F.lit(family).alias("family"), value.alias("value"), language.alias("language"), script.alias("script"))
    empty, latin = F.lit(""), F.lit("Latn")
    alias = F.transform("_a", lambda a: one("ALIAS", a, empty, dominant_script(a)))
    local = F.transform("_l", lambda x: one("LOCAL_LANGUAGE", x["label"], x["language"], dominant_script(x["label"])))
    kind = "array<struct<family:string,value:string,language:string,script:string>>"
    some = lambda c: F.coalesce(c, F.array().cast(kind))
    cyrillic = F.lit(any(x in CYRILLIC_LANGUAGES for x in languages))
    told = F.array_compact(
        F.array(
            F.when(F.col("_f") != n, one("TRANSLITERATION", F.col("_f"), empty, latin)),
            F.when(s == "Cyrl", one("TRANSLITERATION", cyrillic_to_latin(n), empty, latin)).when(s == "Grek", one("TRANSLITERATION", greek_to_latin(n), empty, latin))
            .when((s == "Latn") & cyrillic, one("TRANSLITERATION", latin_to_cyrillic(F.col("_f")), empty, F.lit("Cyrl"))),
        )
    )
    every = F.concat(F.array(one("EXACT_NAME", n, F.lit(first), s), one("QUOTED_PHRASE", F.concat(F.lit('"'), n, F.lit('"')), F.lit(first), s)), some(alias), told, some(local))
    tidy = F.filter(F.transform(every, lambda v: v.withField("value", F.trim(F.regexp_replace(v["value"], r"(?U)\s+", " ")))), lambda v: v["value"] != "")
    # case aside: a final sigma is a sigma, a sharp s two of them
    caseless = lambda c: F.replace(F.translate(F.lower(c), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    kept = F.filter("_v", lambda v, i: F.array_position("_k", caseless(v["value"])) == i + 1)
    return read.select(key, tidy.alias("_v")).withColumn("_k", F.transform("_v", lambda v: caseless(v["value"]))).select(key, F.inline(kept))
