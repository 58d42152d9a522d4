"""Quality rules, line first: lines that fail a rule go, then documents that lost too much. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

# The line rules' patterns.
SENTENCE_END = r"""[.!?:;…。！？]["'”’»)\]]*([\x20\x09-\x0D]|$)"""
# Menu words that fill a line, and phrases of licences, notices and banners, in English, German, French and Spanish.
MENUS = [
    "home", "menu", "next", "previous", "back to top", "skip to content", "share", "log in", "sign up", "read more",
    "startseite", "menü", "weiter", "zurück", "nach oben", "zum inhalt springen", "teilen", "anmelden", "registrieren", "weiterlesen",
    "accueil", "suivant", "précédent", "haut de page", "aller au contenu", "partager", "connexion", "s'inscrire", "lire la suite",
    "inicio", "menú", "siguiente", "anterior", "volver arriba", "saltar al contenido", "compartir", "iniciar sesión", "registrarse", "leer más",
]
PHRASES = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings", "use cookies", "enable javascript", "lorem ipsum", "licensed under", "copyright (c)", "©",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookie-einstellungen", "verwendet cookies", "javascript aktivieren", "lizenziert unter",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "utilise des cookies", "activer javascript", "sous licence",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "utiliza cookies", "habilitar javascript", "bajo la licencia",
]


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words that looks at few of them at each place: those with one first letter are together."""
    quoted = [re.sub(r"([.()'-])", r"[\1]", w) for w in words]
    return "|".join(f"{c}({'|'.join(q[len(c) :] for q in quoted if q.startswith(c))})" for c in sorted({q[0] for q in quoted}))


NAVIGATION = r"(\|[^|]*\|)|(»[^»]*»)|(›[^›]*›)|(^[\x20\x09-\x0D]*(" + _any_of(MENUS) + r")[\x20\x09-\x0D]*$)"
BOILERPLATE = "(" + _any_of(PHRASES) + ")"


def _word_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, BLANK + "+", ""))


def _symbols(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{SYMBOLS}]"))


def clean_lines(
    docs: DataFrame, *, text: str = "text", min_words: int = 20, max_repeat_percent: int = 30, window: int = 8, max_symbol_percent: int = 30, min_kept_percent: int = 50,
) -> DataFrame:
    """docs with the counts below, clean_text, base_failed and kept.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: of the whole text (null: none). Base: a document with
    fewer than `min_words` words, or more than `max_repeat_percent` % of its words in windows of `window` words that
    occur twice or more, fails. Windows and lines are told apart by 64-bit hashes within one document.

    Then each line with a word is judged: it fails without a mark that ends a sentence or with more than
    `max_symbol_percent` symbols for 100 words (punctuation), with two separators or as a lone menu word (navigation),
    or with a boilerplate phrase (boilerplate). clean_text has the other lines, and blank ones
    as they were. A document is kept unless the base failed or its remaining lines have less than `min_kept_percent` %
    of the characters of all lines with a word; n_lines, n_bad_lines and kept_chars tell how it came about.

    Everything is computed within the row: no shuffle, no Python. Work is linear in a text's length but for one sort.

    Edge cases: null and empty texts have no words and fail the base; repeated rows get a row each; columns of the same
    names give way. All helper columns begin with `_vq_` and are dropped.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_bad_lines", "kept_chars", "clean_text", "kept"]
    kept = [c for c in docs.columns if c not in counts]
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(*kept, *([] if text in kept else [F.col(text)]), t.alias("_vq_text"))
    out = out.withColumns({
        "_vq_words": F.transform(F.filter(F.split("_vq_text", BLANK + "+"), lambda w: w != ""), lambda w: F.xxhash64(w)),
        "_vq_all": F.split("_vq_text", "\n", -1),
    })
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    words = lambda x: F.size(F.filter(F.split(x, BLANK + "+"), lambda w: w != ""))
    noisy = lambda x: x.rlike(f"[{SYMBOLS}]") & (100 * _symbols(x) > max_symbol_percent * words(x))
    bad = lambda x: ~x.rlike(SENTENCE_END) | noisy(x) | x.rlike("(?i)" + NAVIGATION) | x.rlike("(?i)" + BOILERPLATE)
    starts = F.when(F.size("_vq_words") >= window, F.sequence(F.lit(1), F.size("_vq_words") - (window - 1))).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.element_at("_vq_words", i + k) for k in range(window)]))
    out = out.withColumns({"_vq_windows": hashed, "_vq_lines": F.filter("_vq_all", has_word)})
    out = out.withColumn("_vq_ok", F.filter("_vq_all", lambda x: ~has_word(x) | ~bad(x)))

    # windows in order of their hashes: those equal to a neighbour, back in the text's order
    sort = lambda c: F.array_sort(F.transform(c, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.when(F.size(F.array_distinct("_vq_windows")) < F.size("_vq_windows"), sort(F.col("_vq_windows")))
    out = out.withColumn("_vq_sorted", repeats)
    size = F.size("_vq_sorted")
    same = lambda x, i: ((i > 0) & (F.get("_vq_sorted", i - 1)["h"] == x["h"])) | ((i < size - 1) & (F.get("_vq_sorted", i + 1)["h"] == x["h"]))
    out = out.withColumn("_vq_at", F.array_sort(F.transform(F.filter("_vq_sorted", same), lambda x: x["i"])))
    gap = F.transform("_vq_at", lambda x, i: F.least(F.lit(window), F.coalesce(F.get("_vq_at", i + 1) - x, F.lit(window))))
    covered = F.coalesce(F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    n_words = F.size("_vq_words").cast("long")
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + _word_chars(x))
    long = lambda c: c.cast("long")
    out = out.select(
        *kept, "_vq_text", n_words.alias("n_words"),
        long(_word_chars(F.col("_vq_text"))).alias("word_chars"),
        long(_symbols(F.col("_vq_text"))).alias("n_symbols"),
        long(F.size("_vq_lines") - F.size(F.array_distinct(F.transform("_vq_lines", lambda x: F.xxhash64(x))))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"), long(F.size("_vq_lines")).alias("n_lines"),
        long(F.size("_vq_all") - F.size("_vq_ok")).alias("n_bad_lines"), chars(F.col("_vq_ok")).alias("kept_chars"), F.array_join("_vq_ok", "\n").alias("clean_text"),
    )
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("kept_chars") >= min_kept_percent * F.col("word_chars")))
    return out.select(*kept, *counts)
