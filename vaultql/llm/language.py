"""Language identification by compression: one raw-content zstandard dictionary for each language."""

from __future__ import annotations

import re
from dataclasses import dataclass

import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_strings, with_columns

#: More languages than this are refused, as every task holds a dictionary of each.
MOST_LANGUAGES = 512
_OTHER = re.compile(r"[\W\d_]+")
#: Characters of one compressed block. Each block starts from the dictionary alone, so long texts don't teach themselves.
BLOCK = 2000


def letters(text: str | None) -> str:
    """Lower-cased runs of letters between single spaces, a repeated one once; empty if there is no letter."""
    words = _OTHER.sub(" ", text.lower()).split() if text else []
    made = " ".join([a for a, b in zip(words, [None, *words]) if a != b])
    return made if any(map(str.isalpha, made)) else ""


@dataclass
class LanguageModel:
    """Dictionaries by language, the language with most rows first."""

    dictionaries: dict[str, bytes]
    level: int = 5

    def classifier(self):
        """A function from a text to its sizes in bytes under each dictionary; None for a text without letters."""
        made = []
        for raw in self.dictionaries.values():
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=self.level)
            made.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

        def sizes(text: str | None) -> list[int] | None:
            plain = letters(text)
            if not plain:
                return None
            blocks = [plain[at : at + BLOCK].encode() for at in range(0, len(plain), BLOCK)]
            return [sum(len(compress(b)) for b in blocks) for compress in made]

        return sizes


def learn_languages(docs: DataFrame, *, lang: str = "lang", text: str = "text", order: Column | None = None, dictionary_bytes: int = 192 << 10, passage: int = 600) -> LanguageModel:
    """Dictionaries from a bounded sample of the rows of `docs` whose lang and text are not null.

    Each language gives passages of `passage` characters, one of a different text each, up to `dictionary_bytes` bytes.
    Texts are taken by the hash `order` (default: of the text), so the sample doesn't depend on how rows are dealt out.
    A language's share of hashes follows from its number of different texts, and copies fall together before they leave
    their task, so a text that repeats counts once however often it does. No more than `wanted` rows of a language (twice
    what its dictionary needs, and 100) reach the driver, whatever the size of the table.

    A table without such rows gives a model without languages, under which every text is `und`.
    """
    key = F.xxhash64(text) if order is None else order
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), key.alias("at"))
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("at").alias("different")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counted:
        return LanguageModel({})
    wanted = 2 * max(1, dictionary_bytes // passage) + 100
    # a fifth more than wanted, as the number of different texts is known to a few per cent
    share = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1.0, 1.2 * wanted / max(1, r["different"])))])
    rows = rows.where(F.pmod("at", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    start = F.pmod(F.shiftrightunsigned("at", 32), F.greatest(F.length("text") - passage, F.lit(0)) + 1) + 1
    rows = rows.groupBy("lang", "at").agg(F.min(F.col("text").substr(start.cast("int"), F.lit(passage))).alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at"))  # over a bounded sample by now
    parts: dict[str, list[str]] = {r["lang"]: [] for r in counted}
    for row in rows.withColumn("rank", rank).where(F.col("rank") <= wanted).orderBy("lang", "at").toLocalIterator():
        parts[row["lang"]].append(letters(row["part"]))
    return LanguageModel({name: " ".join(dict.fromkeys(p for p in found if p)).encode()[:dictionary_bytes] or b" " for name, found in parts.items()})


def identify_language(docs: DataFrame, model: LanguageModel, *, text: str = "text", min_margin: float = 0.003, keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score, margin and rejected.

    Each text is encoded whole with every dictionary, and the smallest encoding wins (of equal ones the language with
    more learned rows). `margin` is by how much the second smallest is larger, as a share of the smallest; below
    `min_margin` the row is rejected, lang_pred still naming the best guess. score is the winner's share of weights
    2 ** -(excess bytes): 0.5 for a tie of two, near 1 for a clear win.

    Edge cases: a null text or one without letters is `und`, score 0, rejected. With one language there is no second,
    and nothing with letters is rejected. Repeated rows get a row each; columns of the same names give way.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = list(model.dictionaries)

    def task():
        sizes_of = held.value.classifier()

        def one(value):
            sizes = sizes_of(value) if names else None
            if sizes is None:
                return "und", 0.0, 0.0, True
            best = min(sizes)
            if len(sizes) == 1:
                return names[0], 1.0, 1.0, False
            second = sorted(sizes)[1]
            margin = (second - best) / best
            return names[sizes.index(best)], 1 / sum(2.0 ** -min(60, s - best) for s in sizes), margin, margin < min_margin

        def make(batch):
            return [list(c) for c in zip(*map(one, column_strings(batch, text)), strict=True)] or [[]] * 4

        return make

    return with_columns(docs, [("lang_pred", "string"), ("score", "double"), ("margin", "double"), ("rejected", "boolean")], task, keep)
