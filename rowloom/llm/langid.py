"""Language identification by compression: the dictionary of which language makes a text smallest.

A raw-content zstandard dictionary is made for each language from a bounded sample of labelled texts (`per_language` texts
of `shortest` to `longest` characters, those with the smallest hashes, cut at `dictionary_bytes` in all). A text is lower-cased,
what isn't a letter becomes one space, and all of it is compressed in blocks against each dictionary. The smallest sum
wins; ties go to the language with more labelled texts. A text is rejected if the second-best sum is less than
`margin` larger, in proportion.

Defined results: null texts and texts without a letter, or any text when nothing was learned, are `und`, score 0 and
rejected; rows with a null id are predicted and never learned from; repeated rows each get a row; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.common import batched, remainder, rows, texts

PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"
_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_HAS_LETTER = re.compile(r"[^\W\d_]")


def letters(raw: bytes | None) -> bytes:
    """The lower-cased words of a text; empty if it has no letter."""
    text = (raw or b"").decode("utf-8", "replace").lower()
    return _NOT_LETTERS.sub(" ", text).strip().encode() if _has_letter(text) else b""


def _has_letter(text: str) -> bool:
    # The class of the pattern has a few numerals too, so a match is looked at again.
    return any(c.isalpha() for c in text) if (m := _HAS_LETTER.search(text)) and not m[0].isalpha() else m is not None


@dataclass
class LanguageModel:
    dictionaries: dict[str, bytes]  # most frequent language first
    level: int = 5
    block: int = 4096
    margin: float = 0.005
    _made: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_made": []}

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        if not self._made:
            for lang, content in self.dictionaries.items():
                params = zstandard.ZstdCompressionParameters.from_level(self.level, min_match=3, source_size=self.block, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                self._made.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=params)))
        return self._made

    def predict(self, raw: bytes | None) -> tuple[str, float, bool]:
        """(language, score, rejected); score is the saving over the second-best language, in proportion."""
        clean = letters(raw)
        if not clean or not self.dictionaries:
            return "und", 0.0, True
        sums = [(sum(len(c.compress(clean[i : i + self.block])) for i in range(0, len(clean), self.block)), k, lang) for k, (lang, c) in enumerate(self.compressors())]
        best, _, lang = min(sums)
        second = min((s for s, _, other in sums if other != lang), default=None)
        if second is None:
            return lang, 1.0, False
        return lang, 1 - best / second, second < best * (1 + self.margin)


def _limit(wanted: int, different: int) -> int:
    """The 64-bit hash below which about `wanted` of so many different texts lie."""
    return 2**63 - 1 if different <= wanted else (wanted << 64) // different - 2**63


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 400,
    shortest: int = 200,
    longest: int = 8192,
    dictionary_bytes: int = 1 << 16,
    most_languages: int = 500,
    salts: int = 256,
    **options,
) -> LanguageModel:
    """Learns from rows whose text and language aren't null; languages whose texts are all short or long learn from those.

    The `most_languages` languages with the most rows are learned. Hashes are spread evenly, so of a language with many
    different texts only those with hashes below a limit, about three times `per_language` of them, are ranked; they are
    ranked in `salts` parts first, so no task meets a language's other texts.
    """
    held = labelled.select(labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rank = F.struct((~F.length("text").between(shortest, longest)).alias("odd"), F.xxhash64("text").alias("h"))
    ranked = held.select("lang", rank.alias("rank"))
    sizes = ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.approx_count_distinct(F.when(F.col("rank.odd") == odd, F.col("rank.h"))).alias(f"different{odd}") for odd in (False, True)))
    counted = sizes.orderBy(F.desc("n"), "lang").limit(most_languages).collect()  # most_languages rows
    many = {lang: n for lang, n, *_ in counted}
    limits = [(lang, *(_limit(3 * per_language, n) for n in different)) for lang, _, *different in counted]
    limit = F.broadcast(labelled.sparkSession.createDataFrame(limits, "lang string, usual long, odd long"))  # most_languages rows
    below = F.col("rank.h") <= F.when(F.col("rank.odd"), F.col("odd")).otherwise(F.col("usual"))
    each = ranked.join(limit, "lang").where(below).select("lang", "rank").distinct().withColumn("part", F.pmod("rank.h", F.lit(salts)))
    for group in (["lang", "part"], ["lang"]):
        each = each.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy("rank"))).where(F.col("k") <= per_language).drop("k")
    chosen = each.select("lang", F.col("rank.h").alias("h"))  # per_language rows for each of most_languages
    found = held.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    sample: dict[str, list[tuple[int, str]]] = {}
    for lang, h, text in found.select("lang", "h", F.substring("text", 1, dictionary_bytes)).collect():
        sample.setdefault(lang, []).append((h, text))
    content = {}
    for lang in sorted(sample, key=lambda x: (-many[x], x)):
        joined = b" ".join(letters(t.encode()) for _, t in sorted(sample[lang]))
        if len(joined) >= 8:  # zstandard takes no shorter dictionary
            content[lang] = joined[:dictionary_bytes]
    return LanguageModel(content, **options)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a dictionary of dictionary_bytes a language
    run = lambda batches: batched(((i, *shared.value.predict(t)) for i, t in rows(batches)), _PREDICTED)
    return texts(docs, id_col, text_col).mapInArrow(run, PREDICTED)


def rejected(model: LanguageModel, spark: SparkSession):
    """A function of a text column: whether the model rejects each text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def judge(column: pd.Series) -> pd.Series:
        return pd.Series([shared.value.predict(None if t is None else bytes(t))[2] for t in column], dtype=bool)

    return lambda text: judge(text.cast("binary"))


def held_out(id_column: F.Column) -> F.Column:
    """Documents that nothing is learned from: crc32 of the id modulo 4 is 2, or no id."""
    return F.coalesce(remainder(id_column, 4) == 2, F.lit(True))
