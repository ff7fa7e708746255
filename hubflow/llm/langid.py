"""Language identification by compression.

Each language gets a zstandard raw-content dictionary made of labelled text.
A text is encoded with every dictionary; the language that needs the fewest
bytes is the answer, and a narrow margin marks the answer as rejected.

Texts are reduced to lower-case letters and single spaces first, so symbols,
digits and case don't decide. A whole text is encoded in pieces of
``PIECE_CHARS``, each against the dictionary afresh: a long text would
otherwise be matched against itself rather than against the language.

Defined cases: null text, empty text or a text without letters gives ``und``
with score 0, rejected. No labelled row at all gives ``und`` everywhere. Equal
sizes go to the language with more labelled rows, then to the lower name.
Rows with null language teach nothing. Columns besides the named ones are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_slices, staged

#: Bound of the labelled sample: so many snippets of so many characters per
#: language, from different texts, drawn by a seeded hash of the text over all
#: labelled rows. Every language is learned.
SNIPPETS = 128
SNIPPET_CHARS = 1024
#: Characters encoded at a time, and the zstandard level.
PIECE_CHARS = 2048
LEVEL = 6
#: Below this relative margin between best and second size the answer is rejected.
MIN_MARGIN = 0.02

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case letters with single spaces; empty if there is no letter."""
    if not text:
        return ""
    out = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return out if any(map(str.isalpha, out)) else ""


@dataclass(frozen=True)
class LanguageModel:
    """Language names, those with more labelled rows first, and their dictionaries."""

    names: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int = LEVEL

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        params = zstandard.ZstdCompressionParameters.from_level(
            self.level, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        out = []
        for content in self.dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", snippets: int = SNIPPETS, seed: int = 7) -> LanguageModel:
    """Dictionaries from rows with a language. What reaches the driver is at
    most ``snippets`` snippets of ``SNIPPET_CHARS`` for each language name."""
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    hashed = rows.select("l", F.xxhash64(F.lit(seed), "t").alias("h"), "t")
    # copies of a text count as one: their hashes are merged before the rank,
    # and only the texts drawn are cut and sent
    texts = hashed.select("l", "h").distinct()
    ranked = staged(texts.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= snippets).select("l", "h", "r"))
    start = F.pmod(F.col("h"), F.greatest(F.length("t") - SNIPPET_CHARS, F.lit(0)) + 1) + 1
    piece = F.col("t").substr(start.cast("int"), F.lit(SNIPPET_CHARS))
    drawn = hashed.join(ranked, ["l", "h"]).select("l", "r", piece.alias("piece")).groupBy("l", "r").agg(F.min("piece").alias("piece"))
    sizes = rows.groupBy("l").count().orderBy(F.desc("count"), "l").collect()
    order = [r["l"] for r in sizes]
    held: dict[str, list[str]] = {name: [] for name in order}
    for r in drawn.orderBy("l", "r").collect():
        held[r["l"]].append(letters(r["piece"]))
    # a raw-content dictionary has at least eight bytes; nearest text goes last
    made = {k: " ".join(reversed(v)).encode().ljust(8) for k, v in held.items()}
    return LanguageModel(tuple(order), tuple(made[k] for k in order))


def scorer(model: LanguageModel):
    """``text -> (language, score)``: the fewest encoded bytes win; the score
    is the relative margin to the second, 0 to 1."""
    compressors = model.compressors()

    def score(text: str | None) -> tuple[str, float]:
        norm = letters(text)
        if not norm or not compressors:
            return "und", 0.0
        pieces = [norm[i : i + PIECE_CHARS].encode() for i in range(0, len(norm), PIECE_CHARS)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
        return model.names[best], 1.0 if rest is None else 1.0 - sizes[best] / rest

    return score


def identify(docs: DataFrame, model: LanguageModel, key: Column, text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``key, lang_pred, score, rejected`` for every row of ``docs``; ``key``
    may be any column expression, also a struct. A map over the whole texts,
    without a shuffle; the model is bounded by ``fit``."""
    rows = docs.select(key.alias("key"), F.col(text).alias("text"))

    def predict(batches):
        score = scorer(model)
        for part in row_slices(batches):
            got = [score(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([g[1] for g in got], pa.float64()),
                    pa.array([g[1] < min_margin for g in got], pa.bool_()),
                ],
                names=["key", "lang_pred", "score", "rejected"],
            )

    key_type = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(predict, f"key {key_type}, lang_pred string, score double, rejected boolean")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Predictions for all documents, learned from four fifths of them."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    out = identify(docs, model, F.struct(F.col("doc_id"), held_out.alias("held_out")))
    return out.select("key.doc_id", "key.held_out", "lang_pred", "score", "rejected")
