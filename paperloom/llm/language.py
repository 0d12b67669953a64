"""Language identification by compression.

Each language has a zstandard raw-content dictionary of its own texts. A text is encoded
with every dictionary; the smallest encoding names the language, and how much larger the
second smallest is tells how sure that is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from paperloom.llm.common import cut, fresh

UNKNOWN = "und"
LEVEL = 6
#: Bound of the labelled sample that a dictionary is made of: documents of a language, whole texts.
#: Longer documents are in it only where a language has no others, and then one of them.
SAMPLE_DOCS, LONG = 128, 1 << 16
#: Bytes of dictionaries that a task holds at once; more languages are compared in several passes.
HELD = 1 << 28
#: Bytes of a text that are encoded at once; each block starts from the dictionary, so the margin does not shrink with length.
BLOCK = 8192
#: Least share by which the second encoding must be larger; texts below it are rejected.
MARGIN = 0.002

_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """``lang, place, data, pass``: a written table of dictionaries, languages with most labelled rows first."""

    table: DataFrame
    passes: int

    def compressors(self, number: int) -> Callable[[], list]:
        """Languages of one pass and their compressors, made where they are used."""
        rows = [(r["lang"], bytes(r["data"])) for r in self.table.where(F.col("pass") == number).orderBy("place").collect()]  # HELD bytes, or one language

        def make() -> list:
            out = []
            for lang, data in rows:
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                out.append((lang, zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)))
            return out

        return make


def held_out(key: Column) -> Column:
    """True where the CRC-32 of the key as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_each: int = SAMPLE_DOCS, long: int = LONG, held: int = HELD) -> Model:
    """Dictionaries from rows that are not held out and have a label, a key and a text.

    The sample is bounded by rows: of each language the ``docs_each`` rows whose key has the
    smallest hash, with their whole texts. Rows of more than ``long`` characters are no sample
    rows, but for the one of the smallest hash where a language has nothing shorter. The window
    sends no more than that from any partition. Every label is learned, however many there are.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & (F.length(text) > 0) & ~held_out(F.col(key))).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    # one task puts the labels in order, a row each
    known = rows.groupBy("lang").count().withColumn("place", F.row_number().over(Window.orderBy(F.col("count").desc(), "lang"))).drop("count")
    order = Window.partitionBy("lang").orderBy("is_long", "h", "text")
    sample = rows.select("lang", "text", (F.length("text") > long).alias("is_long"), F.xxhash64(F.lit("language"), F.col("key")).alias("h")).withColumn("nth", F.row_number().over(order))
    sample = sample.where((F.col("nth") <= docs_each) & (~F.col("is_long") | (F.col("nth") == 1)))
    joined = sample.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("data"))
    data = joined.select("lang", _encoded("data").alias("data")).join(known, "lang")
    ahead = F.sum(F.octet_length("data")).over(Window.orderBy("place"))
    table = cut(data.withColumn("pass", F.floor((ahead - 1) / held).cast("int")), "dictionaries")
    # passes are numbered without gaps, as a long dictionary may skip some
    number = cut(table.withColumn("pass", (F.dense_rank().over(Window.orderBy("pass")) - 1).cast("int")), "dictionaries")
    last = number.agg(F.max("pass")).first()[0]
    return Model(number, 0 if last is None else last + 1)


@F.udf(BinaryType())
def _encoded(text):
    return encoded(text)


def encoded(text: str) -> bytes:
    """Case tells nothing of a language, so texts and dictionaries are lower case."""
    return text.lower().encode("utf-8", "replace")


def identify(docs: DataFrame, model: Model, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1) and ``rejected`` to every row of ``docs``.

    The score is one minus the smallest encoding's share of the second smallest, and 1 if
    the model knows one language only. A null text or one without a letter is ``und``
    with score 0 and rejected; so is every text if the model knows no language. Ties go
    to the language with most labelled rows and are rejected. Columns of these names
    are replaced. Texts are encoded whole, in blocks. A model of several passes
    is compared with one after the other, the texts written in between.
    """

    own = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    so_far, now = fresh([*own, text], "so_far", "now")
    known = docs.select(*own, *([] if text in own else [F.col(text)]), F.lit(None).cast("struct<lang:string,first:long,second:long>").alias(so_far))
    a, b = F.col(so_far), F.col(now)
    for number in range(model.passes):
        known = known.withColumn(now, _sizes(model.compressors(number))(F.col(text)))
        both = F.array_sort(F.array_compact(F.array(a["first"], a["second"], b["first"], b["second"])))
        better = F.when(a["first"].isNull() | (b["first"] < a["first"]), b["lang"]).otherwise(a["lang"])
        merged = F.struct(better.alias("lang"), F.try_element_at(both, F.lit(1)).alias("first"), F.try_element_at(both, F.lit(2)).alias("second"))
        known = known.withColumn(so_far, merged).drop(now)
        if number + 1 < model.passes:
            known = cut(known, "sizes")
    score = F.when(a["first"].isNull(), 0.0).when(a["second"].isNull(), 1.0).otherwise(1 - a["first"] / a["second"])
    return known.select(*own, F.coalesce(a["lang"], F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"), (a["first"].isNull() | (score < margin)).alias("rejected"))


def _sizes(make):
    """The language of the smallest encoding among one pass's, its size and the second smallest; null for texts without letters."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoders = make()
        for s in batches:
            rows = []
            for t in s:
                if not t or not _LETTER.search(t):
                    rows.append((None, None, None))
                    continue
                data = encoded(t)
                parts = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
                sizes = sorted((sum(len(c.compress(p)) for p in parts), i) for i, (_, c) in enumerate(encoders))
                rows.append((encoders[sizes[0][1]][0], sizes[0][0], sizes[1][0] if len(sizes) > 1 else None))
            yield pd.DataFrame({"lang": [r[0] for r in rows], "first": pd.array([r[1] for r in rows], dtype="Int64"), "second": pd.array([r[2] for r in rows], dtype="Int64")})

    return F.pandas_udf(run, "lang string, first long, second long")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op10; ``rejected`` is one column more."""
    model = learn(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose language is certain enough, with their own columns, whatever their names."""
    (row,) = fresh([text], "row")
    found = identify(docs.select(F.struct(*docs.columns).alias(row), F.col(text)), learn(docs), text)
    return found.where(~F.col("rejected")).select(*(F.col(row)[c].alias(c) for c in docs.columns))
