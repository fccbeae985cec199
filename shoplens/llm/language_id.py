"""Language identification by compression against per-language zstandard dictionaries.

Learning counts every word (runs of letters, lower-cased) of every training document per language with
Spark. Each language's raw-content dictionary is its most frequent words, rarest first so that the most
frequent ones sit nearest the text, up to DICT_BYTES. Prediction compresses a document's whole text once
with each dictionary; the language whose dictionary gives the smallest frame wins. The margin to the
runner-up, relative to the runner-up's size, is the score; below MIN_MARGIN the choice counts as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from shoplens.llm.shared import checkpointed

#: Bytes of each language's dictionary; what reaches the driver is this times the number of languages.
DICT_BYTES = 64 * 1024
#: Words of a language that may enter its dictionary, before the byte bound (an exact count threshold).
MOST_WORDS = 20_000
#: Compression level of the frames that are compared.
LEVEL = 3
#: Relative margin below which a prediction is marked rejected.
MIN_MARGIN = 0.02
#: Letters, for Java and Python patterns alike.
LETTERS = r"\p{L}+"
UNDETERMINED = "und"


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: occurrences of lower-cased letter runs, over all rows of docs with a lang."""
    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(LETTERS), 0))
    return (docs.where(F.col("lang").isNotNull()).select("lang", words.alias("word"))
            .groupBy("lang", "word").agg(F.count("*").alias("n")))


def dictionaries(docs: DataFrame, dict_bytes: int = DICT_BYTES, most_words: int = MOST_WORDS) -> dict[str, bytes]:
    """Raw dictionary text per language of docs (lang, text): its most frequent words, bounded in bytes.

    Per language, a histogram of the counts gives the smallest count whose words number at most most_words;
    only those are ranked (count, then word), so no task and not the driver holds all distinct words.
    Languages without any word get no dictionary.
    """
    counts = checkpointed(word_counts(docs))
    spectrum = counts.groupBy("lang", "n").agg(F.count("*").alias("words"))
    above = Window.partitionBy("lang").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    floor = (spectrum.withColumn("upto", F.sum("words").over(above)).where(F.col("upto") <= most_words)
             .groupBy("lang").agg(F.min("n").alias("floor")))
    rank = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("word"))
    chosen = (counts.join(F.broadcast(floor), "lang").where(F.col("n") >= F.col("floor"))
              .withColumn("bytes", F.sum(F.octet_length("word") + 1).over(rank.rowsBetween(Window.unboundedPreceding, 0)))
              .where(F.col("bytes") <= dict_bytes)
              .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct(F.col("n"), F.col("word")))).alias("words")))
    return {r["lang"]: " ".join(w["word"] for w in r["words"]).encode() for r in chosen.collect()}


def _compressors(dicts: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang in sorted(dicts):
        data = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False,
                                                   write_checksum=False, write_dict_id=False)))
    return out


def predict_text(text: str | None, compressors) -> tuple[str, float, bool]:
    """(lang, score, rejected) of one text; 'und', 0, True for null, letterless text or no language."""
    if text is None or not compressors or not regex.search(LETTERS, text):
        return UNDETERMINED, 0.0, True
    body = text.lower().encode()
    sizes = sorted((len(c.compress(body)), lang) for lang, c in compressors)
    best, lang = sizes[0]
    second = sizes[1][0] if len(sizes) > 1 else best * 2
    score = (second - best) / second if second else 0.0
    return lang, float(score), score < MIN_MARGIN


def predicted(docs: DataFrame, dicts: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected.

    Every whole text is compressed with each dictionary; ties of size go to the language first in byte order.
    Null or letterless texts give 'und', score 0, rejected. An empty table gives no rows; other columns stay.
    """
    out_schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                             StructField("rejected", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(dicts)
        for batch in batches:
            found = [predict_text(t, compressors) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])
    return docs.mapInArrow(run, out_schema)


def training_rows(docs: DataFrame, held_out: Column) -> DataFrame:
    """Rows that teach: not held out, with a lang and a text."""
    return docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
