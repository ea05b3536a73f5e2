"""Language identification by compression.

A language's model is a raw-content zstandard dictionary: sample text of that
language. A text is cut into blocks, every block is compressed once against each
dictionary, and the language whose dictionary gives the fewest bytes over the
whole text wins. A win by a narrow margin is rejected, whatever its label.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import add_columns

UNDETERMINED = "und"
#: Bytes compressed at once. Large enough for the dictionary and the block to
#: share matches, small enough to bound the memory of one call.
BLOCK_BYTES = 8192
#: zstandard parameters: matches of four bytes, lazy search.
LEVEL, MIN_MATCH = 9, 4
#: Share of the second-best size below which a win is too narrow to keep.
MIN_MARGIN = 0.005
#: Labels that a model may have.
MAX_LABELS = 1024
#: A difference of so many bytes multiplies the odds by e.
BYTES_PER_NAT = 8.0

_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageModel:
    """Languages in ascending order and their dictionaries' bytes."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    order_key: str = "doc_id",
    sample_rows: int = 512,
    row_chars: int = 512,
    dictionary_bytes: int = 131072,
    max_languages: int | None = None,
) -> LanguageModel:
    """Dictionaries from a bounded sample of the labelled rows.

    The bound: about ``sample_rows`` distinct rows of each language, and never
    more than twice as many, chosen by a hash of ``order_key``, or of the text where
    that is null, and of each a stretch of ``row_chars`` characters that starts
    wherever the hash says, taken in the hash's order until a language has
    ``dictionary_bytes`` bytes. Executors take the sample; of rows that share a key,
    or a text without key, one at most is in it. Rows with a null text or label, or
    without letters, teach nothing. With ``max_languages`` only the labels with most
    rows are learned (of as many, the first in order); without it, all are, and more
    than MAX_LABELS are an error, as their dictionaries would not fit a worker.
    """
    rows = labelled.select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.when(F.col(order_key).isNull(), F.xxhash64(F.col(text))).otherwise(F.xxhash64(F.col(order_key))).alias("h")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    found = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("h").alias("n"))
    found = (found.limit(MAX_LABELS + 1) if max_languages is None else found.orderBy(F.desc("rows"), "lang").limit(max_languages)).collect()
    if not found:
        return LanguageModel((), ())
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    scale = 1 << 30
    spark = labelled.sparkSession
    limits = [(r["lang"], min(scale, math.ceil(scale * sample_rows / max(r["n"], 1)))) for r in found]
    limits = F.broadcast(spark.createDataFrame(limits, T.StructType([rows.schema["lang"], T.StructField("limit", T.LongType())])))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - row_chars + 1, F.lit(1))).cast("int") + 1
    sample = (
        rows.join(limits, "lang").where(F.pmod("h", F.lit(scale)) < F.col("limit"))
        .groupBy("lang", "h").agg(F.min(F.col("text").substr(start, F.lit(row_chars))).alias("text"))
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= 2 * sample_rows)
        .select("lang", "h", "text").collect()
    )
    parts: dict[str, list[bytes]] = {}
    for row in sorted(sample, key=lambda r: (r["lang"], r["h"], r["text"])):
        taken = parts.setdefault(str(row["lang"]), [])
        if _LETTER.search(row["text"]) and sum(map(len, taken)) + len(taken) < dictionary_bytes:
            taken.append(row["text"].lower().encode("utf-8", "replace"))
    names = tuple(sorted(n for n in parts if parts[n]))
    # zstandard reads a short dictionary as none at all, so it is filled up.
    return LanguageModel(names, tuple(b"\n".join(parts[n])[:dictionary_bytes].ljust(16, b"\n") for n in names))


class Classifier:
    """The compressors of a model; one in each Python worker."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.coders = []
        for content in model.dictionaries:
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=len(content), source_size=BLOCK_BYTES, min_match=MIN_MATCH, write_content_size=False
            )
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=shared, compression_params=params))

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score from 0 to 1, margin, and whether the margin is too narrow."""
        if text is None or not self.coders or not _LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0, True
        data = text.lower().encode("utf-8", "replace")
        sizes = [0] * len(self.coders)
        for start in range(0, len(data), BLOCK_BYTES):
            block = data[start : start + BLOCK_BYTES]
            for i, coder in enumerate(self.coders):
                sizes[i] += len(coder.compress(block))
        best = min(range(len(sizes)), key=sizes.__getitem__)  # of equal sizes the first language, and rejected
        rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
        margin = 1.0 if rest is None else (rest - sizes[best]) / max(rest, 1)
        weights = [math.exp((sizes[best] - s) / BYTES_PER_NAT) for s in sizes]
        return self.model.languages[best], weights[best] / sum(weights), margin, margin < MIN_MARGIN


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, margin and rejected; columns of these names are replaced.

    A null text or one without letters gets ``und``, score 0, and is rejected;
    so does every text if the model knows no language. Repeated rows get equal
    results. An empty table gives an empty table.
    """
    at = docs.drop("lang_pred", "score", "margin", "rejected").columns.index(text)
    made: list[Classifier] = []
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Sequence[pa.Array]:
        if not made:
            made.append(Classifier(shared.value))
        found = [made[0].classify(t) for t in batch.column(at).to_pylist()]
        columns = list(zip(*found)) or [()] * 4
        return [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]

    return add_columns(docs, "lang_pred string, score double, margin double, rejected boolean", run)


def crc_of(key: str, modulus: int) -> Column:
    """crc32 of a key's decimal text, modulo modulus; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def is_held_out(key: str = "doc_id") -> Column:
    return crc_of(key, 3) == 1


