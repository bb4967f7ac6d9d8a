"""Language identification by compression: the dictionary that shrinks a text most names its language.

The dictionaries are raw zstandard content: texts of the language, those with the smallest hash of their text, up to
a number of documents, characters of each and bytes that are parameters; that is the only sample here. Texts and
dictionaries are reduced to lower-case letters (with their marks) with single spaces between runs of them. A text is compressed whole, in pieces short enough
that the dictionary and not the text itself explains it, and the sizes are summed. Each piece stands between zero
bytes, whose own size is taken off again: the library looks for no match in the last bytes of its input, and stores
very short ones as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txgauge.llm.common import from_texts, others

UNKNOWN = "und"
PIECE = 4096
HEAD, TAIL = bytes(32), bytes(16)
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
ADDED = ("lang_pred", "score", "rejected")


def letters_of(text: str) -> bytes:
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace")


def fit_dictionaries(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", most_docs: int = 64, most_bytes: int = 65536, most_chars: int = 4096, most_langs: int = 1000
) -> dict[str, bytes]:
    """Language to raw dictionary content, from rows with both text and language.

    The sample is most_docs texts, most_chars characters of each and most_bytes bytes a language at most; most_langs
    languages (more raise). Texts are taken by
    ascending hash, so the result does not depend on partitions; rows over a hash bound that leaves far more than
    most_docs texts are dropped before the sort, so no language is sorted as a whole. Languages come by falling number of
    labelled rows: texts too short to be told apart go to the first.
    """
    use = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    use = use.filter("lang is not null and text is not null and length(trim(text)) > 0").withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 20)))
    counts = use.groupBy("lang").agg(F.count_distinct("h").alias("n"), F.count(F.lit(1)).alias("rows")).limit(most_langs + 1).collect()
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not counts:
        return {}
    bound = F.lit(None)
    for r in counts:
        # expected 8 * most_docs distinct hashes under the bound; a language with few has all
        bound = F.when(F.col("lang") == r["lang"], min(1 << 20, -(-(1 << 20) * 8 * most_docs // r["n"]))).otherwise(bound)
    few = use.filter(F.col("h") < bound).select("lang", "h", F.substring("text", 1, most_chars).alias("text")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    out: dict[str, bytes] = {}
    for r in few.withColumn("k", rank).filter(F.col("k") <= most_docs).select("lang", "text").orderBy("lang", F.desc("k")).collect():
        out[r["lang"]] = (out.get(r["lang"], b"") + letters_of(r["text"]))[-most_bytes:]
    return {r["lang"]: out[r["lang"]] for r in sorted(counts, key=lambda r: (-r["rows"], r["lang"]))}


class Classifier:
    """Compressors of all languages, each with the dictionary held ready."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = list(dictionaries)
        self.tools = []
        how = zstandard.ZstdCompressionParameters.from_level(
            6, strategy=zstandard.STRATEGY_GREEDY, min_match=3, write_checksum=0, write_content_size=0, write_dict_id=0
        )
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.tools.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
        self.none = [len(t.compress(HEAD + TAIL)) for t in self.tools]

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language, score); score is by how much of the runner-up's size the winner is smaller, times 4, at most 1."""
        if not self.langs or not _LETTER.search(text or ""):
            return UNKNOWN, 0.0
        raw = letters_of(text)
        pieces = [HEAD + raw[a : a + PIECE] + TAIL for a in range(0, len(raw), PIECE)]
        sizes = sorted((sum(len(tool.compress(p)) - none for p in pieces), k) for k, (tool, none) in enumerate(zip(self.tools, self.none, strict=True)))
        if len(sizes) == 1:
            return self.langs[0], 1.0
        return self.langs[sizes[0][1]], min(1.0, 4 * (sizes[1][0] - sizes[0][0]) / max(sizes[1][0], 1))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], least_score: float = 0.02, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected.

    `und`, score 0 and rejected for null texts, texts without a letter, and if no language was learned; texts whose
    score is under least_score keep their best language and are rejected. Equal sizes go to the language learned
    first, with score 0. Input columns with the added names, in any case, are replaced; an empty table gives an empty result.
    """
    state = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most most_langs * most_bytes

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        classifier = Classifier(state.value)

        def make(texts: list[str | None]) -> list[pa.Array]:
            found = [classifier.classify(t) for t in texts]
            return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

        return make

    out = from_texts(docs, F.col(text_col), others(docs, ADDED), "lang_pred string, score double", start)
    return out.select("*", ((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least_score)).alias("rejected"))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the identifier as text, modulo 3, is 1. A null one is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, **how) -> dict[str, bytes]:
    """Dictionaries from the documents that are not held out."""
    return fit_dictionaries(docs.filter(~held_out()), **how)
