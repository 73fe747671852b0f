"""Language identification by compression.

Each language has a raw-content dictionary for zstandard: text of that language. A
text is cut into blocks, every block is compressed with every dictionary, and the
language with the smallest total wins. A narrow margin to the second is a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hostwarden.llm.texts import arrow_pass, byte_lists, id_remainder, small_batches

#: Bounds of the fit: documents per language, characters taken of each, bytes of a dictionary, languages.
SAMPLE_DOCUMENTS = 600
PIECE_CHARACTERS = 1_000
DICTIONARY_BYTES = 100_000
MAX_LANGUAGES = 500
#: Blocks of a text that are compressed one by one, so that a dictionary counts in every part of it.
BLOCK_BYTES = 4_000
LEVEL = 5
#: Sizes that are closer than this share of the larger are a rejection.
MIN_MARGIN = 0.01
#: How fast a score falls with the relative size.
SHARPNESS = 40.0
UNDETERMINED = "und"


def fit_dictionaries(labelled: DataFrame, sample: int = SAMPLE_DOCUMENTS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary per value of ``lang``, the language of most documents first, from a bounded sample of ``labelled`` (doc_id, text, lang).

    At most ``sample`` documents of a language are taken, those with the least hash of
    id and text; rows with a null or empty text or a null lang are left out.
    """
    rows = labelled.filter("lang IS NOT NULL AND length(text) > 0").select("lang", "text", F.xxhash64("doc_id", "text").alias("place"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    if not counts:
        return {}
    # A share of the hash range first, so that what reaches the exact choice is bounded as well.
    range_of = {lang: -(2**63) + min(2**64 - 1, int(2**64 * 4 * sample / n)) for lang, n in counts.items()}
    limit = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(most)) for lang, most in range_of.items()])
    order = Window.partitionBy("lang").orderBy("place", "text")
    taken = rows.filter(F.col("place") <= limit).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample)
    start = F.pmod(F.col("place"), F.greatest(F.length("text") - PIECE_CHARACTERS, F.lit(1))).cast("int") + 1
    pieces = taken.select("lang", "rank", F.col("text").substr(start, F.lit(PIECE_CHARACTERS)).alias("piece")).toArrow().to_pylist()
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in pieces:
        texts.setdefault(row["lang"], []).append((row["rank"], row["piece"]))
    by_count = sorted(texts, key=lambda lang: (-counts[lang], lang))
    return {lang: folded("\n".join(piece for _, piece in sorted(texts[lang])))[:size] for lang in by_count}


def folded(text: str) -> bytes:
    """Lower case, so that capitals match a dictionary of running text."""
    return text.lower().encode()


class Compressors:
    """Compressed sizes of texts under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL) -> None:
        import zstandard

        self.languages = list(dictionaries)
        self.compress = []
        for language in self.languages:
            known = zstandard.ZstdCompressionDict(dictionaries[language], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: bytes) -> np.ndarray:
        blocks = [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
        return np.array([sum(len(compress(b)) for b in blocks) for compress in self.compress], dtype=np.float64)

    def predict(self, text: bytes | None, min_margin: float) -> tuple[str, float, float, bool]:
        """Language, score, margin to the second, accepted."""
        if not text or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, 0.0, False
        sizes = self.sizes(folded(text.decode("utf-8", "replace")))
        best = int(sizes.argmin())
        score = 1 / np.exp(-SHARPNESS * (sizes / sizes[best] - 1)).sum()
        others = np.delete(sizes, best)
        margin = 1 - sizes[best] / others.min() if len(others) else 1.0
        return self.languages[best], float(score), float(margin), bool(margin >= min_margin)


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def identify(documents: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """Per document: doc_id, lang_pred, score (0 to 1), margin, accepted.

    ``accepted`` is false where the margin is below ``min_margin``; lang_pred then
    still names the smallest. A null text and one without any letter give ``und``,
    score 0, not accepted; so does every text when there is no dictionary. Equal sizes
    go to the language that comes first in ``dictionaries``. Only doc_id and text are read; a null id stays null, repeated rows
    give repeated results, whole texts count at any length.
    """
    shared = documents.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(shared.value)
        for batch in small_batches(batches, 1):
            found = [model.predict(t, min_margin) for t in byte_lists(batch.column(1))]
            languages, scores, margins, accepted = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(accepted, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "margin", "accepted"],
            )

    return arrow_pass(documents.select("doc_id", "text"), run, "doc_id BIGINT, lang_pred STRING, score DOUBLE, margin DOUBLE, accepted BOOLEAN")


def identify_with_folds(documents: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """Fit on the documents outside fold ``held`` of crc32(doc_id) mod ``modulus``, predict all."""
    fold = id_remainder("doc_id", modulus)
    dictionaries = fit_dictionaries(documents.filter(fold != held))
    return identify(documents, dictionaries).withColumn("held_out", fold == held)
