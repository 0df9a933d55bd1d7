"""Language identification by compression.

Each learned language has a raw-content zstandard dictionary: whole texts of a
bounded sample of its rows, one after the other. A text, lower-cased and with each run
of anything but letters as one space, is compressed whole with every dictionary; the
smallest result names the language. The texts of a batch go through one dictionary
after the other, so that its tables stay in the processor's cache. The score is the margin to the second,
as a share of the second; a text whose margin is under ``MARGIN`` is rejected.

Defined results: null texts and texts without a letter are ``und`` with score 0
and rejected; equal sizes go to the first language by name, with score 0; with
one language the score is 1, with none (and so for an empty table to learn from) all is
``und``; an empty table gives no rows; rows are kept one by one,
repeated or not; of rows to learn from that share an id and a language the least text
is taken; very long texts are compressed whole; other columns, whatever their names,
are never read, but ``predict`` replaces those it adds. Letters are those of Unicode
(categories L), with their marks (M).
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import crc_mod, kept_in_worker, small_batches, widened

#: Rows sampled for each language; bytes of text that fill its dictionary, and that all languages share.
SAMPLE, DICTIONARY, TOGETHER = 300, 100_000, 40_000_000
#: Languages whose counts are broadcast; beyond, rows meet them by a shuffle.
NAMES = 100_000
#: Least margin of a text that is not rejected. At this share a short text must differ by
#: several bytes too. Fitted on rows not held out: see the README.
MARGIN = 0.05
UNKNOWN = "und"
#: Effort of the compressor.
LEVEL = 12
_OTHER, _OTHER_ASCII, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), re.compile(r"[^a-z]+"), regex.compile(r"\p{L}")


def letters(text: str) -> str:
    """The words of a text, lower-cased, one space between them; empty without a letter."""
    if text.isascii():
        return _OTHER_ASCII.sub(" ", text.lower()).strip()
    return _OTHER.sub(" ", text.lower()).strip() if _LETTER.search(text) else ""


def _sampled(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """About ``most`` rows of each language by a hash of their id, and the number of languages. No other text moves."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n_languages = counts.count()
    grain = 1_000_000_007
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(grain))
    bound = F.least(F.lit(grain).cast("double"), F.lit(float(grain) * most) / F.col("n"))
    few = F.broadcast(counts) if n_languages <= NAMES else counts
    near = rows.withColumn("place", place).join(few, "lang").where(F.col("place") < bound)
    return near.groupBy("lang", "doc_id", "place").agg(F.min("text").alias("text")), n_languages


def train(docs: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> dict[str, bytes]:
    """Dictionaries by language, from rows with ``doc_id, text, lang``.

    Of each language's sample whole texts are taken while they fit, those of up to a fiftieth of the dictionary first; at
    least one, whatever its length. With very many languages each gets its part of ``TOGETHER``.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.length("text") > 0)
    near, n = _sampled(rows, sample)
    size = min(size, TOGETHER // max(1, n))
    order = Window.partitionBy("lang").orderBy(F.octet_length("text") > size // 50, "place", F.col("doc_id").cast("string"))  # of a sample
    near = near.withColumns({"nth": F.row_number().over(order), "upto": F.sum(F.octet_length("text")).over(order)})
    got: dict[str, list[str]] = {}
    for r in near.where((F.col("nth") == 1) | (F.col("upto") <= size)).select("lang", "nth", "text").orderBy("lang", "nth").collect():
        got.setdefault(r["lang"], []).append(letters(r["text"]))
    return {lang: "\n".join(texts).encode("utf-8", "surrogatepass") for lang, texts in sorted(got.items())}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard as z

        self.names = list(dictionaries)
        self.by_name = []
        for raw in dictionaries.values():
            held = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.by_name.append(z.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def classify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        raw = [letters(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes = [[len(c.compress(r)) if r else 0 for r in raw] for c in self.by_name]
        out = []
        for k, r in enumerate(raw):
            own = [s[k] for s in sizes]
            if not r or not own:
                out.append((UNKNOWN, 0.0))
                continue
            best = min(range(len(own)), key=own.__getitem__)
            rest = min((s for j, s in enumerate(own) if j != best), default=None)
            out.append((self.names[best], 1.0 if rest is None else (rest - own[best]) / rest))
        return out


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """Add ``lang_pred, score, rejected`` to the rows of ``docs``, which has ``text``."""
    small_batches(docs.sparkSession)
    added = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    docs = docs.drop(*added)
    schema = widened(docs, **added)
    token = f"languages {hash(tuple(dictionaries.items()))}"

    def run(batches):
        held = kept_in_worker(token)
        if not held:
            held["compressors"] = Compressors(dictionaries)
        classify = held["compressors"].classify
        for b in batches:
            got = classify(b.column(b.schema.get_field_index("text")).to_pylist())
            more = [pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64()), pa.array([x == UNKNOWN or s < margin for x, s in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *added])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected``: learned from rows that are not held out."""
    rows = docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)))
    model = train(rows.where(~F.col("held_out") & F.col("lang").isNotNull()))
    found = predict(rows.select("doc_id", "held_out", F.col("text").cast("string").alias("text")), model)
    return found.drop("text")
