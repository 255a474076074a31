"""Language identification by compression: the language whose dictionary makes a text smallest.

Texts are reduced to small letters and single spaces. For each language a raw-content zstandard dictionary is filled with excerpts of labelled training documents, a bounded
sample: at most `documents` of them with `excerpt` characters each, chosen by a hash of the id. Each whole text is
compressed once with each dictionary, in blocks of `block` bytes with the dictionary anew, so that the lead doesn't depend
on the length; a language's size is the sum over the blocks. A text is rejected if it has no letter, or if the best
language leads by less than `margin` of the second best size; texts under `least` bytes can't lead by much and aren't
rejected for that: a tie among them has score 0.

Nulls and ties: a null text and one without letters are `und` with score 0, rejected. Equal sizes fall to the language
that comes first by name. Rows without lang or id teach nothing but are predicted. Repeated rows each get a row. Other
columns aren't read. An empty table gives an empty result; with nothing to learn from, all texts are `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def letters(text_col: str):
    """What is compressed: small letters, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(F.col(text_col).cast("string")), "[^\\p{L}]+", " "))


def learn(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = 400, excerpt: int = 500) -> dict[str, bytes]:
    """A dictionary's content for each language; at most documents * excerpt characters each."""
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)).alias("draw"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for lang, n in counts.items():  # about twice the wanted number passes
        keep = keep | ((F.col("lang") == lang) & (F.col("draw") < (1_000_000 if n <= 2 * documents else 2_000_000 * documents // n + 1)))
    # the middle of each text, so that common first lines don't fill the dictionary
    drawn = rows.where(keep).select("lang", "draw", letters("text").alias("text"))
    middle = F.substring("text", F.greatest(F.lit(1), ((F.length("text") - excerpt) / 2).cast("int")), F.lit(excerpt))
    content: dict[str, list[str]] = {}
    for r in drawn.select("lang", "draw", middle.alias("text")).orderBy("lang", "draw", "text").toLocalIterator():
        own = content.setdefault(r.lang, [])
        if len(own) < documents and r.text and r.text not in own[-3:]:
            own.append(r.text)
    return {lang: " ".join(x).encode() for lang, x in sorted(content.items())}


def identify(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = 0.001, least: int = 100, block: int = 16 << 10, level: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Columns to keep (all if None) and lang_pred, score (0 to 1: the lead over the second best), rejected."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        packers = []
        for lang, content in dictionaries.items():
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            packers.append((lang, zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False)))
        for b in rows:
            lang, score = [], []
            for t in b.column(0):
                if not t.is_valid or not t.as_buffer().size or not packers:
                    lang.append("und")
                    score.append(0.0)
                    continue
                text = memoryview(t.as_buffer())
                parts = [text[i : i + block] for i in range(0, len(text), block)]
                sizes = sorted((sum(len(p.compress(x)) for x in parts), name) for name, p in packers)
                lang.append(sizes[0][1])
                score.append(1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0)
            sizes = [t.as_buffer().size if t.is_valid else 0 for t in b.column(0)]
            rejected = [k == "und" or s < margin and n >= least for k, s, n in zip(lang, score, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names)

    new = ["lang_pred", "score", "rejected"]
    columns = [c for c in (df.columns if keep is None else keep) if c not in new]
    names, kinds = [*columns, *new], dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "lang_pred string", "score double", "rejected boolean"])
    return df.select(letters(text_col).alias("_letters"), *[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def trains(id_col: str = "doc_id", parts: int = 4, held: int = 2):
    """Whether a row teaches: crc32 of the id as text, modulo parts, isn't `held`; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts != held, F.lit(False))
