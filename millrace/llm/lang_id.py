"""Language identification by compression: the language whose dictionary shortens a text most.

Each language has a raw-content zstandard dictionary made of learned texts, in lower case as all
texts are here. A text is cut into blocks; every block is compressed with every dictionary, and the language with the fewest bytes
wins. Cutting keeps the dictionary in reach of the compressor over all of a long text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held_out, small_batches

#: Bytes of learned text in a language's dictionary, and the most that one document gives to it: the fit is on a
#: bounded sample of labelled rows, whatever the size of the corpus.
DICTIONARY_BYTES, FROM_ONE = 96_000, 2_000
#: Documents drawn for each language before the dictionary is filled, at most.
DRAWN = 96
#: Languages that a table may have; dictionaries of all are broadcast.
MAX_LANGUAGES = 400
BLOCK, LEVEL = 4_096, 6
#: A decision is rejected if the second best language needs less than this share more bytes.
NARROW = 0.005
UNKNOWN = "und"


def learn_dictionaries(df: DataFrame, key: str, text: str, lang: str) -> dict[str, bytes]:
    """A dictionary for each non-null language, from rows that are not held out. Languages of no text get none.

    Rows are dealt to DRAWN buckets of their language by a hash of id and text; a bucket gives the row of least hash, so
    that null and repeated ids, and any number of equal rows, change neither the bound nor which languages are found.
    """
    draw = F.xxhash64(F.col(key), F.col(text), F.lit(7))
    seen = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key)) & (F.length(text) > 0)).select(F.col(lang).alias("lang"), draw.alias("draw"), F.col(text).alias("text"))
    least = seen.groupBy("lang", F.pmod("draw", F.lit(DRAWN)).alias("bucket")).agg(F.min("draw").alias("draw")).select("lang", "draw").limit(MAX_LANGUAGES * DRAWN + 1).collect()
    if len({r["lang"] for r in least}) > MAX_LANGUAGES or len(least) > MAX_LANGUAGES * DRAWN:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not least:
        return {}
    drawn = F.broadcast(df.sparkSession.createDataFrame(least, "lang string, draw long"))
    rows = seen.join(drawn, ["lang", "draw"]).select("lang", "draw", F.encode(F.lower(F.substring("text", 1, FROM_ONE)), "utf-8").alias("text")).distinct().collect()
    parts: dict[str, bytearray] = defaultdict(bytearray)
    for r in sorted(rows, key=lambda r: (r["draw"], r["text"])):
        own = parts[r["lang"]]
        own += bytes(r["text"][: max(0, DICTIONARY_BYTES - len(own))])
    return {k: bytes(v) for k, v in sorted(parts.items())}


def identify(df: DataFrame, key: str, text: str, dictionaries: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """(key, held_out, lang_pred, score, rejected) for each input row, over whole texts.

    A null text, a text without a letter, or one seen without any learned language: `und` with
    score 0, rejected. Of languages with equal sizes the first by name wins. score is 0 to 1: the
    logistic of the second best language's excess over the best, 0.5 for a tie. rejected marks
    decisions whose margin is narrow; lang_pred still names the best language there.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        import regex
        import zstandard

        letter = regex.compile(r"\p{L}").search
        parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        coders = []
        for name, raw in dictionaries.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append((name, zstandard.ZstdCompressor(dict_data=d, compression_params=parameters)))
        for b in batches:
            names, scores, narrow_ones = [], [], []
            for t in b.column(1).to_pylist():
                if not t or not coders or not letter(t):
                    names.append(UNKNOWN), scores.append(0.0), narrow_ones.append(True)
                    continue
                raw = t.lower().encode()
                blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
                sizes = sorted((sum(len(c.compress(x)) for x in blocks), name) for name, c in coders)
                margin = (sizes[1][0] - sizes[0][0]) / sizes[0][0] if len(sizes) > 1 else 1.0
                names.append(sizes[0][1]), scores.append(1 / (1 + math.exp(-min(50.0, 20 * margin)))), narrow_ones.append(margin < narrow)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(narrow_ones, pa.bool_())], names=[key, "held_out", "lang_pred", "score", "rejected"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text), held_out(F.col(key)).alias("_h")).mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
