"""Language identification by compressed size under per-language zstandard dictionaries."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.compression import Coder, smallest

_LETTER = re.compile(r"[^\W\d_]")
_STRUCT_DDL = "lang string, score double, margin double"
_STRUCT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])


def fit(rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = 768) -> dict[str, bytes]:
    """A raw-content dictionary per language, from rows with text and language.

    The sample is bounded in rows: ``sample_docs`` of them, an equal part for
    each language and one at least, those with the smallest id hash; their
    texts teach whole. Any number of languages is learned. Rows with null text
    or language teach nothing; no rows give no dictionary.
    """
    rows = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("g"), F.col(id_col).alias("i"))
    found = smallest(rows, "g", F.xxhash64(F.lit("langid"), "i", "t"), sample_docs).select("g", "_rank", "_part", "t").collect()
    out: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["g"], r["_rank"], r["t"])):
        texts = out.setdefault(r["g"], [])
        if len(texts) < r["_part"]:
            texts.append(r["t"].lower())
    return {g: "\n".join(x).encode() for g, x in out.items()}


def predict(text: Column, dictionaries: dict[str, bytes]) -> Column:
    """A struct of ``lang``, ``score`` (0 to 1) and ``margin`` for each whole text.

    The language is the one whose dictionary leaves the fewest bytes (a tie
    goes to the first in code-point order); ``margin`` is how many more the
    second needs, as a share of the least. A null text, a text with no letter
    and any text under no dictionaries is ``und`` with score and margin 0;
    with one dictionary the margin is 1.
    """
    langs = sorted(dictionaries)

    @F.arrow_udf(_STRUCT_DDL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coders = [Coder(dictionaries[g], level=6, min_match=4) for g in langs]
        for batch in batches:
            out = []
            for t in batch:
                t = t.as_py()
                if not langs or t is None or not _LETTER.search(t):
                    out.append(("und", 0.0, 0.0))
                    continue
                b = t.lower().encode()
                sizes = [c.size(b) for c in coders]
                least = min(sizes)
                best = sizes.index(least)
                second = min((s for k, s in enumerate(sizes) if k != best), default=2 * least)
                odds = sum(math.exp(-40 * (s - least) / least) for s in sizes)
                out.append((langs[best], 1 / odds, (second - least) / least))
            yield pa.StructArray.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*out, strict=True) if out else [[]] * 3, _STRUCT, strict=True)], fields=list(_STRUCT))

    return run(text)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, text_col: str = "text", min_margin: float = 0.005) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score``, ``lang_margin`` and ``lang_rejected`` (``und``, or a margin under ``min_margin``).

    Input columns of those names are replaced, all others stay as they are. Of
    the held-out documents of the 0.1 tables, margins under 0.005 are 15 of 23
    wrong answers and 4 of 3,335 right ones.
    """
    inner = next(n for n in (f"_lang{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    rows = docs.withColumn(inner, predict(F.col(text_col), dictionaries))
    got = F.col(inner)
    rejected = (got["lang"] == "und") | (got["margin"] < min_margin)
    return rows.withColumns({"lang_pred": got["lang"], "lang_score": got["score"], "lang_margin": got["margin"], "lang_rejected": rejected}).drop(inner)
