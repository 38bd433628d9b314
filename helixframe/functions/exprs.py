"""Scalar rules as Column expressions: everything here stays in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- labels and time ---------------------------------------------------------------------------


def day_value(label: Column | str) -> Column:
    """First unsigned number of a stage label; labels starting with P or p count from 19; null without a number."""
    x = c(label).cast("string")
    number = F.regexp_extract(x, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return number + F.when(F.upper(F.substring(x, 1, 1)) == "P", F.lit(19.0)).otherwise(F.lit(0.0))


def strict_day_value(label: Column | str) -> Column:
    """As ``day_value``; a label without a number is an error, a null stays null."""
    x = c(label).cast("string")
    return F.coalesce(day_value(x), F.when(x.isNotNull(), F.raise_error(F.concat(F.lit("no number in stage label "), x)).cast("double")))


def day_label(label: Column | str) -> Column:
    """``36.0`` becomes ``36``; other labels stay; NaN and blank are null."""
    x = F.regexp_replace(c(label).cast("string"), r"^([0-9]+)[.]0$", "$1")
    return F.when(F.lower(x) == "nan", None).otherwise(F.nullif(x, F.lit("")))


def relative(value: Column, low: Column, high: Column) -> Column:
    return (value - low) / F.nullif(high - low, F.lit(0.0))


# --- genome coordinates ------------------------------------------------------------------------


def chrom(name: Column | str) -> Column:
    x = c(name)
    return F.when(x.startswith("chr"), x).otherwise(F.concat(F.lit("chr"), x))


def chrom_aliases(name: Column | str) -> Column:
    """Names to try in turn: as given, with and without the prefix, and both names of the mitochondrion."""
    x = c(name)
    bare = F.regexp_replace(x, "^chr", "")
    mito = F.when(bare.isin("M", "MT"), F.array(F.lit("chrM"), F.lit("M"), F.lit("MT"), F.lit("chrMT"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(x, bare, F.concat(F.lit("chr"), bare)), mito))


def tss0(start: Column | str, end: Column | str, strand: Column | str) -> Column:
    """0-based transcription start of a 1-based inclusive gene."""
    return F.when(c(strand) == "+", c(start) - 1).otherwise(c(end) - 1).cast("long")


def midpoint(start: Column | str, end: Column | str) -> Column:
    return F.floor((c(start) + c(end)) / 2).cast("long")


def attributes(raw: Column | str) -> Column:
    """``key "value"; ...`` as a map; the last of equal keys wins, items without a space are ignored."""
    items = F.filter(F.transform(F.split(c(raw), ";"), lambda i: F.trim(i)), lambda i: F.instr(i, " ") > 0)
    pairs = F.transform(items, lambda i: F.struct(F.substring_index(i, " ", 1).alias("k"), F.trim(F.substr(i, F.instr(i, " ") + 1), F.lit('" ')).alias("v")))
    last = F.filter(pairs, lambda p, k: ~F.exists(F.slice(pairs, k + 2, F.greatest(F.size(pairs) - k - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def unversioned(gene_id: Column | str) -> Column:
    return F.substring_index(c(gene_id), ".", 1)


def first_filled(*columns: Column | str) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(c(x), F.lit("")) for x in columns])


def pad_or_trim(seq: Column | str, length: int) -> Column:
    """Centre crop, or N on both sides, to ``length``; upper case. Of an odd rest the smaller part is left."""
    x = F.upper(c(seq))
    n = F.char_length(x)
    crop = F.substr(x, F.floor((n - length) / 2).cast("int") + 1, F.lit(length))
    left = F.floor((length - n) / 2).cast("int")
    return F.when(n >= length, crop).otherwise(F.rpad(F.concat(F.repeat(F.lit("N"), F.greatest(left, F.lit(0))), x), length, "N"))


def window_start(centre: Column, width: int) -> Column:
    return F.greatest(F.lit(0), centre - width // 2).cast("long")


def one_hot(seq: Column | str) -> Column:
    """An array of four a base in the order ACGT; other letters are zero rows."""
    return F.transform(F.split(F.upper(c(seq)), ""), lambda b: F.array(*[F.when(b == x, 1.0).otherwise(0.0) for x in "ACGT"]))


# --- counts and vectors ------------------------------------------------------------------------


def log_normalised(value: Column | str, total: Column | str, target: float = 1e4) -> Column:
    """``log1p(value * target / total)``, 0 where the total is not positive; zeros stay zeros."""
    return F.when(c(total) > 0, F.log1p(c(value) * F.lit(target) / c(total))).otherwise(F.lit(0.0))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(x: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(x, x)), F.lit(1e-12))
    return F.transform(x, lambda v: v.cast("double") / norm)


def cosine(x: Column, y: Column) -> Column:
    """The cosine of two arrays; a length of zero counts as 1e-12."""
    size = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return dot(x, y) / (size(x) * size(y))


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def between(x0: Column, x1: Column, tau: Column) -> Column:
    return F.zip_with(x0, x1, lambda a, b: (1 - tau) * a.cast("double") + tau * b.cast("double"))


def velocity(x0: Column, x1: Column, dt: Column) -> Column:
    return F.zip_with(x0, x1, lambda a, b: (b.cast("double") - a.cast("double")) / dt)


def position_bin(distance: Column | str) -> Column:
    """Learned-position bin of a signed distance: hundreds, rounded half to even, centred on 1024, 0 to 2048."""
    return F.least(F.greatest(F.rint(c(distance) / 100) + 1024, F.lit(0.0)), F.lit(2048.0)).cast("int")


def rope(x: Column, position: Column, base: float = 10_000.0) -> Column:
    """Rotary embedding by halves; an odd last component is kept."""
    n = F.size(x)
    half = F.floor(n / 2).cast("int")

    def turned(_: Column, k: Column) -> Column:
        j = F.when(k < half, k).otherwise(k - half)
        angle = position.cast("double") * F.pow(F.lit(base), -j.cast("double") / F.greatest(half - 1, F.lit(1))) / 1000.0
        a, b = F.get(x, j).cast("double"), F.get(x, j + half).cast("double")
        return F.when(k >= 2 * half, F.get(x, k).cast("double")).when(k < half, a * F.cos(angle) - b * F.sin(angle)).otherwise(a * F.sin(angle) + b * F.cos(angle))

    return F.transform(x, turned)


# --- names -------------------------------------------------------------------------------------


def safe_name(x: Column | str) -> Column:
    return F.substring(F.trim(F.regexp_replace(c(x), "[^A-Za-z0-9]+", "_"), F.lit("_")), 1, 80)


def artifact_name(variant: Column | str, state: Column | str, label: Column | str) -> Column:
    return F.concat_ws("_", c(variant), F.nullif(c(state), F.lit("expression")), F.nullif(c(label), F.lit("")))


def filled(x: Column | str) -> Column:
    """NA for null and blank."""
    return F.coalesce(F.nullif(c(x).cast("string"), F.lit("")), F.lit("NA"))


# --- reproducible draws ------------------------------------------------------------------------


def uniform(*key: Column | str) -> Column:
    """A draw from [0, 1) that depends on its key alone: never on partitions or order."""
    text = F.concat_ws(":", *[c(k).cast("string") if isinstance(k, (str, Column)) else F.lit(str(k)) for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def seconds(ts: Column | str) -> Column:
    """Whole seconds of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), c(ts)).cast("long")
