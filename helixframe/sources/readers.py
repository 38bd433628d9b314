"""Readers with named schemas: gene annotation, intervals, sequences, sparse matrices, tables with aliases."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, fields
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import exprs as X

GTF = "seqname string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"


def gtf(spark: SparkSession, path: str, *, gene_type: str | None = "protein_coding", genes: DataFrame | None = None) -> DataFrame:
    """``(gene_id, gene_name, gene_type, chrom, strand, tss0)`` of gene rows; of a gene's rows the first in the file counts (files by name)."""
    at = F.struct(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    rows = spark.read.csv(path, sep="\t", comment="#", schema=GTF, quote="").withColumn("_at", at).where("feature = 'gene'").withColumn("_a", X.attributes("attributes"))
    get = lambda k: F.try_element_at("_a", F.lit(k))
    x = rows.select(
        X.unversioned(get("gene_id")).alias("gene_id"), X.first_filled(get("gene_name"), get("gene_id")).alias("gene_name"), X.first_filled(get("gene_type"), get("gene_biotype")).alias("gene_type"),
        X.chrom("seqname").alias("chrom"), "strand", X.tss0("start", "end", "strand").alias("tss0"), "_at",
    ).where("gene_id is not null")
    if gene_type is not None:
        x = x.where(F.col("gene_type") == gene_type)
    if genes is not None:
        x = x.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    kept = [c for c in x.columns if c not in ("gene_id", "_at")]
    first = x.groupBy("gene_id").agg(F.min_by(F.struct(*kept), "_at").alias("_row"))
    return first.select("gene_id", "_row.*")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """``(chrom, start, end, ccre_id, element_id, state, midpoint, is_synthetic)`` of lines with three to six fields."""
    p = F.split("value", "\t")
    at = lambda k: X.first_filled(F.try_element_at(p, F.lit(k)))
    x = spark.read.text(path).where("value <> '' and not startswith(value, '#') and not startswith(value, 'track')")
    x = x.select(X.chrom(at(1)).alias("chrom"), at(2).cast("long").alias("start"), at(3).cast("long").alias("end"), at(4).alias("ccre_id"), at(5).alias("element_id"), F.coalesce(at(6), F.lit("unknown")).alias("state"))
    place = F.concat_ws(":", "chrom", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    x = x.where("start is not null and end > start").withColumn("ccre_id", F.coalesce("ccre_id", place)).withColumn("element_id", F.coalesce("element_id", "ccre_id"))
    return x.withColumn("midpoint", X.midpoint("start", "end")).withColumn("is_synthetic", F.lit(False))


def merged_intervals(tables: list[DataFrame]) -> DataFrame:
    """Union of interval tables: prefix first, then one row a place; bad rows (null, empty, reversed) go."""
    out = None
    for t in tables:
        x = t.select(X.chrom("chrom").alias("chrom"), F.col("start").try_cast("long").alias("start"), F.col("end").try_cast("long").alias("end"), "ccre_id", "state")
        out = x if out is None else out.unionByName(x)
    return out.dropna(subset=["chrom", "start", "end"]).where("end > start").groupBy("chrom", "start", "end").agg(F.min("ccre_id").alias("ccre_id"), F.min("state").alias("state"))


def _fasta_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines ``(f, b, value)`` in file order: the record of the split ``b`` that each belongs to, 0 before its first header, and the bases before it there."""
    key, seg, name, off = None, 0, None, 0
    for batch in batches:
        if not len(batch):
            continue
        f, b = batch.column(0), batch.column(1)
        at = pc.binary_join_element_wise(f, pc.cast(b, pa.string()), " ").to_pylist()
        edges = [0, *(k for k in range(1, len(at)) if at[k] != at[k - 1]), len(at)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if at[lo] != key:
                key, seg, name, off = at[lo], 0, None, 0
            value = batch.column(2).slice(lo, hi - lo)
            head = pc.starts_with(value, ">").to_numpy(zero_copy_only=False)
            seq = pc.utf8_upper(pc.replace_substring_regex(pc.if_else(pa.array(head), "", value), r"\s+", ""))
            size = pc.utf8_length(seq).to_numpy().astype(np.int64)
            before = np.cumsum(size) - size
            place = np.maximum.accumulate(np.where(head, np.arange(hi - lo), -1))
            start = before - np.where(place >= 0, before[place], -off)
            names = [name, *pc.list_element(pc.split_pattern_regex(pc.utf8_slice_codeunits(value.filter(pa.array(head)), 1), r"\s+"), 0).to_pylist()]
            nth = np.cumsum(head)
            yield pa.RecordBatch.from_arrays([f.slice(lo, hi - lo), b.slice(lo, hi - lo), pa.array(seg + nth, pa.int32()), pa.array(names, pa.string()).take(pa.array(nth)), pa.array(start), seq], names=["f", "b", "seg", "name", "at", "seq"])
            off = int(start[-1] + size[-1])
            seg, name = seg + int(nth[-1]), names[-1]


def fasta(spark: SparkSession, path: str, width: int = 1 << 16) -> DataFrame:
    """``(chrom, start, seq)`` pieces of up to ``width`` bases, ready for range access.

    Spark splits the files between lines. A line's record and place are those in
    its split, and what the splits before leave open, of which there is one row
    each; pieces are put together from lines, so no task holds a record. Names
    end at white space and are unique in a file. Lines before the first header
    are left out, records without a base too.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), "value")
    x = lines.mapInArrow(_fasta_lines, "f string, b long, seg int, name string, at long, seq string")
    size = F.char_length("seq")
    parts = x.groupBy("f", "b", "seg").agg(F.max("name").alias("name"), F.sum(size).alias("n"))
    ends = parts.groupBy("f", "b").agg(F.max_by("name", "seg").alias("last"), F.max_by("n", "seg").alias("open"), (F.max("seg") > 0).alias("heads"))
    by = Window.partitionBy("f").orderBy("b")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_sum", F.coalesce(F.sum("open").over(earlier), F.lit(0)))
    # Since the last split that has a header: its open end and all of those after it.
    ends = ends.select("f", "b", F.last("last", ignorenulls=True).over(earlier).alias("_name"), (F.col("_sum") - F.coalesce(F.last(F.when(F.col("heads"), F.col("_sum")), ignorenulls=True).over(earlier), F.lit(0))).alias("_off"))
    x = x.where(size > 0).join(ends, ["f", "b"])
    x = x.select("f", F.coalesce("name", "_name").alias("chrom"), F.when(F.col("seg") == 0, F.col("at") + F.col("_off")).otherwise(F.col("at")).alias("at"), "seq").where("chrom is not null")
    k = F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + size - 1) / width)))
    x = x.select("f", "chrom", "at", "seq", k.alias("_k"))
    a = F.greatest(F.col("at"), F.col("_k") * width)
    part = F.substr("seq", (a - F.col("at") + 1).cast("int"), (F.least(F.col("at") + size, (F.col("_k") + 1) * width) - a).cast("int"))
    x = x.select("f", "chrom", "_k", F.struct(a.alias("a"), part.alias("s")).alias("p")).groupBy("f", "chrom", "_k").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["s"]), "").alias("seq"))
    return x.select("chrom", (F.col("_k") * width).cast("long").alias("start"), "seq")


def fetch(sequences: DataFrame, regions: DataFrame, length: int, width: int = 1 << 16) -> DataFrame:
    """``(region_id, seq)``: ``length`` bases around ``regions(region_id, chrom, midpoint)``, clipped at the start, then padded to the length."""
    r = regions.withColumn("_from", X.window_start(F.col("midpoint"), length)).withColumn("_to", F.col("midpoint") - length // 2 + length)
    pieces = F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.greatest(F.col("_to") - 1, F.col("_from")) / width)))
    r = r.withColumn("_piece", pieces)
    s = sequences.withColumn("_piece", F.floor(F.col("start") / width)).select("chrom", "_piece", F.col("start").alias("_at"), "seq")
    x = r.join(s, ["chrom", "_piece"])
    a, b = F.greatest(F.col("_from"), F.col("_at")), F.least(F.col("_to"), F.col("_at") + F.char_length("seq"))
    x = x.withColumn("_part", F.substr("seq", (a - F.col("_at")).cast("int") + 1, F.greatest(b - a, F.lit(0)).cast("int")))
    x = x.groupBy("region_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_part"))), lambda p: p["_part"]), "").alias("_s"))
    return x.select("region_id", X.pad_or_trim("_s", length).alias("seq"))


def matrix_market(spark: SparkSession, path: str, cells: int | None = None) -> DataFrame:
    """``(cell, gene, value)`` from 0, of 1-based triplets; if the first dimension is not ``cells`` the matrix is turned.

    ``path`` is a file, or a folder of parts of one in which one part holds the
    header. The size line is the first that is no comment in the file of the
    header. Triplets may read like it: of lines equal to it, one is left out,
    whichever it is. What the header says is heeded: ``pattern`` entries are 1,
    ``symmetric`` and ``skew-symmetric`` ones stand for their mirror image too;
    dense and complex matrices are errors.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    kind = text.where("startswith(value, '%%MatrixMarket')").select("value", "f").first()
    plain = F.regexp_replace(F.trim("value"), r"\s+", " ")
    lines = text.where("not startswith(value, '%') and trim(value) <> ''").select(plain.alias("line"), "f", "at")
    words = kind["value"].lower().split() if kind else ["", "matrix", "coordinate", "real", "general"]
    if words[2] != "coordinate" or words[3] == "complex" or words[4] == "hermitian":
        raise ValueError(f"a matrix of {' '.join(words[2:])} is not read")
    head = (lines.where(F.col("f") == kind["f"]).agg(F.min_by("line", "at").alias("line")) if kind else lines).first()["line"]
    size = [int(v) for v in head.split()]
    if cells is not None and size[0] != cells and size[1] != cells:
        raise ValueError(f"neither dimension of {size[:2]} is {cells}")
    again = lines.where(F.col("line") == head).groupBy("line").agg((F.count("*") - 1).alias("n")).where("n > 0")
    again = again.select("line", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("line")
    p = F.split("line", " ")
    value = F.lit(1.0) if words[3] == "pattern" else F.get(p, 2).cast("double")
    x = lines.where(F.col("line") != head).select("line").union(again).select((p[0].cast("long") - 1).alias("a"), (p[1].cast("long") - 1).alias("b"), value.alias("value"))
    if words[4] != "general":
        sign = -1 if words[4] == "skew-symmetric" else 1
        x = x.union(x.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), (sign * F.col("value")).alias("value")))
    turned = cells is not None and size[0] != cells
    return x.select(F.col("b" if turned else "a").alias("cell"), F.col("a" if turned else "b").alias("gene"), "value")


def aliased(rows: DataFrame, wanted: dict[str, list[str]], defaults: dict[str, object] | None = None) -> DataFrame:
    """The wanted columns under their names: the first alias there is (case, blanks and underscores do not matter), a default, or an error."""
    plain = lambda s: s.lower().replace("_", "").replace(" ", "")
    have = {plain(x): x for x in reversed(rows.columns)}
    out = []
    for name, aliases in wanted.items():
        found = next((have[plain(a)] for a in [name, *aliases] if plain(a) in have), None)
        if found is not None:
            out.append(F.col(f"`{found}`").alias(name))
        elif defaults is not None and name in defaults:
            out.append(F.lit(defaults[name]).alias(name))
        else:
            raise KeyError(f"no column for {name} among {rows.columns}")
    return rows.select(*out)


GENE_ALIASES = {"gene_id": ["id"], "gene_short_name": ["gene_name", "symbol", "name"], "gene_type": ["biotype"], "chr": ["chrom", "chromosome"]}
CELL_ALIASES = {"cell_id": ["cell", "barcode"], "timepoint": ["day", "stage"]}


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with header; ``.gz`` is read as such. Without a schema all columns are strings: types come by name, not by guess."""
    return spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True)


def with_provenance(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """Union of the CSV files a pattern names, with ``source_file``."""
    return table(spark, pattern, schema).withColumn("source_file", F.col("_metadata.file_path"))


def inventory(spark: SparkSession, pattern: str, required: list[str] | None = None) -> DataFrame:
    """``(path, bytes)`` of files, without reading them; an error if a required file name is not among them."""
    found = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"))
    if required:
        wanted = spark.createDataFrame([(r,) for r in required], "name string")
        gone = [r["name"] for r in wanted.join(found.select(F.element_at(F.split("path", "/"), -1).alias("name")), "name", "left_anti").orderBy("name").collect()]
        if gone:
            raise FileNotFoundError(f"no file named {gone} among {pattern}")
    return found


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value)`` of a JSON object of numbers, such as a symbol's token; pickled dictionaries are not read."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, long>")).alias("key", "value"))


def weights(spark: SparkSession, path: str, expected: dict[str, tuple[int, ...]] | None = None) -> dict[str, np.ndarray]:
    """Arrays that ``writers.weights`` wrote; with ``expected`` names and shapes, any other set of them is an error."""
    rows = spark.read.parquet(path).collect()  # the arrays of one model, which the driver holds anyway
    got = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in rows}
    if expected is not None and {k: v.shape for k, v in got.items()} != expected:
        raise ValueError(f"{ {k: v.shape for k, v in got.items()} } is not {expected}")
    return got


def document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


@dataclass(frozen=True)
class Config:
    """Driver-side settings with the defaults of the workflow."""

    window: int = 100_000
    promoter_window: int = 1_000
    synthetic_width: int = 512
    tokens_per_gene: int = 32
    ot_epsilon: float = 0.05
    ot_iterations: int = 80
    held_out: tuple[str, ...] = ("E9.5", "E10.5")
    time_coordinate: str = "physical"
    time_scale: float = 1.0
    seed: int = 0

    @classmethod
    def load(cls, path: str, overrides: dict | None = None) -> Config:
        """From JSON or YAML (if its package is there), then overrides; unknown keys are errors."""
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            import yaml

            got = yaml.safe_load(text) or {}
        else:
            got = json.loads(text)
        return cls.of(got | (overrides or {}))

    @classmethod
    def of(cls, got: dict) -> Config:
        names = {f.name for f in fields(cls)}
        if extra := set(got) - names:
            raise KeyError(f"unknown settings {sorted(extra)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()})

    @classmethod
    def from_env(cls, env: dict[str, str], prefix: str = "HELIXFRAME_") -> Config:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        got = {k: v for f in kinds if (v := env.get(prefix + f.upper())) is not None for k in [f]}
        return cls.of({k: (tuple(v.split(",")) if kinds[k] is tuple else kinds[k](v)) for k, v in got.items()})


def row_chunks(spark: SparkSession, pattern: str, chunk: int = 1000, columns: list[int] | None = None) -> DataFrame:
    """``(source_file, row, global_row, chunk, values)`` of row-ordered text matrices, one line a row, values parted by commas.

    Rows are numbered by file, and over all files by name; ``chunk`` numbers
    ranges of ``chunk`` rows of a file; ``columns`` gathers some values, in that
    order. Spark splits the files: a line's number is its place in its split and
    the lines of the splits before, of which there is one row each. No file is
    opened by the driver, and none is read more than once to be counted and once
    for its rows.
    """
    lines = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), "value")
    splits = lines.groupBy("source_file", "b").agg(F.min("m").alias("m0"), F.count("*").alias("n"))
    before = Window.partitionBy("source_file").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("source_file", "b").rowsBetween(Window.unboundedPreceding, -1)  # over one row a split
    splits = splits.select("source_file", "b", "m0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("k"), F.coalesce(F.sum("n").over(every), F.lit(0)).alias("g"))
    x = lines.join(splits, ["source_file", "b"]).withColumn("_i", F.col("m") - F.col("m0"))
    values = F.transform(F.split("value", ","), lambda v: v.cast("double"))
    if columns is not None:
        values = F.transform(F.array(*[F.lit(c) for c in columns]), lambda c: F.get(F.split("value", ","), c).cast("double"))
    row = F.col("k") + F.col("_i")
    return x.select("source_file", row.alias("row"), (F.col("g") + F.col("_i")).alias("global_row"), F.floor(row / chunk).alias("chunk"), values.alias("values"))


def arrays(spark: SparkSession, pattern: str) -> DataFrame:
    """``(source_file, name, row, values)`` of two-dimensional arrays in ``.npy`` and ``.npz`` files; pickled content is refused.

    A file is read whole by one task: keep such files small, or convert them to Parquet once.
    """

    def read(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                for name, x in got.items() if hasattr(got, "items") else [("", got)]:
                    x = np.asarray(x, np.float64)
                    x = x.reshape(len(x), -1) if x.ndim else x.reshape(1, 1)
                    for a in range(0, len(x), 1024):
                        part = x[a : a + 1024]
                        n = len(part)
                        yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([name] * n), pa.array(range(a, a + n), pa.int64()), pa.array(part.tolist(), pa.list_(pa.float64()))], names=["source_file", "name", "row", "values"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(read, "source_file string, name string, row long, values array<double>")


# The name spaces of the format.
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    """The column of a cell's name, from 0: letters are digits of base 26."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _strings(x) -> str:
    """The text of an element without what is said how to read it."""
    return "".join(t.text or "" for r in x if not r.tag.endswith("rPh") for t in r.iter(f"{SHEET}t"))


def _sheets(content: bytes) -> Iterator[tuple[str, int, list]]:
    """``(sheet, row, cells)`` of the stored rows of a zipped workbook, read as a stream of elements."""
    import io
    import posixpath
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        names = [(e.get("name"), links[e.get(LINK)]) for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet")]
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == f"{SHEET}si":
                        shared.append(_strings(e))
                        e.clear()
        for name, target in names:
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            with z.open(path) as f:
                n = -1
                for _, e in ElementTree.iterparse(f):
                    if e.tag != f"{SHEET}row":
                        continue
                    n = int(e.get("r", n + 2)) - 1
                    cells: list = []
                    for c in e.iter(f"{SHEET}c"):
                        at = _column(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        kind, v = c.get("t", "n"), c.find(f"{SHEET}v")
                        text = _strings(c) if kind == "inlineStr" else v.text if v is not None else None
                        if text is not None and kind == "s":
                            text = shared[int(text)]
                        elif text is not None and kind == "b":
                            text = "TRUE" if text == "1" else "FALSE"
                        cells[at] = text
                    yield name, n, cells
                    e.clear()


def workbook(spark: SparkSession, pattern: str) -> DataFrame:
    """``(source_file, sheet, row, cells)`` of all sheets of ``.xlsx`` files, rows from 0; a file that is no such workbook gives no rows.

    Cells are texts as they are stored: numbers (dates too) as their digits,
    formulas as their last value; an empty cell is null, cells after a row's
    last are not there. The format holds a million rows a sheet at most; a file
    is one task, its sheets are read as streams.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile
        from xml.etree import ElementTree

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                # Whole or not at all: what is unreadable in its middle gives no rows.
                try:
                    for _ in _sheets(content.as_py()):
                        pass
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError):
                    continue
                rows: list = []
                for row in _sheets(content.as_py()):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield made(path, rows)
                        rows = []
                if rows:
                    yield made(path, rows)

    def made(path: str, rows: list) -> pa.RecordBatch:
        sheet, row, cells = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(sheet, pa.string()), pa.array(row, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=["source_file", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(read, "source_file string, sheet string, row long, cells array<string>")


def interval_sheets(spark: SparkSession, pattern: str, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns of all sheets of workbooks by the names in their first row, under their wanted names: ``(source_file, sheet, row, ...)``.

    ``wanted`` gives for each name its aliases, as in :func:`aliased`. A sheet
    without one of them is left out; blank cells are null.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[_ ]", "")
    x = workbook(spark, pattern)
    first = x.groupBy("source_file", "sheet").agg(F.min("row").alias("_top"), F.min_by("cells", "row").alias("_head"))
    names = F.transform("_head", lambda c: plain(F.coalesce(c, F.lit(""))))
    place = {n: F.coalesce(*[F.nullif(F.array_position(names, a.lower().replace("_", "").replace(" ", "")), F.lit(0).cast("long")) for a in [n, *aliases]]) for n, aliases in wanted.items()}
    first = first.select("source_file", "sheet", "_top", *[p.cast("int").alias(f"_{n}") for n, p in place.items()]).dropna(subset=[f"_{n}" for n in wanted])
    x = x.join(first, ["source_file", "sheet"]).where(F.col("row") > F.col("_top"))
    return x.select("source_file", "sheet", "row", *[F.nullif(F.trim(F.get("cells", F.col(f"_{n}") - 1)), F.lit("")).alias(n) for n in wanted])
