"""Readers of the formats that documents, ledgers and registers come in."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "source string, url string, local_path string, sha256 string, bytes bigint, retrieved_at string, licence string, source_page string, extra string"
GOLD = (
    "id string, question string, language string, domain string, intent string, expected_sources array<struct<act:string,section:string,neutral_citation:string>>, match string, must_mention array<string>, "
    "should_abstain boolean, high_stakes boolean, tags array<string>, split string, `group` string, verified_by string, verified_on string, status string, notes string, split_note string"
)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """An append-only JSONL ledger with `seq`, the order of its rows; blank and broken lines are left out.

    seq is by file and place in it, so a later file's rows come after an earlier one's.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.from_json("value", LEDGER).alias("r"), F.trim("value").alias("v"))
    d = raw.where((F.col("v") != "") & F.col("r").isNotNull() & F.col("r.url").isNotNull())
    return d.select(F.struct("f", "b", "i").alias("seq"), "r.*")


def gold(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    d = spark.read.schema(GOLD).json(path)
    return d if split in (None, "all") else d.where(F.col("split") == split)


def yearly(spark: SparkSession, root: str, years: list[int]) -> DataFrame:
    """Metadata under year=YYYY folders; other years aren't read."""
    return spark.read.parquet(root).where(F.col("year").isin(years))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file, with the file's stem."""
    d = spark.read.option("multiLine", True).json(path)
    return d.withColumn("stem", F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1))


def contents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def current(files: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (url, local_path, bytes, sha256) with `current`: whether the file is there with that size and hash."""
    f = files.select(F.regexp_replace("path", "^file:", "").alias("local_path"), F.col("length").alias("_n"), F.sha2("content", 256).alias("_h"))
    d = rows.join(f, "local_path", "left")
    return d.withColumn("current", F.coalesce((F.col("_n") == F.col("bytes")) & (F.col("_h") == F.lower("sha256")), F.lit(False))).drop("_n", "_h")


def kind(content: Column) -> Column:
    """pdf, docx, image, doc, heic or null by the first bytes; a zip is docx if it names word/ early on."""
    h = F.hex(F.substring(content, 1, 16))
    early = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    return (
        F.when(h.startswith("25504446"), "pdf")
        .when(h.startswith("504B0304") & (early.contains("word/") | early.contains("[Content_Types].xml")), "docx")
        .when(h.startswith("FFD8FF") | h.startswith("89504E47") | h.startswith("49492A00") | h.startswith("4D4D002A"), "image")
        .when(h.startswith("D0CF11E0"), "doc")
        .when(F.substring(h, 9, 8) == "66747970", F.when(F.substring(h, 17, 8).isin("68656963", "68656978", "6D696631"), "heic"))
    )


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_lines_of(content: bytes) -> list[tuple[int, str, bool]]:
    """(page, text, heading) of paragraphs and table rows in order; pages by the breaks that were rendered last."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    page, out = 1, []

    def text_of(p) -> tuple[str, int]:
        said, breaks = [], 0
        for x in p.iter():
            if x.tag == f"{_W}t":
                said.append(x.text or "")
            elif x.tag == f"{_W}tab":
                said.append("\t")
            elif x.tag == f"{_W}lastRenderedPageBreak" or x.tag == f"{_W}br" and x.get(f"{_W}type") == "page":
                breaks += 1
        return "".join(said).strip(), breaks

    for block in body if body is not None else []:
        if block.tag == f"{_W}p":
            said, breaks = text_of(block)
            page += breaks
            style = block.find(f"{_W}pPr/{_W}pStyle")
            if said:
                out.append((page, said, style is not None and (style.get(f"{_W}val") or "").lower().startswith("heading")))
        elif block.tag == f"{_W}tbl":
            for row in block.iter(f"{_W}tr"):
                cells = [" ".join(text_of(p)[0] for p in c.iter(f"{_W}p")).strip() for c in row.iter(f"{_W}tc")]
                page += sum(text_of(p)[1] for p in row.iter(f"{_W}p"))
                if any(cells):
                    out.append((page, " | ".join(cells), False))
    return out


def docx_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, page, text, heading, problem) of Word files; one that can't be read has one row with the problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, i, p, t, h, None) for i, (p, t, h) in enumerate(docx_lines_of(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((path, 0, None, None, None, type(e).__name__))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "line_no", "page", "text", "heading", "problem"])

    return files.select("path", "content").mapInArrow(run, "path string, line_no int, page int, text string, heading boolean, problem string")


def ocr_lines(words: DataFrame, scale: float = 1.0) -> DataFrame:
    """(doc_id, page, block, par, line, text, left, top, bottom, confidence) of word rows of OCR tables.

    words: (doc_id, level, page_num, block_num, par_num, line_num, left, top, width, height, conf, text). Only words (level 5)
    with a confidence and text count; they are joined from left to right.
    """
    w = words.where((F.col("level") == 5) & (F.col("conf") >= 0) & (F.trim("text") != ""))
    d = w.groupBy("doc_id", F.col("page_num").alias("page"), F.col("block_num").alias("block"), F.col("par_num").alias("par"), F.col("line_num").alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda x: F.trim(x["text"]))  # words of one line
    return d.agg(F.array_join(ordered, " ").alias("text"), (F.min("left") * scale).alias("left"), (F.min("top") * scale).alias("top"), (F.max(F.col("top") + F.col("height")) * scale).alias("bottom"), F.round(F.avg("conf") / 100, 6).alias("confidence"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A register of laws from YAML (a list of maps), as the statutes table."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("PyYAML reads registers; without it pass the table itself") from e
    with open(path, encoding="utf-8") as f:
        rows = yaml.safe_load(f) or []
    schema = "id string, title string, short_title string, aliases array<string>, act_number int, act_year int, status string, in_force_from string, repealed_from string, successor string, source_url string, verified_on string, evidence string"
    names = re.findall(r"(\w+) (?:string|int|array<string>)", schema)
    text = lambda v: v if v is None or isinstance(v, (str, int, list)) else str(v)
    return spark.createDataFrame([tuple(text(r.get(n)) for n in names) for r in rows], schema)
