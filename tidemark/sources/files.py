"""Sources of memos: folders of files, HTML pages, delimited tables, conversations, manifests and ledgers."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clean_text

#: What a walk leaves out, and the suffixes it takes.
SKIPPED = r"/(?:\.[^/]+|node_modules|__pycache__|venv|dist|build)/|/\.[^/]+$|/[^/]*(?:secret|credential|id_rsa)[^/]*$"
SUFFIXES = ("md", "txt", "rst", "html", "htm", "csv", "tsv", "json", "py")


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text, content_hash, size) of the texts under a folder, read as bytes and decoded by Spark.

    Hidden and tool folders and files that look like secrets are left out; byte-order marks and NULs are dropped.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{%s}" % ",".join(SUFFIXES)).load(folder)
    plain = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    return raw.where(~plain.rlike(SKIPPED)).select(plain.alias("file"), clean_text(F.col("content")).alias("text"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"))


def verified_objects(objects: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows (uri, sha256, size) with status: ok, missing, size or digest, against (file, content_hash, size)."""
    have = objects.select(F.col("file").alias("uri"), "content_hash", F.col("size").alias("_size"))
    status = F.when(F.col("content_hash").isNull(), "missing").when(F.col("_size") != F.col("size"), "size").when(F.col("content_hash") != F.col("sha256"), "digest").otherwise("ok")
    return manifest.join(have, "uri", "left").select("uri", status.alias("status"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(uri, version_id, media_type, size, sha256): the objects of JSON manifests, each address once."""
    schema = "tenant_id string, corpus_version string, objects array<struct<uri string, version_id string, media_type string, size bigint, sha256 string>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("objects").alias("o")).select("o.*").distinct()


def read_ledger(spark: SparkSession, path: str, key: str = "question_id") -> DataFrame:
    """(key, line): rows of a JSON-lines ledger without damaged lines; of a repeated key the last line written counts.

    A line's place is its file, the split of the file and its number in the task that reads the split in order.
    """
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("nr")).alias("place"))
    parsed = lines.withColumn("k", F.get_json_object("value", f"$.{key}")).where("k is not null")
    return parsed.groupBy(F.col("k").alias(key)).agg(F.max_by("value", "place").alias("line"))


def unfinished(questions: DataFrame, ledger: DataFrame, key: str = "question_id") -> DataFrame:
    return questions.join(ledger.select(key), key, "left_anti")


def frontmatter(text: Column) -> tuple[Column, Column, Column, Column]:
    """(supersedes, valid_from, valid_until, body) of a text that begins with a ``---`` block; else nulls and the text."""
    block = F.regexp_extract(text, r"^﻿?---[ \t]*\r?\n((?:.*\r?\n)*?)---[ \t]*(?:\r?\n|$)", 1)
    has = text.rlike(r"^﻿?---[ \t]*\r?\n(?:.*\r?\n)*?---[ \t]*(?:\r?\n|$)")

    def key(name: str) -> Column:
        raw = F.trim(F.regexp_extract(block, rf"(?m)^{name}[ \t]*:[ \t]*(.*?)[ \t]*\r?$", 1))
        bare = F.regexp_replace(raw, r"""^(['"])(.*)\1$""", "$2")
        return F.when(has & (bare != ""), bare)

    body = F.when(has, F.regexp_replace(text, r"^﻿?---[ \t]*\r?\n(?:.*\r?\n)*?---[ \t]*(?:\r?\n|$)", "")).otherwise(text)
    return key("supersedes"), key("valid_from"), key("valid_until"), body


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and (text := " ".join(data.split())):
            self.found.append(text)


def visible_text(html: Column) -> Column:
    """Texts of a page in order, one a line; scripts and styles are left out. Null gives an empty text."""

    @F.pandas_udf("string")
    def visible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def read(page: str | None) -> str:
            parser = _Visible()
            parser.feed(page or "")
            parser.close()
            return "\n".join(parser.found)

        for pages in batches:
            yield pages.map(read, na_action=None)

    return visible(html)


#: Rows and columns that one cell may span, and columns of a table: pages may claim any number.
MOST_SPAN, MOST_COLUMNS = 1000, 256
_HEADINGS = {f"h{n}": n for n in range(1, 7)}


def table_grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells (text, row span, column span) in their places; a cell that spans several stands in each of them."""
    taken: dict[tuple[int, int], str] = {}
    for y, row in enumerate(rows):
        x = 0
        for text, down, along in row:
            while (y, x) in taken:
                x += 1
            for dy in range(min(max(1, down), MOST_SPAN, len(rows) - y)):
                for dx in range(min(max(1, along), MOST_SPAN)):
                    if x + dx < MOST_COLUMNS:
                        taken.setdefault((y + dy, x + dx), text)
            x += max(1, along)
    width = max((x for _, x in taken), default=-1) + 1
    return [[taken.get((y, x), "") for x in range(width)] for y in range(len(rows))]


def grid_markdown(grid: list[list[str]]) -> str:
    """The rows of a grid that hold anything, the first as the header."""
    lines = ["| " + " | ".join(c.replace("|", "\\|") for c in row) + " |" for row in grid if any(row)]
    return "\n".join([lines[0], "| " + " | ".join("---" for _ in grid[0]) + " |", *lines[1:]]) if lines else ""


class _Blocks(HTMLParser):
    """Typed blocks of a page in order: (kind, heading, table, text). A table in a cell is a block of its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.texts: list[str] = []
        self.heading = self.title = None
        self.hidden = self.n_tables = 0
        self.tables: list[dict] = []

    def flush(self) -> None:
        if self.texts:
            self.blocks.append(("text", self.heading, None, "\n".join(self.texts)))
        self.texts = []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template")
        if tag in _HEADINGS and not self.tables:
            self.flush()
            self.title = []
        elif tag == "table":
            self.flush()
            self.tables.append({"rows": [], "cell": None})
        elif tag == "tr" and self.tables:
            self.close_cell()
            self.tables[-1]["rows"].append([])
        elif tag in ("td", "th") and self.tables:
            self.close_cell()
            spans = {k: int(v) if v and v.strip().isdigit() else 1 for k, v in attrs if k in ("rowspan", "colspan")}
            if not self.tables[-1]["rows"]:
                self.tables[-1]["rows"].append([])
            self.tables[-1]["cell"] = ([], spans.get("rowspan", 1) or MOST_SPAN, spans.get("colspan", 1))

    def close_cell(self) -> None:
        if (cell := self.tables[-1]["cell"]) is not None:
            self.tables[-1]["rows"][-1].append((" ".join(cell[0]), cell[1], cell[2]))
            self.tables[-1]["cell"] = None

    def close_table(self) -> None:
        self.close_cell()
        text = grid_markdown(table_grid(self.tables.pop()["rows"]))
        if text:
            self.n_tables += 1
            self.blocks.append(("table", self.heading, self.n_tables, text))

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template") and self.hidden > 0
        if tag in _HEADINGS and self.title is not None:
            self.end_heading(_HEADINGS[tag])
        elif tag == "table" and self.tables:
            self.close_table()
        elif tag in ("td", "th") and self.tables:
            self.close_cell()

    def end_heading(self, level: int) -> None:
        if text := " ".join(self.title):
            self.heading = "#" * level + " " + text
            self.blocks.append(("heading", self.heading, None, text))
        self.title = None

    def handle_data(self, data):
        text = " ".join(data.split())
        if self.hidden or not text:
            return
        if self.tables and self.tables[-1]["cell"] is not None:
            self.tables[-1]["cell"][0].append(text)
        else:
            (self.texts if self.title is None else self.title).append(text)

    def finish(self) -> list[tuple]:
        self.close()
        while self.tables:
            self.close_table()
        if self.title:
            self.end_heading(1)
        self.flush()
        return self.blocks


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, ord, kind, heading, table_index, text) of ``pages`` (page_id, html): the page's texts, headings and tables
    in order. heading is the last one before the block, as Markdown; tables are Markdown, spanned cells repeated.
    Scripts and styles are left out; what isn't closed ends with the page. Null pages have no blocks."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b.page_id.tolist(), b.html.tolist(), strict=True):
                parser = _Blocks()
                parser.feed(html or "")
                rows += [(page, n, *block) for n, block in enumerate(parser.finish())]
            yield pd.DataFrame(rows, columns=["page_id", "ord", "kind", "heading", "table_index", "text"]).astype({"table_index": "Int64", "page_id": object})

    return pages.select("page_id", "html").mapInPandas(read, f"page_id {kind}, ord long, kind string, heading string, table_index long, text string")


def markdown_rows(table: DataFrame) -> DataFrame:
    """(line): a table's rows as Markdown table lines; cells lose line breaks, and bars are escaped."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " "), r"\|", r"\\|")
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, table.columns)), F.lit(" |")).alias("line"))


def read_delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    return spark.read.option("header", "true").option("sep", separator).option("mode", "PERMISSIVE").csv(path)


def conversation_memos(turns: DataFrame) -> DataFrame:
    """(conv_id, ord, text): each turn as a memo ``role: text``; one row a turn, so a long dialogue is never gathered."""
    said = F.concat(F.coalesce("role", F.lit("unknown")), F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", F.col("turn").alias("ord"), said.alias("text"))


def write_generation(chunks: DataFrame, folder: str, tenant_id: str, generation_id: str) -> None:
    """Append an immutable generation: Parquet partitioned by tenant and generation, pruned on read."""
    chunks.withColumn("tenant_id", F.lit(tenant_id)).withColumn("generation_id", F.lit(generation_id)).write.partitionBy("tenant_id", "generation_id").mode("append").parquet(folder)


def read_generation(spark: SparkSession, folder: str, tenant_id: str, generation_id: str) -> DataFrame:
    return spark.read.parquet(folder).where((F.col("tenant_id") == tenant_id) & (F.col("generation_id") == generation_id))


def cached_embeddings(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of texts by content key; only the missing ones have to be embedded.

    ``wanted`` is (id, text), ``cache`` (key, embedding); key is the SHA-256 of the text.
    """
    keyed = wanted.withColumn("key", F.sha2("text", 256))
    return keyed.join(cache, "key").select("id", "key", "embedding"), keyed.join(cache.select("key"), "key", "left_anti")
