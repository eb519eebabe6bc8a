"""Folders of pages, documents and JSON blocks as DataFrames, and JSON-lines sinks."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401  (pa.fs)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.pages import page_text

#: Extensions that can be read, and the largest file.
EXTENSIONS = ("txt", "md", "html", "htm", "json", "pdf")
MOST_BYTES = 20 * 1024 * 1024
BLOCK_FIELDS = "chunk_idx int, page_name string, title string, page_url string, summary string, question string, text string, html_content string, block_path string, time string"


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, html, folder) of every .html file below a folder, whatever the case of its suffix."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    pages = raw.where(F.lower("path").endswith(".html"))
    return pages.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"))


def json_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """(path, blocks) of every readable .json file: an object counts as a list of one; bad and empty files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    text = F.trim(F.decode("content", "UTF-8"))
    whole = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    read = raw.select("path", F.from_json(whole, f"array<struct<{BLOCK_FIELDS.replace(' int', ':int').replace(' string', ':string')}>>", {"mode": "PERMISSIVE"}).alias("blocks"))
    return read.where("blocks is not null").select("path", F.filter("blocks", lambda b: b.isNotNull()).alias("blocks")).where("size(blocks) > 0").orderBy("path")


def _parse(name: str, raw: bytes) -> str:
    kind = name.rpartition(".")[2].lower()
    text = raw.decode("utf-8", "ignore")
    if kind in ("html", "htm"):
        return page_text(text)
    if kind == "json":
        found = json.loads(text)
        return "\n".join(str(b.get("text", "")) for b in (found if isinstance(found, list) else [found]))
    if kind == "pdf":
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF needs the package pypdf") from e
        import io

        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages)
    if kind in ("txt", "md"):
        return text
    raise ValueError(f"cannot read .{kind} files")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, error) of every file below a folder; files too large or of another kind give an error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, size, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    if size > MOST_BYTES:
                        raise ValueError(f"larger than {MOST_BYTES} bytes")
                    rows.append((path, _parse(path, content or b""), None))
                except Exception as e:
                    rows.append((path, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, names=["path", "text", "error"])

    return raw.select("path", "length", F.when(F.col("length") <= MOST_BYTES, F.col("content")).alias("content")).mapInArrow(run, "path string, text string, error string")


def write_jsonl(df: DataFrame, path: str, *, by: str | None = None) -> None:
    """Append rows as JSON lines, one folder for each value of ``by``."""
    writer = df.write.mode("append").option("ignoreNullFields", "false")
    (writer.partitionBy(by) if by else writer).json(path)


def write_mirrored(rows: DataFrame, folder: str, path: Column, body: Column, *, suffix: str | None = None) -> DataFrame:
    """Write the text of each row to a file of its own below ``folder``, at a relative path, and return (path, bytes, error).

    ``suffix`` takes the place of the path's own, as ``.json`` for blocks of a page. Files are
    written beside their place and then moved, so that a task that runs again, or dies, leaves
    whole files. A path that is null, absolute or leads out of the folder, and a null text, give
    an error and no file. Nothing is written before the result is read; paths must be distinct,
    and the folder in a store that pyarrow reaches.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)
        for batch in batches:
            out = []
            for name, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                try:
                    if not name or name.startswith("/") or ".." in name.split("/"):
                        raise ValueError("not a path below the folder")
                    if text is None:
                        raise ValueError("no text")
                    target = f"{root.rstrip('/')}/{name if suffix is None else posixpath.splitext(name)[0] + suffix}"
                    store.create_dir(posixpath.dirname(target), recursive=True)
                    part = f"{posixpath.dirname(target)}/.{posixpath.basename(target)}.{uuid.uuid4().hex}"
                    data = text.encode("utf-8", "surrogatepass")
                    with store.open_output_stream(part) as f:
                        f.write(data)
                    store.move(part, target)
                    out.append((name, len(data), None))
                except Exception as e:
                    out.append((name, None, str(e)))
            a, b, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["path", "bytes", "error"])

    return rows.select(path.cast("string").alias("path"), body.cast("string").alias("body")).mapInArrow(run, "path string, bytes long, error string")
