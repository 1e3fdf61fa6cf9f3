"""Document files as markdown, by backends that are chosen by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A converter of a file's bytes and the pages wanted (None: all) to markdown.
Converter = Callable[[bytes, "list[int] | None"], str]


def rules() -> Converter:
    """By the layout rules of a PDF library, page by page. Needs that library on the executors."""
    import pymupdf
    import pymupdf4llm

    return lambda data, pages: pymupdf4llm.to_markdown(pymupdf.open(stream=data, filetype="pdf"), pages=pages)


def layout() -> Converter:
    """By a layout model, always the whole file: pages are ignored. Needs the model's library on the executors."""
    import io

    from docling.datamodel.base_models import DocumentStream
    from docling.document_converter import DocumentConverter

    converter = DocumentConverter()
    return lambda data, pages: converter.convert(DocumentStream(name="document.pdf", stream=io.BytesIO(data))).document.export_to_markdown()


BACKENDS: dict[str, Callable[[], Converter]] = {"rules": rules, "layout": layout}


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path and content of the files in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def to_markdown(documents: DataFrame, backend: str = "rules", backends: dict[str, Callable[[], Converter]] | None = None) -> DataFrame:
    """documents (..., content, and pages array<int> if only some are wanted) with markdown and error in place of content. The backend is
    made once per task; a file that it can't read gives an error, not a failed job. An unknown backend is a ValueError."""
    known = BACKENDS if backends is None else backends
    if backend not in known:
        raise ValueError(f"unknown backend {backend!r}, not one of {sorted(known)}")
    make = known[backend]
    kept = [c for c in documents.columns if c not in ("content", "pages")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = None
        for b in batches:
            convert = convert or make()
            wanted = b.column("pages").to_pylist() if "pages" in b.schema.names else [None] * len(b)
            texts, errors = [], []
            for data, pages in zip(b.column("content").to_pylist(), wanted, strict=True):
                try:
                    texts.append(convert(data, pages) if data is not None else None)
                    errors.append(None if data is not None else "no file")
                except Exception as e:  # whatever a backend makes of a broken file
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(errors, pa.string())], [*kept, "markdown", "error"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)
    return documents.mapInArrow(run, f"{kinds}, markdown string, error string")
