"""Recognition and raster engines as optional adapters: they turn page content into lines, words and blocks.

An engine is any object with `recognize(content, page) -> (lines, blocks)`; it is built once a task by its
factory and runs where the pages are. One that also has `recognize_batch(contents, pages)`, giving a list of these, is
handed several pages at a time; a batch that fails is tried again page by page. Libraries are imported inside the
factories, so none is needed here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.functions.text import element_text

LINE = "line_idx long, text string, x0 double, y0 double, x1 double, y1 double, line_conf double"
BLOCK = "block_idx long, position long, label string, x0 double, y0 double, x1 double, y1 double"


@dataclass(frozen=True)
class PipelineConfig:
    """Settings of a run."""

    dpi: int = 400
    min_dpi: int = 320
    lang: str = "eng"
    engine: str = "surya-layout"
    batch_size: int = 2
    low_confidence_threshold: float = 70.0
    checkpoint_dir: str | None = None
    tessdata: str | None = None
    force: bool = False

    def __post_init__(self) -> None:
        if self.engine not in ("tesseract", "tesseract-cols", "surya", "surya-layout"):
            raise ValueError(f"unknown engine {self.engine}")
        if self.tessdata is not None and " " in self.tessdata:
            raise ValueError("the tessdata path must have no spaces")
        if self.batch_size < 1:
            object.__setattr__(self, "batch_size", 1)


class Engine(Protocol):
    def recognize(self, content: bytes, page: int) -> tuple[list[dict], list[dict]]: ...


def render(content: bytes, page: int, dpi: int):
    """A page's raster as an array in BGR order; needs PyMuPDF and numpy."""
    import fitz
    import numpy as np

    with fitz.open(stream=content, filetype="pdf") as doc:
        pix = doc[page - 1].get_pixmap(dpi=dpi, alpha=False)
    flat = np.frombuffer(pix.samples, np.uint8).reshape(pix.height, pix.width, pix.n)
    return flat[:, :, 2::-1].copy() if pix.n >= 3 else flat.repeat(3, axis=2)  # a fourth channel goes


def _one(engine: Engine, content: bytes, page: int) -> tuple:
    try:
        return (*engine.recognize(content, page), None)
    except Exception as e:  # an engine may raise anything; the page's row carries it
        return [], [], f"{type(e).__name__}: {e}"


def _batch(engine: Engine, contents: list[bytes], pages: list[int]) -> list[tuple]:
    together = getattr(engine, "recognize_batch", None)
    if together and len(pages) > 1:
        try:
            got = [(*g, None) for g in together(contents, pages)]
            if len(got) == len(pages):
                return got
        except Exception:  # what failed together may do alone, or its own row says why not
            pass
    return [_one(engine, c, p) for c, p in zip(contents, pages, strict=True)]


def recognize(pages: DataFrame, factory: Callable[[], Engine], batch_size: int = 2) -> DataFrame:
    """(book, page, content) to (book, page, lines, blocks, error); a page that fails is reported, not dropped."""
    book = pages.schema["book"].dataType.simpleString()
    size = max(1, batch_size)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = factory()
        for batch in it:
            rows = []
            for at in range(0, len(batch), size):
                some = batch.iloc[at : at + size]
                got = _batch(engine, some["content"].tolist(), some["page"].tolist())
                rows += [(b, p, *g) for b, p, g in zip(some["book"], some["page"], got, strict=True)]
            yield pd.DataFrame(rows, columns=["book", "page", "lines", "blocks", "error"])

    return pages.select("book", "page", "content").mapInPandas(run, f"book {book}, page long, lines array<struct<{LINE.replace(' ', ':').replace(',:', ',')}>>, blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>, error string")


def lines_of_html(blocks: DataFrame) -> DataFrame:
    """Lines (page_id, line_idx, text, x0, y0, x1, y1, line_conf) of HTML blocks, in reading order.

    blocks: (page_id, reading_order, html, skipped, error, x0, y0, x1, y1, confidence). Blocks that were skipped, failed or
    hold no text give no line; a confidence that is null counts as 0.
    """
    text = element_text(F.col("html"))
    bad = F.coalesce(F.col("skipped"), F.lit(False)) | F.coalesce(F.col("error"), F.lit(False))
    rows = blocks.where(~bad).withColumn("text", text).where("text <> ''")
    order = Window.partitionBy("page_id").orderBy("reading_order", "y0", "x0")
    return rows.select("page_id", (F.row_number().over(order) - 1).cast("long").alias("line_idx"), "text", "x0", "y0", "x1", "y1", F.coalesce("confidence", F.lit(0.0)).alias("line_conf"))
