"""Operators whose choices depend on the ones before: greedy page packing and greedy requirement de-duplication, a file or tender at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def chunks(pages: list[tuple[int, str]], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first page, last page, characters) of chunks: pages are taken while they fit, at least one, and the next chunk repeats `overlap` pages."""
    sizes = [len(f"\n[PAGE {number}]\n{text}") for number, text in pages]
    out, at = [], 0
    while at < len(pages):
        end, total = at + 1, sizes[at]
        while end < len(pages) and total < limit and total + sizes[end] <= limit:
            total += sizes[end]
            end += 1
        out.append((pages[at][0], pages[end - 1][0], total))
        at = max(end - overlap, at + 1) if end - overlap > at else end
    return out


def pack_pages(pages: DataFrame, limit: int = 6000, overlap: int = 1) -> DataFrame:
    """(file, first_page, last_page, n_chars) of pages (file, page, text)."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("page")
        found = chunks(list(zip(rows["page"], rows["text"].fillna(""), strict=True)), limit, overlap)
        return pd.DataFrame([(rows["file"].iloc[0], *c) for c in found], columns=["file", "first_page", "last_page", "n_chars"])

    return pages.groupBy("file").applyInPandas(pack, "file long, first_page long, last_page long, n_chars long")


def greedy_dedup(rows: DataFrame) -> DataFrame:
    """(tender, pos, quote) that are kept: in order, each whose quote neither is in, nor holds, one kept before."""

    def dedup(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        group = group.sort_values("pos").reset_index(drop=True)
        for i, quote in enumerate(group["quote"].fillna("")):
            if not any(quote in other or other in quote for other in group["quote"].iloc[kept]):
                kept.append(i)
        return group.iloc[kept]

    return rows.groupBy("tender").applyInPandas(dedup, rows.schema)
