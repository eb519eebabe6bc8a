"""Pruning of pages to a budget: blocks scored against a query, chosen greedily, put together again."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.dom import render
from tessella.operators.pages import block_tree, size

Scorer = Callable[[str, list[str]], list[float]]
_TOKEN = re.compile("[一-鿿]|[A-Za-z0-9]+")


def hash_vector(text: str, dims: int = 256) -> dict[int, float]:
    """Signed hash embedding of a text, unit length, zero cells left out."""
    cells: dict[int, int] = {}
    for token in _TOKEN.findall(text):
        h = int(hashlib.md5(token.encode()).hexdigest(), 16)
        cells[h % dims] = cells.get(h % dims, 0) + (1 if h // dims % 2 == 0 else -1)
    length = math.sqrt(sum(v * v for v in cells.values()))
    return {k: v / length for k, v in cells.items() if v} if length else {}


def hash_scores(query: str, texts: list[str]) -> list[float]:
    q = hash_vector(query)
    return [sum(v * q.get(k, 0.0) for k, v in hash_vector(t).items()) for t in texts]


def within_budget(words: list[int], scores: list[float], budget: int) -> list[int]:
    """Indexes by falling score, the first always and others where they still fit, in document order."""
    if len(words) != len(scores):
        raise ValueError("as many scores as blocks are needed")
    kept, total = [], 0
    for i in sorted(range(len(words)), key=lambda i: (-scores[i], i)):
        if not kept or total + words[i] <= budget:
            kept.append(i)
            total += words[i]
    return sorted(kept)


def domain_of(path: tuple[str, ...]) -> str:
    """The first part of a block's path that names a domain; isolated content has none."""
    found = next((p for p in path if p.endswith("_domain")), "")
    return "" if found == "isolated_domain" else found


def heading_context(path: tuple[str, ...]) -> str:
    return " ".join(p.split("_")[0] for p in path if re.fullmatch(r"h\d_(domain|section)", p))


def rebuild(blocks: list[tuple[str, tuple[str, ...]]]) -> str:
    """Markup of blocks in order; neighbours of one domain share a wrapper."""
    out = []
    for domain, group in groupby(blocks, key=lambda b: domain_of(b[1])):
        inner = "\n".join(html for html, _ in group)
        out.append(f'<div class="{domain}">\n{inner}\n</div>' if domain else inner)
    return "\n".join(out)


def prune(html: str, query: str, scorer: Scorer = hash_scores, *, most: int = 512, least: int = 32, budget: int = 4096) -> str:
    """The blocks of a page that a query needs most; a page without blocks, or a scorer that fails, changes nothing."""
    blocks = block_tree(html, most, least)
    if not blocks:
        return html
    texts = [n.text() for n, _, _ in blocks]
    marked = [f"[{c}] {t}" if (c := heading_context(p)) else t for t, (_, p, _) in zip(texts, blocks)]
    try:
        chosen = within_budget([size(t, False) for t in texts], scorer(query, marked), budget)
    except Exception:
        chosen = range(len(blocks))
    return rebuild([(render(blocks[i][0]), blocks[i][1]) for i in chosen])


def two_stage(html: str, query: str, first: Scorer = hash_scores, second: Scorer = hash_scores) -> str:
    """Coarse blocks by one scorer, then finer blocks of what is left by another."""
    return prune(prune(html, query, first), query, second, most=256, least=16, budget=2048)


def prune_pages(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", query_col: str = "query", budget: int | None = None) -> DataFrame:
    """(page_id, html) pruned to each row's query; with a budget in one stage, else in two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for html, query in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out.append(prune(html or "", query or "", budget=budget) if budget else two_stage(html or "", query or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["page_id", "html"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string"), F.col(query_col).cast("string")).mapInArrow(run, "page_id long, html string")
