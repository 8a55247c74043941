"""Upstreams that answer page by page, walked over many pulls.

An upstream is a URL with ``{cursor}`` in it. A pull walks every unfinished upstream
for at most its budget of pages, in tasks that keep one page at a time and the calls
to one host in a row. Pages and the cursors behind them go into one commit, so a
failed page, a lost task or a crash loses nothing and repeats nothing: the next pull
starts at the cursor of the first page that is not there.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.scratch import cut
from tidewheel.sources.commits import Change, State, Tables

#: Pages of an upstream in one pull, where its row names no budget.
BUDGET = 15
#: Where walks of each style start.
FIRST = {"cursor": "*", "offset": "0"}
PAGES = "source string, section string, url string, page int, json string"
_STEPS = "source string, section string, url string, step int, page int, cursor string, next string, finished boolean, json string, error string, duration_ms long"
_ARROW = pa.schema([*[(c, pa.string()) for c in ("source", "section", "url")], ("step", pa.int32()), ("page", pa.int32()), ("cursor", pa.string()), ("next", pa.string()), ("finished", pa.bool_()), ("json", pa.string()), ("error", pa.string()), ("duration_ms", pa.int64())])


def following(style: str, page: dict, cursor: str) -> str | None:
    """The cursor of the page after this one; None after the last.

    ``cursor``: the page names it (meta.next_cursor); no results, no cursor or the
    same one again end the walk. ``offset``: the rows so far, while there are fewer
    than the page's total; a page without a total is the only one.
    """
    if style == "cursor":
        name = (page.get("meta") or {}).get("next_cursor")
        return name if page.get("results") and name and name != cursor else None
    if style != "offset":
        raise ValueError(f"unknown style {style!r}")
    rows = len(page.get("collection") or [])
    try:
        total = int(((page.get("messages") or [{}])[0]).get("total", 0))
    except (TypeError, ValueError):
        total = 0
    reached = int(cursor) + rows
    return str(reached) if rows and reached < total else None


def walk(fetch: Callable[[str], str | None], spec: dict) -> Iterator[dict]:
    """One row for each page of an upstream, ``budget`` at most, from its cursor on; a page that fails is a row with its error and ends the walk."""
    cursor, page = spec["cursor"], spec["page"]
    same = {c: spec[c] for c in ("source", "section", "url")}
    for step in range(spec["budget"]):
        began, got, after, error = time.monotonic(), None, None, None
        try:
            got = fetch(spec["url"].replace("{cursor}", quote(cursor, safe="*")))
            after = following(spec["style"], json.loads(got) if got else {}, cursor)
        except Exception as e:  # noqa: BLE001  a failing upstream is a row, not a failed job
            error = f"{type(e).__name__}: {e}"[:300]
        spent = int((time.monotonic() - began) * 1000)
        if error is not None:
            yield same | {"step": step, "page": page, "cursor": cursor, "next": cursor, "finished": False, "json": None, "error": error, "duration_ms": spent}
            return
        page += 1
        yield same | {"step": step, "page": page, "cursor": cursor, "next": after, "finished": after is None, "json": got or None, "error": None, "duration_ms": spent}
        if after is None:
            return
        cursor = after


def fetched(upstreams: DataFrame, fetcher: str) -> DataFrame:
    """The walks of upstreams (source, section, url, style, budget, cursor, page) with a fetcher ``module:function`` that takes a URL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, _, name = fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for batch in batches:
            for spec in batch.to_pylist():
                for row in walk(fetch, spec):
                    yield pa.RecordBatch.from_pylist([row], _ARROW)

    host = F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1)
    return upstreams.repartition(host).mapInArrow(run, _STEPS)


def due(specs: DataFrame, cursors: DataFrame | None) -> DataFrame:
    """Upstreams of ``specs`` (source, section, url, style, budget) that are not walked to their end, with the cursor to go on from."""
    first = F.when(F.col("style") == "cursor", FIRST["cursor"]).otherwise(FIRST["offset"])
    new = specs.dropDuplicates(["source", "url"]).withColumn("budget", F.coalesce("budget", F.lit(BUDGET)))
    if cursors is None:
        return new.withColumns({"cursor": first, "page": F.lit(0)})
    at = cursors.select("source", "url", F.col("cursor").alias("_c"), F.col("page").alias("_p"), "finished")
    open_ = new.join(at, ["source", "url"], "left").where(~F.coalesce("finished", F.lit(False)))
    return open_.withColumns({"cursor": F.coalesce("_c", first), "page": F.coalesce("_p", F.lit(0))}).drop("_c", "_p", "finished")


def pull(tables: Tables, specs: DataFrame, fetcher: str) -> State:
    """Walk all upstreams that are due and commit what came: rows of ``pages`` (``PAGES``), ``cursors``, and a row of ``walks`` for each call.

    ``pages`` are what the parsers of ``feeds`` read. A new window of time is a new
    URL, hence a new walk. Of two pulls at once the one that commits later is refused.
    """
    base = tables.state()
    steps = cut(fetched(due(specs, tables.read("cursors", base)), fetcher), "walks")
    moved = steps.groupBy("source", "url").agg(F.max_by(F.struct(F.col("next").alias("cursor"), "page", "finished"), "step").alias("_s")).select("source", "url", "_s.*")
    walked = [{"source": r.source, "url": r.url} for r in moved.select("source", "url").toLocalIterator()]  # as many as are configured
    if not walked:
        return base
    pages = steps.where("json is not null").select("source", "section", "url", "page", "json")
    calls = steps.select("source", "url", "page", "cursor", "error", "duration_ms")
    return tables.commit([Change("pages", pages), Change("cursors", moved, instead_of=walked), Change("walks", calls)], base)
