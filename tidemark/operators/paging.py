"""Two cursors over lists of pages, newest first: a scan of what is new on top, and a backfill that goes on below.

A run reads at most so many pages of each source. It scans from page 1 on, or, if page 1 holds nothing new, from where
the scan before stopped, to the first page of known documents, the frontier. The backfill then goes on at its own
cursor or below the frontier, whichever is deeper, until a page reaches back to the day asked for, the list ends, or a
page below the frontier holds nothing new: lists that start over behind their end don't keep it going.

A run looks at some five budgets of pages of a source at most. A page goes to its source's task as one row, whatever it
holds, so what a task holds is bounded by the budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CURSORS = "source string, page int, fresh_page int, covered_start date, covered_end date, reached_cutoff boolean, error string"
_STEPS = "source string, step int, phase string, page int, next_page int, next_fresh int, covered_start date, covered_end date, reached_cutoff boolean, error string"


class _Walk:
    """One source's run: the pages it reads, and the cursors after each."""

    def __init__(self, pages: dict[int, tuple], page: int, fresh: int, start: date | None, end: date | None, budget: int, target: date):
        self.pages, self.page, self.fresh, self.start, self.end = pages, page, fresh, start, end
        self.left, self.target, self.cutoff, self.frontier, self.seen = budget, target, False, None, set()

    def read(self, number: int) -> tuple[bool, bool]:
        """Does a page hold documents, and any that is new and on no page read before?"""
        self.left -= 1
        if number not in self.pages:
            return False, False
        first, last, unknown = self.pages[number]
        new = any(self.seen.isdisjoint(earlier) for earlier in unknown)
        self.seen.add(number)
        if first is not None:
            self.start, self.end = min([first, *filter(None, [self.start])]), max([last, *filter(None, [self.end])])
            self.cutoff |= first <= self.target
        return True, new

    def step(self, phase: str, number: int, next_page: int, next_fresh: int, error: str | None = None) -> tuple:
        return phase, number, next_page, next_fresh, self.start, self.end, self.cutoff, error

    def steps(self) -> Iterator[tuple]:
        number, done = 1, False
        while self.left > 0 and not done:
            items, new = self.read(number)
            if not items:
                if number == 1:
                    yield self.step("fresh", 1, self.page, 1, "empty first page")
                    return
                self.cutoff = True
            done = self.cutoff or not new and not (number == 1 and self.fresh > 1)
            if done:
                following = 1
                if not self.cutoff:
                    self.frontier = number
            elif number == 1 and self.fresh > 1:
                following = 2 if new else self.fresh
            else:
                following = number + 1
            yield self.step("fresh", number, self.page, following)
            number = following
        if not done or self.cutoff:
            return
        number = max(self.page, self.frontier + 1)
        while self.left > 0 and not self.cutoff:
            items, new = self.read(number)
            self.cutoff |= not new
            yield self.step("backfill", number, number + items, 1)
            number += 1


def pages_near(listing: DataFrame, known: DataFrame, cursors: DataFrame, budget: int) -> DataFrame:
    """One row for each page that a run can read, with its days, its unknown documents' earlier pages and the cursors."""
    at = cursors.select("source", "page", "fresh_page", "covered_start", "covered_end").withColumnRenamed("page", "cursor")
    rows = listing.select("source", "page", "document", F.col("published").cast("date").alias("day")).join(at, "source", "left")
    rows = rows.withColumns({"cursor": F.coalesce("cursor", F.lit(1)), "fresh_page": F.coalesce("fresh_page", F.lit(1))})
    below = lambda c: F.col("page").between(F.col(c), F.col(c) + 2 * budget + 2)
    near = rows.where((F.col("page") <= 2 * budget + 2) | below("fresh_page") | below("cursor"))
    # pages are read in order, so a document is new on a page if none of its earlier pages was read: of a page's unknown
    # documents only the distinct lists of earlier pages go on, mostly one empty list
    pages = near.groupBy("source", "page").agg(F.min("day").alias("first"), F.max("day").alias("last"), *(F.any_value(c).alias(c) for c in ("cursor", "fresh_page", "covered_start", "covered_end")))
    unknown = near.select("source", "document", "page").join(known.select("source", "document").distinct(), ["source", "document"], "left_anti")
    lists = unknown.groupBy("source", "document").agg(F.array_sort(F.collect_set("page")).alias("on")).groupBy("source", "on").agg(F.lit(1).alias("one"))
    earlier = lists.select("source", F.explode("on").alias("page"), "on").select("source", "page", F.filter("on", lambda p: p < F.col("page")).alias("earlier"))
    return pages.join(earlier.groupBy("source", "page").agg(F.collect_set("earlier").alias("unknown")), ["source", "page"], "left")


def run_pages(listing: DataFrame, known: DataFrame, cursors: DataFrame, budget: int, target: date) -> DataFrame:
    """The steps of a run: (source, step, phase, page) read, with the cursors and the coverage after each.

    listing has (source, page, document, published), known (source, document), cursors CURSORS. A source without a
    cursor starts at page 1.
    """
    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        day = lambda x: None if pd.isna(x) else x
        pages = {int(r.page): (day(r.first), day(r.last), [set(map(int, e)) for e in r.unknown] if r.unknown is not None else []) for r in frame.itertuples()}
        first = frame.iloc[0]
        days = [day(first[c]) for c in ("covered_start", "covered_end")]
        steps = _Walk(pages, int(first["cursor"]), int(first["fresh_page"]), *days, budget, target).steps()
        return pd.DataFrame([(first["source"], n, *s) for n, s in enumerate(steps)], columns=[c.split()[0] for c in _STEPS.split(", ")])

    return pages_near(listing, known, cursors, budget).groupBy("source").applyInPandas(walk, _STEPS)


def new_documents(listing: DataFrame, known: DataFrame, steps: DataFrame) -> DataFrame:
    """(source, document, published, step): documents of the pages read that weren't known, each with the first step."""
    read = listing.join(steps.where("error is null").select("source", "page", "step"), ["source", "page"])
    first = read.groupBy("source", "document").agg(F.min(F.struct("step", "published")).alias("f"))
    return first.join(known.select("source", "document").distinct(), ["source", "document"], "left_anti").select("source", "document", "f.published", "f.step")


def moved_cursors(cursors: DataFrame, steps: DataFrame) -> DataFrame:
    """CURSORS after a run: those of the last step of each source, the others as they were."""
    last = steps.groupBy("source").agg(F.max_by(F.struct(*(F.col(c) for c in ("next_page", "next_fresh", "covered_start", "covered_end", "reached_cutoff", "error"))), "step").alias("s"))
    moved = last.select("source", F.col("s.next_page").alias("page"), F.col("s.next_fresh").alias("fresh_page"), "s.covered_start", "s.covered_end", "s.reached_cutoff", "s.error")
    return moved.unionByName(cursors.join(last, "source", "left_anti"))
