"""Two-phase page runs and the fenced sink."""

from datetime import date

import pytest

from tidemark.operators import paging
from tidemark.sources import commits

LISTING = "source string, page int, document long, published date"
FAR = date(2000, 1, 1)


def listed(spark, docs, size):
    """A listing of (document, day) pairs, newest first."""
    order = sorted(docs, key=lambda d: (d[1], d[0]), reverse=True)
    return spark.createDataFrame([("s", i // size + 1, *d) for i, d in enumerate(order)], LISTING)


class Store:
    def __init__(self, spark):
        self.spark, self.known, self.cursors = spark, spark.createDataFrame([], "source string, document long"), spark.createDataFrame([], paging.CURSORS)

    def run(self, listing, budget, target=FAR):
        steps = paging.run_pages(listing, self.known, self.cursors, budget, target)
        got = steps.orderBy("step").collect()
        new = [r.document for r in paging.new_documents(listing, self.known, steps).collect()]
        self.known = self.spark.createDataFrame([("s", r.document) for r in self.known.collect()] + [("s", d) for d in new], "source string, document long")
        self.cursors = self.spark.createDataFrame(paging.moved_cursors(self.cursors, steps).collect(), paging.CURSORS)
        return [(r.phase, r.page) for r in got], sorted(new), self.cursors.first()


DAYS = [(i, date(2026, 1, 1 + i)) for i in range(20)]


def test_a_run_cut_short_goes_on_where_it_stopped(spark):
    store = Store(spark)
    pages, new, cursor = store.run(listed(spark, DAYS, 3), 3)
    assert pages == [("fresh", 1), ("fresh", 2), ("fresh", 3)] and new == list(range(11, 20))
    assert (cursor.page, cursor.fresh_page, cursor.reached_cutoff) == (1, 4, False)
    pages, new, cursor = store.run(listed(spark, DAYS, 3), 3)
    assert pages == [("fresh", 1), ("fresh", 4), ("fresh", 5)] and new == list(range(5, 11))
    pages, new, cursor = store.run(listed(spark, DAYS, 3), 9)
    assert pages == [("fresh", 1), ("fresh", 6), ("fresh", 7), ("fresh", 8)] and new == list(range(5))
    assert (cursor.fresh_page, cursor.reached_cutoff, cursor.covered_start, cursor.covered_end) == (1, True, date(2026, 1, 1), date(2026, 1, 20))


def test_new_pages_on_top_start_the_scan_again_and_the_backfill_goes_on_below(spark):
    store = Store(spark)
    store.run(listed(spark, DAYS[:12], 3), 2)
    pages, new, cursor = store.run(listed(spark, DAYS[:13], 3), 5)
    assert pages == [("fresh", 1), ("fresh", 2), ("backfill", 3), ("backfill", 4), ("backfill", 5)] and new == [*range(6), 12]
    assert (cursor.page, cursor.fresh_page) == (6, 1)
    pages, new, cursor = store.run(listed(spark, DAYS[:13], 3), 5)
    assert pages == [("fresh", 1), ("backfill", 6)] and not new and cursor.page == 6 and cursor.reached_cutoff


def test_known_pages_below_the_frontier_move_the_backfill_by_one(spark):
    store = Store(spark)
    store.run(listed(spark, DAYS[:12], 3), 3)
    pages, new, cursor = store.run(listed(spark, DAYS[:15], 3), 5)
    assert pages == [("fresh", 1), ("fresh", 2), ("backfill", 3)] and new == [12, 13, 14] and cursor.page == 4
    pages, new, cursor = store.run(listed(spark, DAYS[:15], 3), 5)
    assert pages == [("fresh", 1), ("backfill", 4)] and not new and cursor.page == 5
    pages, new, cursor = store.run(listed(spark, DAYS[:15], 3), 5)
    assert pages == [("fresh", 1), ("backfill", 5), ("backfill", 6)] and new == [0, 1, 2]


def test_the_day_asked_for_ends_a_run(spark):
    pages, new, cursor = Store(spark).run(listed(spark, DAYS, 3), 9, date(2026, 1, 15))
    assert pages == [("fresh", 1), ("fresh", 2)] and new == list(range(14, 20)) and cursor.reached_cutoff and cursor.fresh_page == 1


def test_a_list_that_starts_over_ends(spark):
    store, listing = Store(spark), listed(spark, DAYS, 5)
    again = listing.unionByName(listing.withColumn("page", listing.page + 4))
    pages, new, cursor = store.run(again, 30)
    assert pages == [("fresh", p) for p in range(1, 6)] + [("backfill", 6)] and len(new) == 20 and cursor.reached_cutoff


def test_a_page_is_one_row_whatever_it_holds(spark):
    """A source's task took every document of its pages before."""
    docs = [("s", p, i, date(2026, 1, 1)) for p in (1, 2, 4) for i in range(p * 1000, p * 1000 + 1000)] + [("s", 4, 1000, date(2026, 1, 2))]
    listing, none = spark.createDataFrame(docs, LISTING), Store(spark)
    got = paging.pages_near(listing, spark.createDataFrame([("s", i) for i in range(2000, 3000)], "source string, document long"), none.cursors, 3).collect()
    assert sorted((r.page, r.first, r.last, sorted(r.unknown or [])) for r in got) == [(1, date(2026, 1, 1), date(2026, 1, 1), [[]]), (2, date(2026, 1, 1), date(2026, 1, 1), []), (4, date(2026, 1, 1), date(2026, 1, 2), [[], [1]])]


def test_no_first_page_keeps_the_cursors(spark):
    listing = spark.createDataFrame([("s", 2, 1, date(2026, 1, 1))], LISTING)
    pages, new, cursor = Store(spark).run(listing, 3)
    assert pages == [("fresh", 1)] and not new and cursor.error == "empty first page" and cursor.page == 1
    assert paging.run_pages(listing.where("false"), listing.select("source", "document"), Store(spark).cursors, 3, FAR).count() == 0


def test_a_batch_counts_once_and_as_a_whole(spark, tmp_path):
    root, df = str(tmp_path), spark.range(5)
    commits.stage(root, 1, {"ids": df, "cursor": df.limit(1)})
    assert commits.batches(spark, root) == [] and commits.rows(spark, root, "ids", "id long").count() == 0
    assert commits.commit(spark, root, 1, {"ids": df, "cursor": df.limit(1)})
    assert not commits.commit(spark, root, 1, {"ids": df})
    assert commits.commit(spark, root, 2, {"ids": spark.range(5, 7), "cursor": spark.range(9, 10)})
    assert sorted(map(tuple, commits.rows(spark, root, "ids", "id long").collect())) == [(i, 1 + (i > 4)) for i in range(7)]
    assert [r.id for r in commits.newest(spark, root, "cursor", "id long").collect()] == [9]
    with pytest.raises(Exception, match="already exists|exist"):
        commits.seal(spark, root, 2)
