"""One ordered export file; pages of the history by order statistics; form text that is no date or number."""

import datetime as dt
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockroom.functions import as_date, as_key
from stockroom.operators import sales as S
from stockroom.schema import from_rows
from stockroom.sources.sinks import export_file


@pytest.mark.parametrize("rows", [0, 5, 1_000_000])
def test_one_ordered_file(spark, rows):
    path = tempfile.mkdtemp(prefix="stockroom-file-") + "/export.csv"
    df = spark.range(rows).select((F.col("id") * 7919 % 1_000_003).alias("k"), F.concat(F.lit('na"me, '), F.col("id")).alias("t"))
    size = export_file(df, ["Key", 'The "text"'], [F.desc("k")], path)
    want = sorted(((i * 7919 % 1_000_003, i) for i in range(rows)), reverse=True)
    with open(path, "rb") as f:
        got = f.read()
    assert size == len(got)
    assert got == ('"Key","The ""text"""\n' + "".join(f'"{k}","na""me, {i}"\n' for k, i in want)).encode()
    export_file(df.limit(1), ["a", "b"], [F.asc("k")], path)  # replaces the file
    with open(path, "rb") as f:
        assert f.read().startswith(b'"a","b"\n')


def test_pages_by_order_statistics(spark):
    day = dt.datetime(2000, 1, 1)
    rows = [(i, 1 + i % 3, 2, day + dt.timedelta(hours=i * 37 % 101), Decimal("4.00"), 1 + i % 2) for i in range(230)]
    t = from_rows(spark, {"sales": rows, "products": [(1, "a", "c", Decimal("2.00"), "d"), (2, "b", "c", Decimal("3.00"), "d")]})
    users = spark.createDataFrame([(1, "u"), (2, "v")], "UserID long, Username string")
    index = S.page_index(t.sales, t.products, users, ranges=7)
    assert index.counts.count() > 4
    mine = sorted((r for r in rows if r[1] < 3), key=lambda r: (r[3], r[0]), reverse=True)
    for page in (-1, 1, 2, 8, 15, 16, 17, 10**6):
        first = (max(page, 1) - 1) * 10
        got = [r.SaleID for r in S.page_of(index, t.products, users, page).collect()]
        assert got == [r[0] for r in mine[first:first + 10]]
        assert got == [r.SaleID for r in S.sales_history(t.sales, t.products, users, page).collect()]
    # A page opens one or two ranges, not all rows before it.
    hit = index.counts.where((F.col("newer") < 110) & (F.col("newer") + F.col("rows") > 100)).count()
    assert hit <= 2
    assert S.page_of(S.page_index(t.sales.limit(0), t.products, users), t.products, users).count() == 0


def test_form_text_that_is_no_date_or_number(spark):
    assert [as_date(x) for x in (None, "", "2000-06-01", " 2000-06-01 ", "abc", "2000-13-01")] == [
        None, None, dt.date(2000, 6, 1), dt.date(2000, 6, 1), None, None]
    assert [as_key(x) for x in (None, "", "0", 0, "7", 7, " 12abc", "abc", "-3")] == [None, None, None, None, 7, 7, 12, 0, -3]
    t = from_rows(spark, {"sales": [(1, 5, 2, dt.datetime(2000, 1, 1), Decimal("4.00"), 1)],
                          "products": [(5, "a", "c", Decimal("2.00"), "d")]})
    users = spark.createDataFrame([(1, "u")], "UserID long, Username string")
    count = lambda **kw: S.sales_history(t.sales, t.products, users, **kw).count()
    assert (count(date_from="soon"), count(product="abc"), count(product="5x"), count()) == (1, 0, 1, 1)
