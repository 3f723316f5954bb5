import pytest

from vantora.operators import wide

SCHEMA = "entry_no long, id long, coll_name string, meta_key string, meta_value string, attr string"


def cells(spark, pairs):
    rows = [(i, i, "c", k, v, "x") for i, (k, v) in enumerate(pairs)]
    got = {r.id: (r.attr, r.cell) for r in wide.filled_cells(wide.wide_table(spark.createDataFrame(rows, SCHEMA))).collect()}
    return [got.get(i) for i in range(len(pairs))]


NUMBERS = {
    "12.5": "12500000", "0,46": "460000", "$0.95": "950000", "0.85 USD": "850000", "1.00097e3": "1000970000", "4e0": "4000000", "7.8e-1": "780000", "€ 1.046,70": "1046700000",
    "1,023.16": "1023160000", "1.046,7": "1046700000", "1,021": "1021000000", "10": "10000000", " 1.21 ": "1210000", "8 pcs": "8000000", "4.5/5": "4500000", "1.234.567": "1234567000000", "-3.5": "-3500000",
    "12 zł": "12000000", "free?": None, "2009-07-16": None, "five": None, "++": None, "nan": None, "1e99": None, "": None, "-": None, "9 9": None, "5 / 5": "5000000", "9" * 40: None,
}
DATES = {
    "2012-05-06": "2012-05-06", "2012/5/6": "2012-05-06", "06.05.2012": "2012-05-06", "20120506": "2012-05-06", "1230903219693": "2009-01-02", "2009-01-01T20:53:46Z": "2009-01-01",
    "2009-01-01T23:53:46-02:00": "2009-01-02", "1 Oct 2013": "2013-10-01", "12 march 2011": "2011-03-12", "Mar 2, 2011": "2011-03-02", "2012-02-30": None, "soon": None, "121.07": None, "2012": None, "31.31.2012": None, "1 Foo 2013": None,
}


@pytest.mark.parametrize("key, cases", [("price", NUMBERS), ("Released On", DATES)])
def test_typed(spark, key, cases):
    got = cells(spark, [(key, v) for v in cases])
    attr = wide_name = key.lower().replace(" ", "_")
    assert [None if g is None else g[1] for g in got] == list(cases.values())
    assert {g[0] for g in got if g} == {attr} == {wide_name}


def test_booleans_strings_and_names(spark):
    pairs = [("inStock", "YES"), ("In-Stock ", "0"), ("IN STOCK", "maybe"), ("maker", "  Lumo Oy\t"), ("HTTPCode2Name", "N/a"), ("HTTPCode2Name", "v"), ("  ", "v"), (None, "v"), ("---", "v"), ("id", "5"), ("maker", " ?　"), ("maker", "x" * 100_000)]
    got = cells(spark, pairs)
    assert got[:7] == [("in_stock", "true"), ("in_stock", "false"), None, ("maker", "Lumo Oy"), None, ("http_code2_name", "v"), None]
    assert got[7:11] == [None, None, ("id", "5"), None] and len(got[11][1]) == 100_000


def test_latest_wins_even_if_empty(spark):
    rows = [(1, 1, "c", "price", "1", ""), (2, 1, "c", "Price", "n/a", ""), (3, 2, "c", "price", "3", ""), (3, 2, "c", "price", "3", ""), (2, 2, "c", "price", "2", ""), (None, 2, "c", "price", "9", ""), (4, None, "c", "price", "4", "")]
    df = wide.wide_table(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["id", "price"]
    assert sorted((r.id, None if r.price is None else int(r.price)) for r in df.collect()) == [(1, None), (2, 3_000_000)]
    assert [tuple(r) for r in wide.filled_cells(df).collect()] == [(2, "price", "3000000")]


def test_empty(spark):
    df = wide.wide_table(spark.createDataFrame([], SCHEMA))
    assert df.collect() == [] and wide.filled_cells(df).columns == ["id", "attr", "cell"] and wide.filled_cells(df).collect() == []


def test_too_many_attributes(spark, monkeypatch):
    monkeypatch.setattr(wide, "MAX_COLUMNS", 2)
    with pytest.raises(ValueError):
        cells(spark, [("a", "1"), ("b", "1"), ("c", "1")])
