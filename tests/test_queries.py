import pytest
from oracle import connect, expected, rows_of

from tidegate.operators import search
from tidegate.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF)) == expected(duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["em_fit", "grid_search", "real_evaluation"])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == QUERIES["flagship"](spark, SF).columns


def test_registered_fits_converge(spark):
    rows = QUERIES["em_fit"](spark, SF).collect()
    assert len(rows) == 5 and all(r["converged"] for r in rows) and max(r["n_iter"] for r in rows) > 100


def test_search_models_covers_the_whole_grid(spark, monkeypatch):
    asked = {}

    def record(prices, truth, models, kind, grid, **more):
        asked.update(models=models, kind=kind, grid=grid, more=more)
        return spark.createDataFrame([(1, [1])], "rank int, alarms array<bigint>")

    monkeypatch.setattr(search, "search_models", record)
    QUERIES["search_models"](spark, SF)
    assert asked == {"models": search.model_grid(), "kind": "surprise", "grid": search.REAL_GRIDS["surprise"], "more": {}}
    assert len(asked["models"]) * len(asked["grid"].points()) == 1280
