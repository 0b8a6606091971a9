"""Every query against the SQL it equals, on the smallest table."""

import os
from decimal import Decimal

import numpy as np
import pytest

from millwright.plans import catalogue, figures  # noqa: F401  figures registers more queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows, names):
    """Rows in one order; values are compared exactly, whatever the type of a number."""
    order = sorted(names)
    fix = lambda v: float(v) + 0.0 if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v
    return sorted(([fix(r[names.index(c)]) for c in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), names)


def test_fits_are_registered_with_the_operators_defaults(spark, monkeypatch):
    from millwright.functions.constants import WEIBULL_BOOTSTRAP
    from millwright.ml import engine
    from millwright.operators import reliability

    seen, fit, made = {}, reliability.weibull_by_asset, engine.Engine.__init__
    monkeypatch.setattr(reliability, "weibull_by_asset", lambda *a, **k: seen.update(k) or fit(*a, **k))
    monkeypatch.setattr(engine.Engine, "__init__", lambda self, *a, **k: seen.update(k) or made(self, *a, **k))
    assert catalogue.queries()["weibull_fit"](spark, SF).count() > 0
    assert catalogue.queries()["model_predictions"](spark, SF).count() > 0
    assert seen.get("n_bootstrap", WEIBULL_BOOTSTRAP) == WEIBULL_BOOTSTRAP and seen.get("time_budget", 30) == 30 and seen.get("estimators") is None


def test_entry_and_unchecked_queries(spark):
    assert catalogue.flagship(spark, SF).count() > 0
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, SF).count() > 0


def test_gauge_study_does_not_depend_on_the_order_of_repeated_lines(spark, tmp_path):
    rng = np.random.default_rng(4)
    cells = {(f"B{b}", f): sorted(zip(rng.integers(0, 2, 40).tolist(), rng.integers(0, 2, 40).tolist(), rng.integers(1, 50, 40).astype(float).tolist())) for b in range(3) for f in "AN"}
    lines = [(o, k, int(brand[1:]), flag, q) for (brand, flag), rows in cells.items() for o, k, q in rows]
    chosen = {c: [q for _, _, q in rows[:3]] for c, rows in cells.items()}
    mean = np.mean([q for qs in chosen.values() for q in qs])
    total = sum((q - mean) ** 2 for qs in chosen.values() for q in qs)
    within = sum(3 * (np.mean(qs) - mean) ** 2 for qs in chosen.values())
    spark.createDataFrame([(b, f"B{b}") for b in range(3)], "p_partkey long, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for i in range(3):
        sf = tmp_path if not i else tmp_path / str(i)
        rows = [lines[j] for j in rng.permutation(len(lines))]
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_returnflag string, l_quantity double").coalesce(1).write.parquet(str(sf / "lineitem.parquet"))
        if i:
            os.symlink(tmp_path / "part.parquet", sf / "part.parquet")
        got = catalogue.queries()["gauge_rr_components"](spark, str(sf)).first()
        assert got["total"] == 18 and got["cells"] == 6
        assert got["ss_total"] == pytest.approx(total, abs=1e-3) and got["ss_cells"] == pytest.approx(within, abs=1e-3)
