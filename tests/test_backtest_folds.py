import os

import pytest

from tidemark.operators import labels as L
from tidemark.plans import catalog, models

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_fold_is_scored(spark):
    rows = models.panel(spark, SF).groupBy("y").count().collect()
    tests = [t for _, t, _ in L.rolling_folds([r.y for r in rows], [2], 2)]
    assert len(tests) > 2
    got = catalog.QUERIES["ML1_backtest"](spark, SF).groupBy("test_year").count().collect()
    assert {r.test_year: r["count"] for r in got} == {r.y: r["count"] for r in rows if r.y in tests}
