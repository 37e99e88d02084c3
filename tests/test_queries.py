"""Every registered query beside its SQL."""

import pytest
from harness import differences, duck

from funnelspark.plans import audit, classifier, fits  # noqa: F401  register their queries
from funnelspark.plans.catalogue import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"q_hmm", "q_logit"}))
def test_other_queries_have_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_hmm_query_fits_until_it_converges(spark, sf, monkeypatch):
    from funnelspark.operators import models

    seen = {}

    def fit(self, sequences, col="seq", rounds=50, tol=1e-4):
        seen.update(rounds=rounds, tol=tol, seqs=sequences)
        return self

    with monkeypatch.context() as m:
        m.setattr(models.Hmm, "fit", fit)
        rows = QUERIES["q_hmm"](spark, sf).collect()
    assert seen["rounds"] == 50 and seen["tol"] == 1e-4
    assert len(rows) == seen["seqs"].count() > 0
    sizes = {r.session_id: r.n for r in seen["seqs"].selectExpr("session_id", "size(seq) AS n").collect()}
    assert all(len(r.path.split(">")) == sizes[r.session_id] for r in rows)
