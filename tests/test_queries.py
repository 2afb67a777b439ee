import numpy as np
import pytest
from tests_oracle import DATA, connect, same

from tracewell.operators import features, train
from tracewell.plans import registry

NO_SQL = sorted(set(registry.QUERIES) - set(registry.SQL))


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, duck, name):
    same(duck, registry.SQL[name], registry.QUERIES[name](spark, str(DATA)))


@pytest.mark.parametrize("name", NO_SQL)
def test_query_runs(spark, name):
    df = registry.QUERIES[name](spark, str(DATA))
    assert df.columns and df.count() >= 0


def test_all_positions_are_standardised(spark):
    """Against the vectors of the tables read by hand."""
    rows = {r["candidate_id"]: r for r in spark.read.parquet(f"{DATA}/candidate_records.parquet").select("candidate_id", "distribution_features", "token_features.token_category", "step_features.step_type", "normalized_position").collect()}
    number = lambda v: 0.0 if v is None or v != v else float(v)
    vectors = []
    for r in rows.values():
        d, p = r["distribution_features"].asDict() if r["distribution_features"] else {}, r["normalized_position"] or 0.0
        b = "early" if p < 0.33 else "middle" if p < 0.66 else "late"
        kinds = [(features.TOKEN_CATEGORIES, r["token_category"] or "other"), (features.STEP_TYPES, r["step_type"] or "other"), (features.BUCKETS, b)]
        vectors.append([*[number(d.get(n)) for n in features.NUMERIC[:-1]], number(p), number(d.get("top1_match")), *[float(k == v) for names, v in kinds for k in names]])
    x = np.array(vectors)
    scale = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(scale == 0, 1.0, scale)
    got = {(r["candidate_id"], r["i"]): r["v"] for r in registry.QUERIES["ML-03_all_standardised_vectors"](spark, str(DATA)).collect()}
    assert len(got) == z.size and z.shape[1] == 33
    assert all(abs(got[c, i] - v) < 2e-6 * max(1.0, abs(v)) for c, row in zip(rows, z, strict=True) for i, v in enumerate(row))


def test_trainer_standardises_by_all_rows(spark):
    c = spark.read.parquet(f"{DATA}/candidate_records.parquet").dropDuplicates(["candidate_id"])
    few = train.train_linear(c, max_records=50, epochs=1)
    assert few["training"]["records"] == 50 < c.count()
    x = np.stack([r["x"] for r in train.features_and_labels(c, "rule", 0.4, "candidate_id").select("x").collect()])
    assert np.allclose(few["standardization"]["means"], x.mean(axis=0))
    assert np.allclose(few["standardization"]["scales"], np.where(x.std(axis=0) == 0, 1.0, x.std(axis=0)))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
