import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from earshot.operators import blocks as B
from earshot.operators import ordered as O


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds a third of the rows, one key is NULL."""
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "t": rng.integers(0, 5000, n), "v": np.round(rng.uniform(0, 100, n), 2)})
    pdf["k"] = [(-1 if i % 3 == 0 else (None if i % 50 == 1 else i % 17)) for i in range(n)]
    df = spark.createDataFrame([(int(r.id), int(r.t), float(r.v), None if pd.isna(r.k) else int(r.k)) for r in pdf.itertuples()], "id long, t long, v double, k long")
    return df, pdf.sort_values(["t", "id"])


ORDER = ["t", "id"]


def block():
    return F.floor(F.col("t") / 97)


def by_id(df, *cols):
    pdf = df.select("id", *cols).toPandas().set_index("id").sort_index()
    assert pdf.index.is_unique
    return pdf


def test_running_and_index(hot):
    df, pdf = hot
    got = by_id(B.row_index(B.running(df, ["k"], ORDER, block(), s=("sum", "v"), m=("max", "v")), ["k"], ORDER, block()), "s", "m", "rn")
    g = pdf.groupby("k", dropna=False).v
    want = pd.DataFrame({"id": pdf.id, "s": g.cumsum(), "m": g.cummax(), "rn": g.cumcount() + 1}).set_index("id").sort_index()
    assert np.allclose(got.s, want.s) and (got.m == want.m).all() and (got.rn == want.rn).all()


def test_exclusive_and_lag(hot):
    df, pdf = hot
    got = by_id(B.lagged(B.running(df, ["k"], ORDER, block(), exclusive=True, m=("max", "v")), ["k"], ORDER, block(), p="v"), "m", "p")
    g = pdf.groupby("k", dropna=False).v
    want = pd.DataFrame({"id": pdf.id, "m": g.cummax().groupby(pdf.k, dropna=False).shift(1), "p": g.shift(1)}).set_index("id").sort_index()
    assert (got.m.fillna(-1) == want.m.fillna(-1)).all() and (got.p.fillna(-1) == want.p.fillna(-1)).all()


def test_no_key_at_all(hot):
    df, pdf = hot
    got = by_id(B.row_index(df, [], ORDER, block()), "rn")
    want = pd.Series(np.arange(1, len(pdf) + 1), index=pdf.id).sort_index()
    assert (got.rn == want).all()


def test_last_rows_and_span(hot):
    df, pdf = hot
    got = by_id(B.last_rows(df, ["k"], ORDER, block(), 60, size=64, a=(F.avg, "v"), m=(F.max, "v")), "a", "m")
    roll = pdf.groupby("k", dropna=False).v.rolling(60, min_periods=1)
    want = pd.DataFrame({"a": roll.mean().droplevel(0), "m": roll.max().droplevel(0)})
    want.index = pdf.loc[want.index, "id"]
    want = want.sort_index()
    assert np.allclose(got.a, want.a) and np.allclose(got.m, want.m)


def replay(pdf, start, step):
    state, out = {}, {}
    for i, k, v in zip(pdf.id, pdf.k.fillna(-99), pdf.v):
        state[k] = step(state.get(k, start), v)
        out[i] = state[k]
    return pd.Series(out).sort_index()


def test_risk_average_is_exact(hot):
    df, pdf = hot
    want = replay(pdf, 5.0, lambda x, v: max(x, v) if v >= 60 else (0.45 * v + 0.55 * x if v < 30 else 0.35 * v + 0.65 * x))
    pieces = lambda v: O.risk_ema_pieces(v)
    got = by_id(B.fold_max_affine(df, ["k"], ORDER, block(), "v", 5.0, pieces, "x", size=16, fanout=8), "x")
    assert np.abs(got.x - want).max() < 1e-9


def test_asymmetric_average_is_exact(hot):
    df, pdf = hot
    step = lambda x, v: (0.7 if v / 100 > x else 0.35) * (v / 100) + (0.3 if v / 100 > x else 0.65) * x
    got = by_id(O.remote_prob_ema(df, ["k"], ORDER, block(), F.col("v") / 100), "ema_prob")
    assert np.abs(got.ema_prob - replay(pdf, 0.08, step)).max() < 1e-12


def test_null_values_leave_the_state_as_it_was_at_any_block_size(hot):
    df, pdf = hot
    df = df.withColumn("v", F.when(F.col("id") % 7 != 3, F.col("v")))
    pdf = pdf.assign(v=pdf.v.where(pdf.id % 7 != 3))
    risk = lambda x, v: x if pd.isna(v) else max(x, v) if v >= 60 else (0.45 * v + 0.55 * x if v < 30 else 0.35 * v + 0.65 * x)
    prob = lambda x, v: x if pd.isna(v) else (0.7 if v / 100 > x else 0.35) * (v / 100) + (0.3 if v / 100 > x else 0.65) * x
    want_risk, want_prob = replay(pdf, 5.0, risk), replay(pdf, 0.08, prob)
    step = lambda x, v: F.when(v > x, v * 0.70 + x * (1.0 - 0.70)).otherwise(v * 0.35 + x * (1.0 - 0.35))
    for size in (16, 256):
        got = by_id(B.fold_max_affine(df, ["k"], ORDER, block(), "v", 5.0, O.risk_ema_pieces, "x", size=size, fanout=8), "x")
        assert np.abs(got.x - want_risk).max() < 1e-9
    for size in (128, 512):
        got = by_id(B.fold_contracting(df, ["k"], ORDER, block(), F.col("v") / 100, 0.08, step, "x", size=size), "x")
        assert np.abs(got.x - want_prob).max() < 1e-12


def test_a_scan_shuffles_its_rows_once(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(1000).selectExpr("id % 3 AS k", "id AS t", "repeat('w', 50) AS wide").write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = B.running(spark.read.parquet(path), ["k"], ["t"], F.floor(F.col("t") / 97), s=("sum", "t"))
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        wide = [line for line in plan.split("+- == Initial Plan")[0].splitlines() if "Exchange hashpartitioning" in line]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the rows once; the block totals by block, by key, and again by block for the join
    assert len(wide) == 4, plan


def test_interval_merge_edges(spark):
    rows = [(1, 1000, 2000), (1, 2490, 3000), (1, 3491, 4000), (2, 0, 100)]
    df = spark.createDataFrame(rows, "k int, s long, e long")
    got = O.merge_intervals(df, ["k"], "s", "e", 120, 250, F.floor(F.col("__s") / 1000)).orderBy("k", "s").collect()
    # gap exactly 250 after padding joins, one more does not
    assert [(r.k, r.s, r.e, r.parts) for r in got] == [(1, 880, 3120, 2), (1, 3371, 4120, 1), (2, 0, 220, 1)]


def test_windows(spark):
    df = spark.createDataFrame([(1, 100), (2, 48000), (3, 80000), (4, 56000), (5, 200000)], "c int, n_samples long")
    got = {c: [r.start_sample for r in g] for c, g in _group(O.sliding_windows(df).orderBy("c", "win_idx").collect())}
    assert got == {1: [0], 2: [0], 3: [0, 16000, 32000], 4: [0], 5: list(range(0, 152001, 16000))}
    strategic = {c: [r.start_sample for r in g] for c, g in _group(O.strategic_windows(df).orderBy("c", "win_idx").collect())}
    assert strategic == {3: [0, 8000, 16000, 24000, 32000], 4: [0, 2000, 4000, 6000, 8000], 5: [0, 38000, 76000, 114000, 152000]}


def _group(rows):
    out = {}
    for r in rows:
        out.setdefault(r.c, []).append(r)
    return out.items()
