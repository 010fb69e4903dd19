"""The strict and the held-out decision rules on planted result tables."""

from tidewire.operators import testing

GRID = "window string, target string, freq string, survives_bh boolean"
CELL = ["window", "target", "freq"]


def passed(df):
    return {r["rule"]: r["pass"] for r in df.collect()}


def strict(spark, survivors, coefs):
    cells = [(w, t, f) for w in ("R", "E17", "E25", "all") for t in ("T1", "T2", "X") for f in "DW"]
    grid = spark.createDataFrame([(*c, c in survivors) for c in cells], GRID)
    terms = spark.createDataFrame([(*c, k, v) for c, k, v in coefs], "window string, target string, freq string, term string, coef double")
    return passed(testing.strict_rules(grid, terms, CELL, "R", ["T1", "T2"], ["R", "E17", "E25"]))


def test_strict_arms(spark):
    a, b, c = ("R", "T1", "D"), ("E17", "X", "D"), ("E25", "T2", "W")
    assert strict(spark, {a}, [])["overall"]  # arm 1 alone
    assert not strict(spark, {("R", "X", "D"), ("all", "T1", "D")}, [])["overall"]
    same = [(b, "thr_UA", 0.2), (c, "thr_UA", 0.1), (b, "act_UA", -1.0), (c, "act_UA", 1.0)]
    got = strict(spark, {b, c}, same)
    assert got["overall"] and not got["arm 1: survivor on a qualifying target"] and got["arm 2: a term of one sign in them"]
    assert not strict(spark, {b, c}, [(b, "thr_UA", 0.2), (c, "thr_UA", -0.1)])["overall"]
    # A third surviving cell of the other sign breaks the agreement; a cell that did not survive does not count.
    assert not strict(spark, {b, c, ("E25", "X", "D")}, [*same[:2], (("E25", "X", "D"), "thr_UA", -0.3)])["overall"]
    assert strict(spark, {b, c}, [*same[:2], (("E25", "X", "D"), "thr_UA", -0.3)])["overall"]
    assert not strict(spark, {b, ("E17", "T1", "W")}, [(b, "thr_UA", 0.2), (("E17", "T1", "W"), "thr_UA", 0.1)])["overall"]  # one window


def test_holdout_conditions(spark):
    def run(survives=(True, True), placebo=(0.5, 0.21), own=(0.01, 0.049), horizons=(1, 5)):
        grid = spark.createDataFrame(list(zip(horizons, survives)), "horizon int, survives_bh boolean")
        p, d = (spark.createDataFrame(list(zip(horizons, v)), "horizon int, p_local double") for v in (placebo, own))
        return passed(testing.holdout_rules(grid, p, d, (1, 5)))

    assert all(run().values())
    for bad in ({"survives": (True, False)}, {"placebo": (0.5, 0.20)}, {"own": (0.01, 0.05)}, {"own": (None, 0.01)},
                {"survives": (None, True)}):
        got = run(**bad)
        assert not got["overall"] and sum(got.values()) == 2
    assert not any(run(survives=(True,), placebo=(0.5,), own=(0.01,), horizons=(1,)).values())
