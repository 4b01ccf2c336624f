"""Regressions, currencies, vintages and refusals against plain numpy or by hand."""

import datetime
import json
import math
import random

import numpy as np
import pytest

from tidemark.operators import econ, inference, refusals, vintages


def months(n, first=1995 * 12):
    return [f"{(first + i) // 12}-{(first + i) % 12 + 1:02d}" for i in range(n)]


def plain_regression(x, y, lags):
    """Slope and sandwich error from the residuals, by the matrix form."""
    a = np.column_stack([np.ones(len(x)), x])
    inverse = np.linalg.inv(a.T @ a)
    beta = inverse @ a.T @ y
    score = a * (y - a @ beta)[:, None]
    meat = score.T @ score
    for k in range(1, min(lags, len(x) - 1) + 1):
        g = score[k:].T @ score[:-k]
        meat = meat + (1 - k / (lags + 1)) * (g + g.T)
    return beta[1], math.sqrt((inverse @ meat @ inverse)[1, 1])


def test_sandwich_errors_against_the_matrix_form(spark):
    r = np.random.default_rng(3)
    rows, want = [], {}
    for asset in ("A", "B"):
        for h in (1, 3, 6, 12):
            x = np.cumsum(r.normal(size=60)) / 3
            y = 0.2 * x + np.convolve(r.normal(size=60 + h - 1), np.ones(h), "valid")
            rows += [("s", "c", asset, h, "train", m, float(a), float(b)) for m, a, b in zip(months(60), x, y, strict=True)]
            want[asset, h] = plain_regression(x, y, h)
    rows += [("s", "c", "FLAT", 1, "train", m, 1.0, float(i)) for i, m in enumerate(months(20))]
    rows += [("s", "c", "SHORT", 1, "train", m, float(i), float(i * i)) for i, m in enumerate(months(7))]
    df = spark.createDataFrame(rows, "scenario string, channel string, asset string, horizon int, sample string, month string, x double, y double")
    got = {(g.asset, g.horizon): g for g in inference.regressions(df).collect()}
    for key, (beta, se) in want.items():
        assert got[key].beta == pytest.approx(beta) and got[key].se == pytest.approx(se) and got[key].n == 60
        assert got[key].p == pytest.approx(math.erfc(abs(beta / se) / math.sqrt(2)), abs=2e-7)
    assert got["FLAT", 1].beta is None and got["FLAT", 1].p is None
    assert got["SHORT", 1].beta is not None and got["SHORT", 1].t is None
    longer = {g.horizon: g.se for g in inference.regressions(df.where("asset = 'A'"), lags={1: 4, 3: 5, 6: 6, 12: 12}).collect()}
    a = [(q[6], q[7]) for q in rows if q[2] == "A" and q[3] == 3]
    assert longer[3] == pytest.approx(plain_regression(*np.array(a).T, 5)[1])


def test_matrix_counts_support_and_reversal(spark):
    rows = [("1.0", "c", a, 1, s, 30, b, 1.0, b / 1.0, p) for a, s, b, p in [
        ("UP", "train", 2.0, 0.001), ("UP", "holdout", 1.0, 0.001), ("DOWN", "train", 2.0, 0.001), ("DOWN", "holdout", -1.0, 0.001),
        ("WEAK", "train", 2.0, 0.2), ("WEAK", "holdout", 1.0, 0.5), ("GONE", "train", 1.0, 0.1), ("GONE", "holdout", 1.0, None),
    ]]
    found = spark.createDataFrame(rows, "scenario string, channel string, asset string, horizon int, sample string, n long, beta double, se double, t double, p double")
    outcomes = inference.matrix(found)
    assert {r.asset: (r.outcome, r.same_direction) for r in outcomes.collect()} == {"UP": ("SUPPORTED", True), "DOWN": ("REVERSED", False), "WEAK": ("NOT_SIGNIFICANT", True)}
    assert [tuple(r) for r in inference.summary(outcomes).collect()] == [("1.0", 3, 2, 1, 1)]


def test_growth_is_neutral_to_constant_rates_only(spark):
    ms, r = months(30), random.Random(5)
    levels = spark.createDataFrame([(s, m, 100.0 + 10 * r.random()) for s in "AB" for m in ms], "series string, month string, value double")
    constant = spark.createDataFrame([("A", ms[0], 1.0), ("B", ms[0], 0.5)], "series string, month string, rate double")
    moving = constant.union(spark.createDataFrame([("B", m, 0.5 + i / 100) for i, m in enumerate(ms) if i % 3 == 1], constant.schema))
    for rates, still in ((constant, True), (moving, False)):
        money = econ.in_dollars(levels, rates)
        assert money.count() == 60
        out = econ.weighted_growth(econ.growth(money), econ.money_weights(money.select("series", "month", money.usd.alias("value")))).collect()
        assert len(out) == 18 and all((abs(x.fx_effect) < 1e-9) == still for x in out)
    last = {x.month: x.rate for x in econ.in_dollars(levels, moving).where("series = 'B'").collect()}
    assert last[ms[3]] == last[ms[1]] == 0.51 and last[ms[4]] == 0.54
    assert econ.in_dollars(levels, moving.where("series = 'B' AND month > '1996-01'")).where("month <= '1996-01'").count() == 0


def test_stress_moves_weights_and_not_growth(spark):
    ms = months(40)
    r = random.Random(6)
    money = spark.createDataFrame([(s, m, 100.0 + r.random() * 20, 1.0) for s in "AB" for m in ms], "series string, month string, value double, rate double")
    both = econ.in_dollars(money.select("series", "month", "value"), money.select("series", "month", "rate"))
    z = inference.channels(both, "A", least=6)
    rows = {(x.scenario, x.channel, x.month): x.x for x in z.collect()}
    assert {k[0] for k in rows} == {0.85, 1.0, 1.15} and len(rows) == 3 * 2 * (28 - 5)
    assert max(k[2] for k in rows) == "1998-05"  # published a month later
    assert any(abs(rows[0.85, c, m] - rows[1.15, c, m]) > 1e-4 for s, c, m in rows if s == 1.0)


def plain_known(asks, releases):
    out = []
    for s, d in asks:
        mine = [(m, p, v, c) for q, m, p, v, c in releases if q == s and p <= d]
        top = lambda xs: max(((m, p, v) for m, p, v, _ in xs), default=(None, None, None))
        core, candidate = top([x for x in mine if x[3]]), top(mine)
        out.append((s, d, *core, *candidate, candidate[0] is not None and (core[0] is None or candidate > core)))
    return sorted(out, key=repr)


def test_vintages_against_brute_force(spark):
    r = random.Random(7)
    day = lambda: datetime.date(2000, 1, 1) + datetime.timedelta(days=r.randrange(1200))
    releases = [(r.randrange(3), f"200{r.randrange(3)}-{r.randint(1, 12):02d}", day(), float(r.randrange(4)), r.random() < 0.4) for _ in range(300)]
    releases += releases[:5]
    asks = [(r.randrange(4), day()) for _ in range(200)] + [(0, releases[0][2])] * 2
    rel = spark.createDataFrame([*releases, (None, "2000-01", day(), 1.0, True), (1, None, day(), 1.0, True), (1, "2009-01", None, 1.0, True)], "series int, month string, published date, value double, promoted boolean")
    got = vintages.known_at(spark.createDataFrame([*asks, (None, day()), (1, None)], "series int, date date"), rel).collect()
    assert sorted((tuple(x) for x in got), key=repr) == plain_known(asks, releases)
    assert all(x.candidate_published is None or x.candidate_published <= x.date for x in got)
    assert vintages.known_at(spark.createDataFrame([], "series int, date date"), rel).count() == 0
    assert vintages.known_at(spark.createDataFrame(asks, "series int, date date"), rel.limit(0)).where("candidate_month IS NULL AND NOT ahead").count() == len(asks)


def chart(n, adjusted=True):
    stamps = [int(datetime.datetime(2000 + i // 12, i % 12 + 1, 15, tzinfo=datetime.UTC).timestamp()) for i in range(n)]
    values = [float(i) for i in range(n)]
    return json.dumps({"chart": {"result": [{"timestamp": stamps, "indicators": ({"adjclose": [{"adjclose": values}]} if adjusted else {}) | {"quote": [{"close": values}]}}]}})


def test_refused_charts_and_their_errors(spark):
    texts = spark.createDataFrame([("OK", chart(14)), ("CLOSE", chart(13, False)), ("SHORT", chart(11)), ("BAD", "{"), ("NONE", None), ("EMPTY", '{"chart": {"result": []}}')], "asset string, text string")
    rows, bad = refusals.price_charts(texts, "2002-01-15")
    assert {r.asset for r in rows.collect()} == {"OK", "CLOSE"}
    errors = {r.asset: r.error for r in refusals.with_errors(texts.select("asset"), bad, "asset", "price").collect()}
    none = "no price chart in the text"
    assert errors == {"OK": None, "CLOSE": None, "SHORT": "insufficient price history: 11 of 12 completed months", "BAD": none, "NONE": none, "EMPTY": none}


def test_refused_surveys_and_files(spark):
    body = lambda status, values, message=None: json.dumps({"STATUS": status, "MESSAGE": message, "RESULTSET": [{"VALUES": values}]})
    good = {"SURVEY_DATES": ["200001", "200002", "junk"], "VALUES": ["1", ".", "3"]}
    texts = spark.createDataFrame([("a", body(200, good)), ("b", body(503, good, "x" * 900)), ("c", "no json"), ("d", json.dumps({"STATUS": 200, "RESULTSET": []}))], "file string, text string")
    rows, bad = refusals.surveys(texts)
    assert [tuple(r) for r in rows.collect()] == [("a", "2000-01", 1.0)]
    got = sorted((r.key, r.stage, r.message) for r in bad.collect())
    assert [(k, s, m[:28]) for k, s, m in got] == [
        ("a", "parse", "no month and number: 200002,"), ("a", "parse", "no month and number: junk, 3"), ("b", "status", "status 503: xxxxxxxxxxxxxxxx"), ("c", "status", "no survey in the text"), ("d", "parse", "no values in the results"),
    ]
    assert max(len(m) for *_, m in got) == refusals.MESSAGE
    lines = [("f", 0, "TIME_PERIOD,OBS_VALUE"), ("f", 1, "2000-01,1"), ("g", 0, "TIME_PERIOD,X"), ("g", 1, "2000-01,1"), ("h", 0, "A,OBS_VALUE"), ("i", 0, "TIME_PERIOD,OBS_VALUE"), ("i", 1, "?,1"), ("j", 1, "2000-01,1")]
    rows, bad = refusals.period_files(spark.createDataFrame(lines, "file string, line_no int, text string"))
    assert [r.file for r in rows.collect()] == ["f"]
    assert {r.key: r.message for r in bad.collect()} == {"g": "no column OBS_VALUE", "h": "no column TIME_PERIOD", "i": "no row with a month and a number", "j": "no header"}


def test_refused_positions_drop_nothing_else(spark):
    raw = spark.createDataFrame([("2000-01-04", "GOLD", "10", "4", "3")], "Report_Date_as_YYYY_MM_DD string, Market_and_Exchange_Names string, Open_Interest_All string, M_Money_Positions_Long_All string, M_Money_Positions_Short_All string")
    rows, bad = refusals.positions(raw, "commodity", "1999-01-01")
    assert rows.count() == 1 and bad.count() == 0
    rows, missing = refusals.positions(raw, "financial", "1999-01-01")
    assert rows.count() == 0 and [tuple(r) for r in refusals.together(bad, missing).collect()] == [("positions", "schema", "financial", "no column for long, short")]
