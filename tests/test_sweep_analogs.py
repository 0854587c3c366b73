"""Statistics, folds, the sweep, analog queries, sentences and health, with hand-computed vectors."""

from __future__ import annotations

import math
import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.functions import moments, stats
from tidelane.plans import analogs, health, sweep

D = date(2016, 1, 2)


def tails(spark, rows):
    df = spark.createDataFrame([(float(t), float(n)) for t, n in rows], "t double, df double").repartition(2)
    got = {(r.t, r.df): r.p for r in df.select("t", "df", stats.two_tailed_p(F.col("t"), F.col("df")).alias("p")).collect()}
    return [got[float(t), float(n)] for t, n in rows]


def test_t_tail_where_it_has_a_closed_form(spark):
    """One, two and four degrees of freedom, far out in the tail too."""
    closed = {1: lambda t: 1 - 2 / math.pi * math.atan(t), 2: lambda t: 1 - t / math.sqrt(2 + t * t), 4: lambda t: 1 - t / math.sqrt(4 + t * t) * (1 + 2 / (4 + t * t))}
    rows = [(t, df) for t in (0.0, 0.05, 0.3, 1.0, 2.5, 7.0, 40.0, 1e4) for df in closed]
    assert tails(spark, rows) == [pytest.approx(closed[df](t), rel=1e-6, abs=1e-9) for t, df in rows]


def test_t_tail_falls_with_fractional_degrees(spark):
    p = np.array(tails(spark, [(2.0, df) for df in (2.0, 2.7, 3.5, 11.25, 31.33, 400.0, 1e5, 1e7)]))
    assert (np.diff(p) < 0).all() and p[0] < 0.2
    # DLMF 26.2: the normal tail in the limit, off by (t + t**3) * density / (2 df)
    assert p[-1] == pytest.approx(math.erfc(2 / math.sqrt(2)), abs=1e-7) and math.erfc(2 / math.sqrt(2)) < p[-1]


def test_log_gamma(spark):
    z = [1e-6, 0.3, 0.5, 1.0, 2.0, 7.25, 31.0, 1234.5, 1e7]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", stats.log_gamma(F.col("z")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.z), rel=1e-13, abs=1e-13) for r in got)


def test_correlation_and_p(spark):
    rows = spark.createDataFrame([(float(i), float(2 * i), 1.0) for i in range(10)], "x double, y double, c double")
    out = rows.agg(stats.pearson("x", "y").alias("r"), stats.pearson("x", "c").alias("k")).first()
    assert out.r == 1.0 and out.k is None
    p = spark.createDataFrame([(1.0, 10.0), (0.5, 2.0), (0.5, None), (0.5, 30.0), (None, 30.0)], "r double, n double").select(stats.p_value(F.col("r"), F.col("n")).alias("p")).collect()
    assert p[0].p == 0.0 and p[1].p is None and p[2].p is None and p[3].p == pytest.approx(0.00489, abs=1e-4) and p[4].p is None


def test_effective_n(spark):
    rows = spark.createDataFrame([(7,), (14,), (21,), (1,)], "h int").select(stats.effective_n(F.lit(100), F.col("h")).alias("n"))
    assert [r.n for r in rows.collect()] == [100, 50, pytest.approx(100 / 3), 100]


def test_benjamini_hochberg_against_a_loop(spark):
    """Ties, zeros, ones, unknown p and p far below the widest range, in two runs."""
    r = np.random.default_rng(3)
    rows = [("a", float(p)) for p in r.random(300).round(2)] + [("b", float(p)) for p in 10.0 ** -(r.random(200) * 40)] + [("a", 0.0), ("a", 1.0), ("a", None), ("b", None), ("b", 0.0), ("b", 1 / 256)]
    df = spark.createDataFrame(rows, "run string, p_value double").repartition(5)
    for run in "ab":
        known = sorted(p for k, p in rows if k == run and p is not None)
        m = len(known)
        want = {p: min(1.0, min(x * m / sum(y <= x for y in known) for x in known if x >= p)) for p in known}
        out = stats.benjamini_hochberg(df, ["run"]).where(F.col("run") == run).collect()
        assert len(out) == sum(k == run for k, _ in rows)
        assert all(o.q_value is None and o.n_tests_adjusted is None if o.p_value is None else o.q_value == pytest.approx(want[o.p_value]) and o.n_tests_adjusted == m for o in out)


@pytest.mark.parametrize("full, folds, expected", [(0.4, [0.1, 0.5, -0.2, 0.3, 0.6], (0.8, 5)), (0.4, [0.1, 0.2, 0.3, 0.4, 0.0], (0.8, 5)), (0.4, [0.1, 0.2, 0.3, 0.4, None], (1.0, 4)), (0.0, [0.1], (None, None)), (None, [0.1], (None, None))])
def test_directional_consistency(spark, full, folds, expected):
    rows = spark.createDataFrame([(full, folds)], "full double, folds array<double>")
    share, n = stats.directional_consistency(F.col("full"), F.col("folds"))
    assert tuple(rows.select(share.alias("a"), n.alias("b")).first()) == expected


def test_moments_merge_to_those_of_all_rows(spark):
    r = random.Random(8)
    rows = [(i % 7 if i % 7 < 5 else 4, 1e3 + r.random(), r.choice([1e-3 * i + r.random(), -5.0])) for i in range(300)] + [(9, 1e3, 2.0)]
    df = spark.createDataFrame(rows, "block int, x double, y double").repartition(5)
    blocks = df.groupBy("block").agg(moments.moments(F.collect_list(F.struct("x", "y"))).alias("m"))
    m = blocks.agg(moments.merged(F.collect_list("m")).alias("m")).select("m.*", moments.correlation(F.col("m")).alias("r")).first()
    both = np.array([(x, y) for _, x, y in rows])
    assert m.n == 301 and m.r == pytest.approx(np.corrcoef(both.T)[0, 1], rel=1e-7)
    assert m.xx == pytest.approx((both[:, 0] ** 2).sum()) and (m.y0, m.y1) == (both[:, 1].min(), both[:, 1].max())
    few = lambda where: blocks.where(where).agg(moments.merged(F.collect_list("m")).alias("m")).select("m.n", moments.correlation(F.col("m")).alias("r")).first()
    assert tuple(few("block = 9")) == (1, None) and tuple(few("false")) == (0, None)


def test_pair_moments_are_those_of_aligned_rows(spark):
    """Against the aligned rows, one by one, with their folds by a window of each pair."""
    r = random.Random(3)
    rows = [("f", s, D + timedelta(days=i), None if r.random() < 0.1 else float(r.randint(0, 6))) for s in ("a", "b") for i in range(0, 700) if r.random() < 0.8]
    weekly = [(D + timedelta(days=7 * i + 3), h, None if r.random() < 0.2 else r.random()) for i in range(110) for h in (7, 21)]
    series = spark.createDataFrame(rows, "feature_name string, site_id string, date date, value double")
    targets = spark.createDataFrame(weekly, "week_ending date, horizon_days int, value double")
    pairs = sweep.pair_moments(series, targets, [-8, 0, 3], (7, 21)).select(*sweep.PAIR, F.inline("blocks")).collect()
    each = sweep.with_folds(sweep.align(series, targets, [-8, 0, 3]), sweep.PAIR, "week", F.col("horizon_days"), (7, 21)).collect()
    want = {}
    for e in each:
        want.setdefault((*(e[k] for k in sweep.PAIR), e.fold), []).append((e.x, e.y))
    assert {(*(p[k] for k in sweep.PAIR), p.fold): p.m.n for p in pairs} == {k: len(v) for k, v in want.items()}
    assert {k[-1] for k in want} == {None, 0, 1, 2, 3, 4}
    for p in pairs:
        xy = np.array(want[(*(p[k] for k in sweep.PAIR), p.fold)])
        about = p.m.xy - p.m.sx * p.m.sy / p.m.n  # x is about the series' mean, which the product of deviations does not show
        assert (p.m.sy, about) == (pytest.approx(xy[:, 1].sum()), pytest.approx(np.cov(xy.T, bias=True)[0, 1] * len(xy), abs=1e-9))


@pytest.mark.parametrize("n, h, expected", [(20, 14, 0), (29, 7, 0), (200, 7, 5)])
def test_folds(spark, n, h, expected):
    rows = spark.createDataFrame([("k", h, D + timedelta(days=7 * i)) for i in range(n)], "k string, horizon_days int, week date")
    out = sweep.folds(rows, ["k", "horizon_days"], "week", "horizon_days", (7, 14, 21)).orderBy("fold").collect()
    assert len(out) == expected
    if out:
        assert out[-1].test_end == D + timedelta(days=7 * (n - 1)) and out[0].n_train >= 26
        assert sweep.leaking(sweep.folds(rows, ["k", "horizon_days"], "week", "horizon_days", (7,)), F.col("horizon_days")).isEmpty()
        assert all(a.train_end + timedelta(days=h) < a.test_start for a in out)


def test_too_few_testable_weeks_give_no_fold(spark):
    rows = spark.createDataFrame([("k", 7, D + timedelta(days=7 * i)) for i in range(31)], "k string, horizon_days int, week date")
    marked = sweep.with_folds(rows, ["k", "horizon_days"], "week", F.col("horizon_days"), (7, 14, 21))
    assert marked.where("fold IS NOT NULL").count() == 0


def test_sweep_writes_every_cell(spark):
    rows = []
    for site, phase in (("s1", 0), ("s2", 11)):
        for i in range(900):
            day = D + timedelta(days=i)
            rows.append((day, site, "days_below_p10", float((i + phase) % 40), None, None))
            rows.append((day, site, "discharge_mean", float(i % 17), float((i + phase) % 23 - 11), 9))
    features = spark.createDataFrame(rows, "date date, site_id string, feature_name string, value double, anomaly double, climatology_n_years int")
    weekly = [(D + timedelta(days=7 * i), h, (13 * i) % 29 / 100 - 0.14) for i in range(125) for h in (7, 14)]
    targets = spark.createDataFrame(weekly, "week_ending date, horizon_days int, value double")
    sites = spark.createDataFrame([("s1",), ("s2",), ("silent",)], "site_id string")
    out = sweep.sweep(features, targets, sites, ["days_below_p10", "discharge_mean"], sweep.lag_axis(-1, 1), 5, (7, 14)).toPandas()
    assert len(out) == 3 * 2 * 2 * 3 * 3
    assert set(out[out.site_id == "silent"].status) == {"insufficient_observations"}
    assert set(out[(out.feature_name == "discharge_mean") & (out.site_id != "silent")].series_column) == {"anomaly"}
    known = out[out.p_value.notna()]
    assert (known.q_value.notna()).all() and (known.q_value >= known.p_value - 1e-12).all() and set(out.n_tests_adjusted) == {len(known)}
    # one cell by hand: no lag, all days
    x = [float((7 * i) % 40) for i in range(125)]
    y = [(13 * i) % 29 / 100 - 0.14 for i in range(125)]
    cell = out[(out.site_id == "s1") & (out.feature_name == "days_below_p10") & (out.lag_days == 0) & (out.regime == "all") & (out.horizon_days == 7)].iloc[0]
    assert cell.statistic == pytest.approx(np.corrcoef(x, y)[0, 1]) and cell.n_observations == 125 and cell.folds == 5
    with pytest.raises(ValueError):
        sweep.lag_axis(3, 1)
    for empty in ((sites.limit(0), ["discharge_mean"]), (sites, [])):
        with pytest.raises(ValueError, match="grid is empty"):
            sweep.sweep(features, targets, *empty, sweep.lag_axis(-1, 1), 6, (7, 14))
    signs = {r.regime: (r.n_negative, r.n_positive) for r in sweep.lag_signs(spark.createDataFrame([(1, "all", -3, True), (1, "all", 3, True), (1, "all", 4, True), (1, "all", -1, None), (1, "onset", 2, False)], "run_id long, regime string, lag_days int, passes_gate boolean")).collect()}
    assert signs == {"all": (1, 2), "onset": (0, 0)}


def test_alignment_is_the_last_known_value_with_its_regime(spark):
    """Against a loop: gaps, unknown values, anchors before and after the record."""
    r = np.random.default_rng(8)
    record = {D + timedelta(days=int(i)): (None if r.random() < 0.2 else float(r.integers(0, 4))) for i in sorted(r.choice(120, 70, replace=False))}
    series = spark.createDataFrame([("f", "s", d, v) for d, v in record.items()], "feature_name string, site_id string, date date, value double")
    weeks = {D + timedelta(days=7 * i): (None if i % 6 == 5 else i / 10) for i in range(-2, 22)}
    targets = spark.createDataFrame([(w, 7, v) for w, v in weeks.items()], "week_ending date, horizon_days int, value double")
    want = set()
    for w, y in weeks.items():
        for lag in (-9, 0, 4) if y is not None else ():
            before = [d for d, v in record.items() if v is not None and d <= w - timedelta(days=lag)]
            if before:
                d = max(before)
                past = record.get(d - timedelta(days=1))
                want.add((w, lag, "all", d, record[d], y))
                if past is not None and past != record[d]:
                    want.add((w, lag, "onset" if record[d] > past else "recovery", d, record[d], y))
    got = sweep.align(series, targets, [-9, 0, 4]).select("week", "lag_days", "regime", "fdate", "x", "y").collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def runs(spans, total, start):
    """Daily run lengths with the given (first day, length) spans."""
    values = [0.0] * total
    for a, n in spans:
        for i in range(n):
            values[a + i] = float(i + 1)
    return [("s", start + timedelta(days=i), v) for i, v in enumerate(values)]


@pytest.mark.parametrize("spans, total, expected", [([(5, 60)], 70, [60]), ([(0, 10), (110, 10)], 120, [10, 10]), ([(0, 10), (15, 10)], 25, [20])])
def test_events(spark, spans, total, expected):
    start = date(2022, 8, 1)
    rows = spark.createDataFrame(runs(spans, total, start), "site_id string, date date, value double")
    out = analogs.collapse(analogs.detections(rows, ["site_id"], "date", "value", 1), ["site_id"], "date", 90).orderBy("event_start").collect()
    assert [r.n_detections for r in out] == expected and out[0].event_start == start + timedelta(days=spans[0][0])


def test_eligibility(spark):
    events = spark.createDataFrame([("s", d, 3) for d in (date(2020, 8, 15), date(2022, 8, 1), date(2022, 8, 15), date(2022, 9, 10))], "site_id string, event_start date, n_detections long")
    summary = spark.createDataFrame([("q", "s", date(2022, 9, 20), date(2022, 8, 15)), ("none", "s", date(2022, 9, 20), None)], "query_id string, site_id string, as_of date, query_start date")
    assert [(r.query_id, r.event_start) for r in analogs.eligible(events, summary, 21).collect()] == [("q", date(2020, 8, 15))]


def history(spark):
    """Two sites with gaps, unknown values and anomalies that begin late."""
    r = np.random.default_rng(12)
    rows = []
    for site in "st":
        run = 0
        for i in range(400):
            run = 0 if r.random() < 0.12 or i % 90 < 60 else run + 1
            if r.random() < 0.05:
                continue
            for name in ("days_below_p10", "discharge_min"):
                value = float(run) if name == "days_below_p10" else float(r.integers(0, 50))
                rows.append((D + timedelta(days=i), site, name, None if r.random() < 0.03 else value, value - 25 if name == "discharge_min" and i > 200 and r.random() < 0.97 else None, 9))
    return rows


def test_queries_see_only_their_own_past(spark):
    """Each query against a loop over its own history."""
    rows = history(spark)
    features = spark.createDataFrame(rows, "date date, site_id string, feature_name string, value double, anomaly double, climatology_n_years int")
    p = analogs.Parameters(separation_days=20, features=("days_below_p10", "discharge_min"), k=3, window_days=10)
    asked = [(f"{s}{i}", s, D + timedelta(days=i)) for s in "stu" for i in range(0, 420, 13)]
    queries = spark.createDataFrame(asked, "query_id string, site_id string, as_of date")
    events, summary = analogs.query_events(queries, features, p)
    firsts = analogs.first_anomalies(features, p.features)
    near = analogs.nearest_events(analogs.eligible(events, summary, p.window_days), analogs.vectors(features, firsts, p.features), firsts, p)
    got = {r.query_id: (r.n_raw_detections, r.n_collapsed_events, r.query_start) for r in summary.collect()}
    found: dict[str, list] = {}
    for r_ in sorted(near.collect(), key=lambda x: x["rank"]):
        found.setdefault(r_.query_id, []).append((r_.event_start, round(r_.distance, 9)))
    some = 0
    for q, site, as_of in asked:
        seen = sorted((d, v) for d, s, n, v, _, _ in rows if s == site and n == p.entry_feature and d <= as_of)
        hits = [d for d, v in seen if v is not None and v >= 1]
        starts = [d for k, d in enumerate(hits) if k == 0 or (d - hits[k - 1]).days > 20]
        start = starts[-1] if starts and seen[-1][0] == hits[-1] else None
        assert got[q] == (len(hits), len(starts), start), q
        past = [x for x in rows if x[1] == site and x[0] <= as_of]
        use = {n: any(x[4] is not None for x in past if x[2] == n) for n in p.features}
        vec: dict = {}
        for d, _, n, v, a, _ in past:
            vec.setdefault(d, {})[n] = a if use[n] else v
        full = {d: [v[n] for n in p.features] for d, v in vec.items() if all(v.get(n) is not None for n in p.features)}
        w = timedelta(days=10)
        ok = [e for e in starts if start and e + w <= as_of and e + w < start and e in full and as_of in full]
        if ok:
            m, sd = np.mean(list(full.values()), 0), np.std(list(full.values()), 0)
            z = lambda d: (np.array(full[d]) - m) / sd  # noqa: E731, B023
            want = sorted((round(float(np.linalg.norm(z(e) - z(as_of))), 9), e) for e in ok)[:3]
            assert [(e, pytest.approx(x, abs=1e-7)) for x, e in want] == found.get(q), q
            some += 1
        else:
            assert q not in found
    assert some > 5
    with pytest.raises(ValueError):
        analogs.require_population(features.limit(0))


def test_distance_in_units_of_spread(spark):
    vecs = spark.createDataFrame([("q", D + timedelta(days=9), D + timedelta(days=i), float(a), float(b), 7.0) for i, (a, b) in zip((0, 1, 9), ((1, 10), (3, 20), (5, 30)))], "query_id string, as_of date, date date, a double, b double, c double")
    s = analogs.scale(vecs, ("a", "b", "c"), ["query_id"]).first()
    assert s.sd_a == pytest.approx(math.sqrt(8 / 3)) and s.sd_b == pytest.approx(math.sqrt(200 / 3)) and s.sd_c == 0
    near = analogs.k_nearest(vecs, vecs.where(F.col("date") < F.col("as_of")).select("query_id", F.col("date").alias("event_start")), analogs.Parameters(features=("a", "b", "c"), k=1)).collect()
    assert len(near) == 1 and near[0].distance == pytest.approx(math.sqrt(3)) and near[0].rank == 1


def outcome(spark, rates, start, window=21):
    weeks = spark.createDataFrame([(D + timedelta(days=7 * i), r) for i, r in enumerate(rates)], "week date, rate double")
    events = spark.createDataFrame([("q", start)], "query_id string, event_start date")
    return tuple(analogs.outcomes(events, weeks, "week", "rate", window).select("reason", "log_return").first())


def test_outcomes(spark):
    rates = [100.0, 120.0, 150.0, 200.0, 260.0]
    assert outcome(spark, rates, D) == ("complete", pytest.approx(math.log(2)))
    assert outcome(spark, rates, D + timedelta(days=2)) == ("complete", pytest.approx(math.log(2)))
    assert outcome(spark, [None, *rates[1:]], D)[0] == "no_rate_at_start"
    assert outcome(spark, [*rates[:3], None, 260.0], D)[0] == "no_rate_at_end"
    assert outcome(spark, rates, D - timedelta(days=1))[0] == "no_rate_at_start"
    assert outcome(spark, rates, D + timedelta(days=8))[0] == "series_does_not_reach"


@pytest.mark.parametrize(
    "moves, expected",
    [([0.4, 0.5, 0.6], ("insufficient_analogs", 3, 3)), ([0.4, 0.5, 0.6, 0.7], ("passed", 4, 4)), ([0.4, 0.5, 0.6, -0.3, -0.2], ("inconsistent_direction", 5, 3)), ([0.4, 0.5, 0.6, 0.0, 0.0], ("inconsistent_direction", 5, 3)), ([0.4, 0.5, 0.6, 0.7, None], ("incomplete_outcomes", 4, 0)), ([], ("insufficient_analogs", 0, 0))],
)
def test_gate(spark, moves, expected):
    rows = spark.createDataFrame([("q", None if m is None else m, "no_rate_at_end" if m is None else "complete") for m in moves], "query_id string, log_return double, reason string")
    summary = spark.createDataFrame([("q", D)], "query_id string, query_start date")
    out = analogs.gate(summary, rows, analogs.Parameters()).first()
    assert (out.verdict, out.n_analogs, out.n_consistent) == expected
    none = analogs.gate(summary.withColumn("query_start", F.lit(None).cast("date")), rows, analogs.Parameters()).first()
    assert none.verdict == "no_current_event"


def test_answers_end_to_end(spark):
    start, rows = date(2016, 1, 1), []
    spans = [((date(y, 8, 15) - start).days, 45) for y in (2016, 2018, 2020, 2022, 2023)]
    low = runs(spans, 2922, start)
    for i, (_, day, run) in enumerate(low):
        for name in analogs.Parameters().features:
            value = run if name.startswith("days") else 1000.0 - run + i % 7
            rows.append((day, "s", name, value, None if name.startswith("days") else value - 1000, None if name.startswith("days") else 8))
    features = spark.createDataFrame(rows, "date date, site_id string, feature_name string, value double, anomaly double, climatology_n_years int")
    rates = spark.createDataFrame([(start + timedelta(days=7 * i), 300.0 + 25 * i) for i in range(440)], "week date, rate double")
    queries = spark.createDataFrame([("now", "s", date(2023, 9, 10)), ("quiet", "s", date(2023, 6, 1)), ("early", "s", date(2018, 9, 10))], "query_id string, site_id string, as_of date")
    sites = spark.createDataFrame([("s", "Long River at Memphis, TN", "Long River")], "site_id string, name string, river string")
    a = analogs.answer(queries, features, rates, "week", "rate")
    got = {r.query_id: r for r in a.verdicts.collect()}
    assert (got["now"].verdict, got["quiet"].verdict, got["early"].verdict) == ("passed", "no_current_event", "insufficient_analogs")
    assert (got["now"].n_analogs, got["now"].n_collapsed_events, got["now"].direction) == (4, 5, 1)
    tables = analogs.conclusions(a, sites)
    assert {k: v.count() for k, v in tables.items()} == {"passed": 1, "refused": 1, "no_current_event": 1}
    text = tables["passed"].first().sentence
    assert text.startswith("Long River discharge at Memphis has") and "The last 4 times discharge moved like this, the spot barge rate rose, +" in text and "4 of 4 directionally consistent." in text
    refusal = tables["refused"].first()
    told = analogs.conclusions(a, sites.withColumn("first", F.lit(date(2016, 1, 1))), since=F.col("first"))["refused"].first().sentence
    assert "1 comparable event since 2016, below the 4 required" in told
    assert "1 comparable event, below the 4 required" in refusal.sentence and "median_pct" not in tables["refused"].columns
    quiet = tables["no_current_event"].first().sentence
    assert "Memphis is not in a low-water condition on 2023-06-01" in quiet


def test_condition_halves_are_independent(spark):
    rows = [(date(2022, 1, 15), "s", "discharge_min", 50.0, None, 3)]
    features = spark.createDataFrame(rows, "date date, site_id string, feature_name string, value double, anomaly double, climatology_n_years int")
    queries = spark.createDataFrame([("q", "s", date(2022, 1, 15))], "query_id string, site_id string, as_of date")
    out = analogs.condition(queries, features, analogs.Parameters()).first()
    assert out.change is None and out.anomaly is None and out.n_years == 3


def test_strongest_signal_of_latest_run(spark):
    rows = spark.createDataFrame([(1, "s", "f", 0.001), (2, "s", "f", 0.2), (2, "s", "f", 0.1), (2, "s", "g", 0.01)], "run_id long, site_id string, feature_name string, q_value double")
    out = sweep.strongest_signal(rows, "f").first()
    assert (out.run_id, out.q_value) == (2, 0.1)


def test_health(spark):
    now = F.lit(datetime(2024, 1, 10))
    t = spark.createDataFrame([(date(2024, 1, 8),)], "d date")
    newest = health.newest_rows({"a": (t, "d"), "b": (t.limit(0), "d"), "c": (None, "d"), "e": (t, "nope")})
    limits = spark.createDataFrame([(n, f"job_{n}", 86400 * 4) for n in "abce"], "table string, job_name string, max_staleness_s long")
    fresh = health.freshness(newest, limits, now)
    assert {r.table: r.stale for r in fresh.collect()} == {"a": False, "b": True, "c": True, "e": True}
    runs_ = spark.createDataFrame([("job_a", datetime(2024, 1, 1), "success"), ("job_a", datetime(2024, 1, 9), "failed")], "job_name string, finished_at timestamp, status string")
    cadence = spark.createDataFrame([("job_a", 86400), ("job_z", 86400)], "job_name string, max_gap_s long")
    late = health.overdue(runs_, cadence, now)
    assert {r.job_name: r.overdue for r in late.collect()} == {"job_a": True, "job_z": True}
    assert tuple(health.health(late, fresh).first()) == (2, 3, True)
    assert [r.job_name for r in health.overdue_but_fresh(late, fresh).collect()] == ["job_a"]


def test_parameters_are_arguments():
    assert replace(analogs.Parameters(), k=3).k == 3
