"""Rolling, gap, session and history features against row-by-row definitions."""

import math
import random
from decimal import Decimal
from fractions import Fraction
from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from ledgersight.functions.calendar import DAY_US, HOUR_US, SECOND_US
from ledgersight.operators.history import HistoryColumns, history_features
from ledgersight.operators.rolling import Gap, Rolling, Totals, timeline_features
from ledgersight.operators.skew import SkewPolicy
from tests import brute

SCHEMA = ("event_id bigint, customer_id bigint, event_us bigint, amt double, mcc string, "
          "event_type_nm string, event_desc int, channel_indicator_sub_type int, session_id bigint, "
          "event_date date")
START = 1_704_067_200 * SECOND_US
SPLIT = SkewPolicy(hot_rows=6, broadcast_rows=4)
COLUMNS = HistoryColumns(mcc="mcc")


def row(i, customer, us, amt=1.0, mcc="a", kind="t", desc=1, sub=1, session=1):
    return {"event_id": i, "customer_id": customer, "event_us": START + us, "amt": amt, "mcc": mcc,
            "event_type_nm": kind, "event_desc": desc, "channel_indicator_sub_type": sub,
            "session_id": session,
            "event_date": date(2024, 1, 1) + timedelta(days=us // DAY_US)}


def random_rows(seed, n=60, step=HOUR_US):
    r = random.Random(seed)
    return [row(i, r.choice([1, 1, 1, 2, 3]), r.randrange(0, 40 * 24) * step + r.choice([0, 0, 1]),
                r.choice([None, -5.0, -1.25, 0.0, 10.5, 99.99]), r.choice([None, "a", "b", "c"]),
                r.choice(["t", "u"]), r.choice([1, 2]), r.choice([None, 1, 2]), r.choice([-1, 7]))
            for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def collected(df, name):
    return {r["event_id"]: r[name] for r in df.select("event_id", name).collect()}


SPECS = [
    Rolling("cnt_1h", "count", HOUR_US), Rolling("cnt_24h", "count", DAY_US),
    Rolling("amt_24h", "sum", DAY_US), Rolling("avg_7d", "mean", 7 * DAY_US),
    Rolling("amt_30d", "sum", 30 * DAY_US), Rolling("same_mcc", "count", 7 * DAY_US, extra_keys=("mcc",)),
    Rolling("mccs", "distinct", 7 * DAY_US, "mcc"),
]


def check_rolling(spark, rows, policy):
    out = timeline_features(frame(spark, rows), SPECS, policy=policy).persist()
    assert out.count() == len(rows)
    for s in SPECS:
        want = brute.rolling(rows, s.what, s.period_us,
                             s.value if s.what != "count" else None, s.extra_keys)
        assert collected(out, s.name) == pytest.approx(want), s.name
    out.unpersist()


@pytest.mark.parametrize("policy", [SkewPolicy(), SPLIT], ids=["plain", "split"])
@pytest.mark.parametrize("seed", [1, 2])
def test_rolling_matches_definition(spark, seed, policy):
    check_rolling(spark, random_rows(seed), policy)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 20), st.sampled_from(["a", "b", None])),
                min_size=1, max_size=14))
def test_rolling_with_many_ties(spark, events):
    rows = [row(i, c, t * 12 * HOUR_US, mcc=m) for i, (c, t, m) in enumerate(events)]
    check_rolling(spark, rows, SkewPolicy())
    check_rolling(spark, rows, SkewPolicy(hot_rows=2, broadcast_rows=1))


@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(hot_rows=1, broadcast_rows=1)],
                         ids=["plain", "split"])
def test_frame_borders(spark, policy):
    """[t - period, t): the lower border is inside, t itself and its ties are outside."""
    rows = [row(1, 1, 0), row(2, 1, 1), row(3, 1, HOUR_US - 1), row(4, 1, HOUR_US), row(5, 1, HOUR_US)]
    out = timeline_features(frame(spark, rows), [Rolling("n", "count", HOUR_US)], policy=policy)
    assert collected(out, "n") == {1: 0, 2: 1, 3: 2, 4: 3, 5: 3}


@pytest.mark.parametrize("policy", [SkewPolicy(), SPLIT], ids=["plain", "split"])
def test_gaps_and_sessions(spark, policy):
    rows = random_rows(3)
    out = timeline_features(
        frame(spark, rows), gaps=[Gap("gap"), Gap("gap_mcc", ("mcc",), first=-1)],
        totals=[Totals(), Totals("run_sum", "run_cnt", causal=True)], policy=policy).persist()

    def gap(r, keys, first):
        before = [x for x in rows if x["customer_id"] == r["customer_id"]
                  and all(x[k] == r[k] for k in keys)
                  and (x["event_us"], x["event_id"]) < (r["event_us"], r["event_id"])]
        return (r["event_us"] - max(x["event_us"] for x in before)) // SECOND_US if before else first

    def total(r, causal):
        same = [x for x in rows if x["customer_id"] == r["customer_id"]
                and x["session_id"] == r["session_id"]
                and (not causal or x["event_us"] <= r["event_us"])]
        return sum(x["amt"] or 0 for x in same), len(same)

    assert collected(out, "gap") == {r["event_id"]: gap(r, (), 999999) for r in rows}
    assert collected(out, "gap_mcc") == {r["event_id"]: gap(r, ("mcc",), -1) for r in rows}
    for causal, (s, n) in ((False, ("session_amt_sum", "session_cnt")), (True, ("run_sum", "run_cnt"))):
        want = {r["event_id"]: total(r, causal) for r in rows}
        assert collected(out, s) == pytest.approx({k: v[0] for k, v in want.items()})
        assert collected(out, n) == {k: v[1] for k, v in want.items()}
    out.unpersist()


@pytest.mark.parametrize("policy", [SkewPolicy(), SPLIT], ids=["plain", "split"])
@pytest.mark.parametrize("step", [HOUR_US, 1], ids=["hours", "ties"])
def test_history_matches_definition(spark, policy, step):
    rows = random_rows(4, step=step)
    out = history_features(frame(spark, rows), COLUMNS, policy=policy).persist()
    assert out.count() == len(rows)
    want = brute.history(rows, COLUMNS)
    for name in next(iter(want.values())):
        assert collected(out, name) == pytest.approx(
            {k: v[name] for k, v in want.items()}, abs=1e-6), name
    out.unpersist()


def test_first_and_third_event(spark):
    """Sentinels on the first event; the deviation is 0 until there are two earlier events."""
    rows = [row(1, 1, 0, 10.0), row(2, 1, 5 * SECOND_US, 20.0), row(3, 1, 9 * SECOND_US, 5.0)]
    out = history_features(frame(spark, rows), COLUMNS)
    assert collected(out, "sec_since_prev_event") == {1: -1, 2: 5, 3: 4}
    assert collected(out, "cust_prev_amt_std") == {1: 0.0, 2: 0.0, 3: 5.0}
    assert collected(out, "cust_prev_amt_mean") == {1: 0.0, 2: 10.0, 3: 15.0}


@pytest.mark.parametrize("policy", [SkewPolicy(), SPLIT], ids=["plain", "split"])
def test_later_events_change_nothing(spark, policy):
    """Causality: only whole-session totals may look ahead."""
    rows = sorted(random_rows(5), key=lambda r: r["event_us"])
    early = [r for r in rows if r["event_us"] < rows[40]["event_us"]]

    def features(data):
        out = timeline_features(frame(spark, data), SPECS, [Gap("gap")], policy=policy)
        return {r["event_id"]: tuple(r[s.name] for s in SPECS) + (r["gap"],) for r in out.collect()}

    everything = features(rows)
    assert features(early) == {r["event_id"]: everything[r["event_id"]] for r in early}


def test_result_does_not_depend_on_partitioning(spark):
    rows = random_rows(6)
    one = timeline_features(frame(spark, rows).coalesce(1), SPECS).collect()
    many = timeline_features(frame(spark, rows).repartition(7), SPECS).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_ties_are_cut_by_id_ranges(spark):
    """All events of a customer at one instant, ids far apart: no slice is overfull."""
    from ledgersight.operators.timeline import slice_rows
    r = random.Random(7)
    rows = [row(r.randrange(10**12), 1, 0, amt=float(i), kind=r.choice("tu")) for i in range(40)]
    rows += [row(5 + i, 1, HOUR_US * i) for i in range(3)] + [row(99, 2, 0)]
    sliced = slice_rows(frame(spark, rows), "customer_id", "event_us", "event_id", SPLIT)
    fullest = sliced.groupBy("customer_id", "_cell").count().agg({"count": "max"}).first()[0]
    assert fullest <= SPLIT.hot_rows
    want = brute.history(rows, COLUMNS)
    out = history_features(frame(spark, rows), COLUMNS, policy=SPLIT).persist()
    for name in ("cust_prev_events", "cust_prev_amt_mean", "amt_delta_prev", "cnt_prev_same_type"):
        assert collected(out, name) == pytest.approx({k: v[name] for k, v in want.items()}), name
    out.unpersist()


# --- amounts ------------------------------------------------------------------------

def amounts(spark, values):
    rows = [(1, i, i * 1_000_000, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "customer_id bigint, event_id bigint, event_us bigint, amt double")


@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(hot_rows=2, min_cell_us=1)])
def test_small_and_large_amounts_are_summed_together(spark, policy):
    df = amounts(spark, [1e15, 0.000001, None, -1e15, 0.000002, 5.0])
    out = timeline_features(df, [Rolling("s", "sum", 3_600_000_000, "amt")], policy=policy)
    got = [r["s"] for r in out.orderBy("event_id").collect()]
    assert got[1:] == [1e15, 1e15, 1e15, 0.000001, 0.000003]


@pytest.mark.parametrize("value", [float("nan"), float("inf"), 1e19, 1e33])
def test_an_amount_that_fits_no_exact_sum_is_an_error(spark, value):
    df = amounts(spark, [1.0, value])
    with pytest.raises(PySparkException, match="does not fit"):
        timeline_features(df, [Rolling("s", "sum", 3_600_000_000, "amt")]).collect()


def test_sums_are_the_nearest_doubles(spark):
    """Beyond 2^53 units and below, a sum of parts is the double nearest to the exact total."""
    r = random.Random(8)
    values = [round(r.uniform(-1, 1) * 10 ** r.randrange(1, 17), 6) for _ in range(60)]
    df = amounts(spark, values)
    out = timeline_features(df, [Rolling("s", "sum", 3_600_000_000, "amt")]).orderBy("event_id").collect()
    exact = [Fraction(0)]
    for v in values:
        exact.append(exact[-1] + Fraction(str(Decimal(repr(v)).quantize(Decimal("0.000001")))))
    assert [x["s"] for x in out] == [float(e) for e in exact[:-1]]


def test_deviation_survives_a_large_common_amount(spark):
    """Amounts that differ in the sixth digit beside 100,000: doubles of the squares would lose the spread."""
    r = random.Random(9)
    values = [100_000 + r.randrange(100) / 10**6 for _ in range(30)]
    df = amounts(spark, values).selectExpr(
        "*", "'t' AS event_type_nm", "1 AS event_desc", "'m' AS mcc_code_i", "1 AS channel_indicator_sub_type",
        "1 AS session_id", "date'2024-01-01' AS event_date")
    routes = []
    for policy in (SkewPolicy(), SkewPolicy(hot_rows=4, min_cell_us=1)):
        out = history_features(df, policy=policy, keep_running=True).orderBy("event_id").collect()
        routes.append([(x["cust_prev_amt_std"], x["cust_cum_amt_sq"]) for x in out])
    assert routes[0] == routes[1]
    exact = [Fraction(str(Decimal(repr(v)).quantize(Decimal("0.000001")))) for v in values]
    for i, (std, squares) in enumerate(routes[0]):
        assert squares == float(sum(v * v for v in exact[:i + 1]))
        if i > 1:
            mean = sum(exact[:i]) / i
            assert std == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in exact[:i]) / i), rel=1e-12)
