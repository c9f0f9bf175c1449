import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import point_in_time as P

SALES = "sale_id bigint, client_id bigint, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority string"
CLICKS = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, client_id bigint, kind string, value double, props string"
LINES = "sale_id bigint, line_no int, item_id bigint, amount double, shipped_at timestamp_ntz"
HOUR = 3_600_000_000
T0 = 1_704_067_200_000_000


def stamp(us):
    return None if us is None else np.datetime64(us, "us").astype(object)


def shop(seed, n_clients=4, n_sales=120, n_clicks=300, n_items=6):
    """Hot client, ties, nulls, late and early arrivals, repeated rows, values that are not finite."""
    rng = random.Random(seed)
    some = lambda f, p=0.03: None if rng.random() < p else f
    client = lambda: some(rng.choices(range(n_clients), [9, *[1] * (n_clients - 1)])[0])
    when = lambda: T0 + rng.randrange(40) * 24 * HOUR + (rng.randrange(24 * HOUR) if rng.random() < 0.5 else 0)
    late = lambda t: t + rng.choice([0, 1, 5, 30, 70, 400, -20]) * HOUR
    cents = lambda: some(rng.choice([rng.random() * 50, float("nan"), float("inf"), 0.005, 1.235]) if rng.random() < 0.2 else rng.random() * 50)
    sales, clicks, lines = [], [], []
    for i in range(n_sales):
        t = when()
        sales.append((some(i), client(), "x", cents(), some(t), some(late(t)), None))
        for j in range(rng.choice([0, 1, 3, 6])):
            lines.append((some(i), j, some(rng.randrange(n_items)), cents(), some(t + rng.choice([0, 1, 2, 5, 13, 15]) * 24 * HOUR)))
    for i in range(n_clicks):
        t = when()
        clicks.append((some(i), some(t), some(late(t)), client(), some(rng.choice(["click", "purchase"])), cents(), some('{"a": 1}')))
    lines += rng.sample(lines, 20)
    clicks += rng.sample(clicks, 20)
    sales += rng.sample(sales, 6)
    return sales, clicks, lines


def amount(x):
    return 0 if x is None or not np.isfinite(x) else int(np.floor(100 * x + 0.5))


def plain(sales, clicks, lines, windows=(2, 14)):
    out = []
    of_sale = defaultdict(list)
    for r in lines:
        of_sale[r[0]].append(r)
    distinct = {repr(c): c for c in clicks}.values()
    known = [s for s in sales if s[1] is not None and s[4] is not None]
    for s in known:
        t = s[4] + (zlib.crc32(str(s[0]).encode()) % 259_200 if s[0] is not None else 0) * 1_000_000
        label = any(x[1] == s[1] and t < x[4] <= t + 7 * 24 * HOUR for x in known)
        for d in windows:
            inside = lambda e, a: e is not None and a is not None and t - d * 24 * HOUR < e <= t and a + 4 * HOUR <= t  # noqa: B023, E731
            c = [x for x in distinct if x[3] == s[1] and inside(x[1], x[2])]
            z = [x for x in known if x[1] == s[1] and inside(x[4], x[5])]
            ln = [y for x in z if x[0] is not None for y in of_sale[x[0]] if y[4] is not None and y[4] <= t]
            low = lambda v: -(1 << 63) if v is None else v
            last = max(c, key=lambda x: (x[1], low(x[0])), default=[None])[0]
            out.append((s[0], d, t, label, len(c), sum(x[4] == "purchase" for x in c), sum(amount(x[5]) for x in c), last, len(z), sum(amount(x[3]) for x in z), len(ln), len({y[2] for y in ln} - {None}), sum(amount(y[3]) for y in ln)))
    return out


def frames(spark, sales, clicks, lines):
    at = {0: (4, 5), 1: (1, 2), 2: (4,)}
    made = [[tuple(stamp(v) if i in at[k] else v for i, v in enumerate(r)) for r in rows] for k, rows in enumerate((sales, clicks, lines))]
    return [spark.createDataFrame(rows, schema) for rows, schema in zip(made, (SALES, CLICKS, LINES), strict=True)]


key = lambda rows: sorted(rows, key=repr)


@pytest.mark.parametrize("seed,unit", [(1, 8192), (2, 64), (3, 16), (4, 7)])
def test_equals_plain_loops(spark, seed, unit):
    """Small units make windows of many whole units, so that trees over units and their carries are held too."""
    data = shop(seed)
    got = P.point_in_time(*frames(spark, *data), unit_rows=unit).collect()
    assert key(tuple(r) for r in got) == key(plain(*data))


def test_other_windows_and_zone(spark):
    data = shop(9, n_sales=40, n_clicks=80)
    zone = spark.conf.get("spark.sql.session.timeZone")
    made = frames(spark, *data)
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = P.point_in_time(*made, windows=(1, 3, 30), unit_rows=32).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert key(tuple(r) for r in got) == key(plain(*data, windows=(1, 3, 30)))


def test_items_of_one_client_merge(spark):
    """A client that buys one item again and again keeps few pieces, and the sums stay right."""
    rng = random.Random(3)
    sales = [(i, 1, "x", 1.0, T0 + rng.randrange(30 * 24 * HOUR), None, None) for i in range(400)]
    sales = [(*s[:5], s[4] + rng.randrange(50 * HOUR), None) for s in sales]
    lines = [(i, 0, 7, 1.0, sales[i][4] + rng.randrange(15 * 24 * HOUR)) for i in range(400)]
    made = frames(spark, sales, [], lines)
    assert key(tuple(r) for r in P.point_in_time(*made, unit_rows=50).collect()) == key(plain(sales, [], lines))
    seen = spark.createDataFrame([(1, s[4], max(s[5] + 4 * HOUR, ln[4]), 7, 1) for s, ln in zip(sales, lines, strict=True)] * 20, "client bigint, e bigint, a bigint, item bigint, cents bigint")
    assert P._pieces(seen, (2, 14)).count() < 400


def test_empty_tables_and_clashing_columns(spark):
    sales, clicks, lines = shop(5, n_sales=30, n_clicks=30)
    assert P.point_in_time(*frames(spark, [], [], [])).collect() == []
    assert P.point_in_time(*frames(spark, [], clicks, lines)).collect() == []
    assert key(tuple(r) for r in P.point_in_time(*frames(spark, sales, [], [])).collect()) == key(plain(sales, [], []))
    more = [df.select("*", *(F.lit(7).alias(c) for c in ("client", "at", "e", "seen", "w", "t", "id", "avail", "cents", "_rest"))) for df in frames(spark, sales, clicks, lines)]
    assert key(tuple(r) for r in P.point_in_time(*more, unit_rows=16).collect()) == key(plain(sales, clicks, lines))
    nulls = [(None,) * 7] * 2
    assert P.point_in_time(*frames(spark, nulls, nulls, [(None,) * 5])).collect() == []


def test_tree_sums_against_a_loop():
    rng = np.random.default_rng(0)
    values, avail, clicks = rng.integers(0, 9, (300, 3)), rng.integers(0, 40, 300), rng.random(300) < 0.5
    low = rng.integers(0, 301, 200)
    high, t = rng.integers(0, 301, 200), rng.integers(-1, 45, 200)
    sums, last = P.tree_sums(values, avail, clicks, low, high, t)
    for i in range(200):
        at = [p for p in range(low[i], high[i]) if avail[p] <= t[i]]
        assert sums[i].tolist() == values[at].sum(axis=0).tolist() and last[i] == max((p for p in at if clicks[p]), default=-1)
