"""First-touch labels against a plain row loop, and one hand-made case per branch."""

import numpy as np
import pytest

from barloom.operators import labels


def loop_buy(rows, r1, horizon):
    o, h, lo, c = (np.round(np.array(x) * 100).astype(int) for x in zip(*rows))
    r, n, out = int(r1 * 100), len(rows), []
    for i in range(n):
        got = None
        if i < n - 2:
            e = o[i + 1]
            for j in range(i + 1, min(n, i + 2 + horizon)):
                tp, sl = lo[j] <= e + r <= h[j], lo[j] <= e - r <= h[j]
                if tp and sl:
                    got = int(c[j] < o[j])
                elif tp or sl:
                    got = int(tp)
                elif min(o[j], e) <= e - r <= max(o[j], e):
                    got = 0
                elif min(o[j], e) <= e + r <= max(o[j], e):
                    got = 1
                if got is not None:
                    break
        out.append(got)
    return out


def loop_two(rows, r1, horizon, skip):
    o, h, lo, c = (np.round(np.array(x) * 100).astype(int) for x in zip(*rows))
    r, n, out = int(r1 * 100), len(rows), [0] * len(rows)
    for i in range(skip, n - 2):
        e = o[i + 1]
        for j in range(i + 1, min(n, i + 1 + horizon)):
            up, down = h[j] >= e + r, lo[j] <= e - r
            if up or down:
                out[i] = (1 if c[j] >= o[j] else -1) if up and down else (1 if up else -1)
                break
    return out


def got(df, column):
    return [r[column] for r in df.orderBy("ts").select(column).collect()]


@pytest.mark.parametrize("horizon,block", [(5, 3), (40, 7), (200, None)])
def test_buy_label_equals_loop(make_bars, walk, horizon, block):
    rows = walk(400, seed=horizon)
    df = labels.buy_labels(make_bars(rows), 2.0, horizon, block=block)
    assert got(df, "label") == loop_buy(rows, 2.0, horizon)


def test_unsound_bars_equal_loop(make_bars, walk):
    rows = walk(150, seed=3)
    for i in (20, 60, 61, 100):
        o, h, lo, c = rows[i]
        rows[i] = (h + 3.0, h, lo, c)  # open above the high
    df = labels.buy_labels(make_bars(rows), 1.0, 30)
    assert got(df, "label") == loop_buy(rows, 1.0, 30)


@pytest.mark.parametrize("horizon", [6, 50])
def test_two_sided_equals_loop(make_bars, walk, horizon):
    rows = walk(300, seed=9)
    df = labels.two_sided_labels(make_bars(rows), 1.5, horizon, skip_first=10, block=5)
    assert got(df, "buy_label") == loop_two(rows, 1.5, horizon, 10)
    assert got(df, "sell_label") == [-x for x in loop_two(rows, 1.5, horizon, 10)]


def test_short_horizon_equals_two_sided(make_bars, walk):
    rows = walk(120, seed=4)
    df = labels.short_horizon_labels(make_bars(rows), 0.8, expired=5, skip_first=3)
    assert got(df, "buy_label") == loop_two(rows, 0.8, 7, 3)


FLAT = (100.0, 100.5, 99.5, 100.0)
BRANCHES = {
    "target only": ((100, 103, 99.5, 102), 1),
    "stop only": ((100, 100.5, 97, 98), 0),
    "both, falling close wins": ((100, 103, 97, 99), 1),
    "both, rising close loses": ((100, 103, 97, 101), 0),
    "open below the stop": ((97, 97.5, 96, 97), 0),
    "open above the target": ((103, 104, 102.5, 103), 1),
    "nothing reached": (FLAT, None),
}


@pytest.mark.parametrize("name", BRANCHES)
def test_branches(make_bars, name):
    bar, want = BRANCHES[name]
    rows = [FLAT, FLAT, bar, FLAT, FLAT]
    df = labels.buy_labels(make_bars(rows), 2.0, 1)
    assert got(df, "label")[0] == want
    assert got(df, "label_res")[0] == {1: "Win", 0: "Lose", None: "No res"}[want]


def test_last_two_bars_are_unlabelled(make_bars, walk):
    df = labels.buy_labels(make_bars(walk(30)), 0.1, 20)
    assert got(df, "label")[-2:] == [None, None]
    assert got(df, "entry_index")[-2:] == [-1, -1]
