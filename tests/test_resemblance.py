"""Ratios against the standard library's, nearest ids against all pairs."""

import datetime as dt
import difflib
import random

import pytest

from lodestone.operators import resemblance


def edited(r, text, n):
    out = list(text)
    for _ in range(n):
        at = r.randrange(len(out) + 1)
        out[at : at + r.randint(0, 1)] = r.choice(["", "q", " ", "ß"])
    return "".join(out)


def test_ratio_is_that_of_the_library():
    r = random.Random(1)
    for _ in range(1500):
        letters = "abcdefghijklmnopqrstuvwxyz"[: r.choice((2, 4, 26))]
        a = "".join(r.choice(letters) for _ in range(r.randint(0, r.choice((5, 40, 250, 400)))))
        b = edited(r, a, r.randint(0, 9)) if r.random() < 0.7 else "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        expected = 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        assert resemblance.ratio(a, b) == pytest.approx(expected, abs=1e-12), (a, b)


def test_near_repeats(spark):
    """A hot group, ties, rows at the window's edge, nulls: as all pairs say."""
    r, start = random.Random(6), dt.datetime(2024, 1, 1)
    base = ["the quick brown fox jumps over", "a record of what was said and done", ""]
    rows = [(i, "hot" if i % 3 else "cold", edited(r, r.choice(base), r.randint(0, 12)), start + dt.timedelta(seconds=r.randrange(1200))) for i in range(150)]
    rows += [(900, "hot", None, start), (901, None, base[0], start), (902, "hot", base[0], None), (903, "e", "x y z", start), (904, "e", "x y z", start + dt.timedelta(seconds=300)), (905, "f", "x y z", start), (906, "f", "x y z", start + dt.timedelta(seconds=301))]
    found = resemblance.near_repeats(spark.createDataFrame(rows, "i int, g string, t string, at timestamp"), "g", "i", "t", "at", 0.7, "INTERVAL 300 SECONDS")
    expected = {}
    for i, g, t, at in rows:
        if None not in (g, t, at):
            near = [(-resemblance.ratio(t, u), j) for j, h, u, then in rows if h == g and u is not None and then is not None and (then, j) < (at, i) and at - then <= dt.timedelta(seconds=300)]
            if near and -min(near)[0] >= 0.7:
                expected[i] = (g, min(near)[1], pytest.approx(-min(near)[0]))
    assert {x.id: (x.g, x.prior, x.ratio) for x in found.collect()} == expected
    assert len(expected) > 60 and 904 in expected and 906 not in expected


@pytest.mark.parametrize("most", [1, 2])
def test_nearest_ids(spark, most):
    r = random.Random(8)
    defined = {f"D-{r.randrange(3000):04d}" for _ in range(150)} | {"Ä", "", "same-prefix-a", "same-prefix-b"}
    cited = {edited(r, w, r.randint(0, 3)) for w in sorted(defined)} | {"", "far away from all", "same-prefix-"}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        return row[-1]

    expected = {}
    for c in cited - defined:
        d, near = min((distance(c, x), x) for x in defined)
        near = min((x for x in defined if distance(c, x) == d), key=lambda x: x.encode())
        expected[c] = (near, d) if d <= most else (None, None)
    frame = lambda ids: spark.createDataFrame([(i,) for i in [*ids, None]], "id string")
    found = resemblance.nearest_ids(frame(sorted(cited) * 2), frame(sorted(defined)), most)
    assert {x.id: (x.nearest, x.distance) for x in found.collect()} == expected
    assert sum(v[0] is not None for v in expected.values()) > 30 and (None, None) in expected.values()
