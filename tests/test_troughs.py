"""Troughs as each day knew them, against detection on each day's whole past."""

from __future__ import annotations

import numpy as np
import pytest

from tidewell.operators import cycles


def by_prefix(x, **how):
    out = []
    for i in range(len(x)):
        at = cycles.troughs(x[: i + 1], **how)
        out.append(int(at[-1]) if len(at) else -1)
    return out


def shapes():
    r = np.random.default_rng(2)
    t = np.arange(700)
    yield "noise", r.normal(size=500)
    yield "waves", 150 + 8 * np.sin(t / 7) + r.normal(0, 0.5, 700)
    yield "steps", np.repeat(r.integers(0, 6, 90), r.integers(1, 25, 90)).astype(float)
    yield "few levels", r.integers(0, 3, 600).astype(float)
    yield "sawtooth", np.tile(np.concatenate([np.linspace(150, 175, 3), np.linspace(174, 150, 43)]), 9)
    yield "flat", np.full(200, 5.0)
    yield "rising troughs", t % 17 + t * 0.1
    yield "falling troughs", t % 17 - t * 0.1
    yield "flat, wave, flat", np.concatenate([np.full(150, 3.0), 3 + np.sin(t[:200] / 5), np.full(150, 3.0), 3 + np.cos(t[:100] / 9)])
    yield "short", r.normal(size=15)
    yield "none", np.zeros(0)


@pytest.mark.parametrize(("name", "x"), list(shapes()))
def test_rows_to_come_are_not_needed(name, x):
    assert cycles.last_troughs(x).tolist() == by_prefix(x)
    assert cycles.last_troughs(x, spacing=5, smooth=3, snap=2).tolist() == by_prefix(x, spacing=5, smooth=3, snap=2)


def test_work_is_in_proportion_to_the_rows(monkeypatch):
    seen = []
    whole = cycles.local_maxima
    monkeypatch.setattr(cycles, "local_maxima", lambda v: seen.append(len(v)) or whole(v))
    r = np.random.default_rng(3)
    for n in (1000, 4000):
        seen.clear()
        cycles.last_troughs(150 + 8 * np.sin(np.arange(n) / 7) + r.normal(0, 2, n))
        assert sum(seen) < 250 * n


def test_a_part_has_the_means_of_the_whole():
    x = np.random.default_rng(5).normal(size=300)
    whole = cycles.centred_mean(x, 7)
    assert (cycles.centred_mean(x[50:200], 7)[3:-3] == whole[53:197]).all()
    assert np.allclose(whole, [x[max(0, i - 3) : i + 4].mean() for i in range(300)])


def tops(x):
    """Middles of runs of equal values between lower ones, one row at a time."""
    for p in range(1, len(x) - 1):
        a, b = p, p
        while a > 0 and x[a - 1] == x[p]:
            a -= 1
        while b < len(x) - 1 and x[b + 1] == x[p]:
            b += 1
        if a > 0 and b < len(x) - 1 and x[a - 1] < x[p] > x[b + 1] and p == (a + b) // 2:
            yield p


def plain_peaks(x, distance, drop):
    """Peaks by definition: of all rows, one at a time, in the order in which they become known."""
    found = []
    for p in tops(x):
        left = p
        low = x[p]
        while left >= 0 and x[left] <= x[p]:
            low = min(low, x[left])
            left -= 1
        if x[p] - low < drop:
            continue
        for c in range(p + 1, len(x)):
            if x[c] > x[p]:
                break
            if x[p] - x[c] >= drop:
                found.append((c, p))
                break
    taken = []
    for c, p in sorted(found):
        if all(abs(p - q) >= distance for _, q in taken):
            taken.append((c, p))
    return taken


def test_station_peaks_are_those_by_definition(spark, sf_dir):
    from tidewell import registry
    from tidewell.sources.adapter import Tables

    series = {}
    for r in Tables(spark, sf_dir).daily.orderBy("station_code", "price_date").collect():
        series.setdefault(r.station_code, []).append((r.price_date, r.decicents / 10))
    want = {(s, rows[p][0], rows[c][0]) for s, rows in series.items() for c, p in plain_peaks([v for _, v in rows], 7, 1.0)}
    assert {tuple(r) for r in registry.QUERIES["station_peaks"](spark, sf_dir).select("station_code", "peak_date", "confirmed_on").collect()} == want


def test_council_troughs_and_days_are_those_of_each_series(spark, sf_dir):
    from tidewell import registry
    from tidewell.operators import panel
    from tidewell.sources.adapter import Tables

    series = {}
    for r in panel.mean_price(Tables(spark, sf_dir).panel, "council").orderBy("council", "price_date").collect():
        series.setdefault(r.council, []).append((r.price_date, r.price))
    want, since = set(), {}
    for c, rows in series.items():
        x = np.array([v for _, v in rows])
        smooth, kept = cycles.centred_mean(x, 7), []
        for i in sorted(tops(-smooth), key=lambda i: (smooth[i], -i)):
            if all(abs(i - k) >= 18 for k in kept):
                kept.append(i)
        for i in kept:
            lo = max(0, i - 5)
            want.add((c, rows[lo + int(np.argmin(x[lo : i + 6]))][0]))
        for i, t in enumerate(by_prefix(x)[:400]):
            since[c, rows[i][0]] = (rows[i][0] - rows[t][0]).days if t >= 0 else None
    assert {(r.council, r.event_date) for r in registry.QUERIES["council_troughs"](spark, sf_dir).collect()} == want
    got = {(r.council, r.price_date): r.days_since for r in registry.QUERIES["days_since_trough"](spark, sf_dir).collect()}
    assert {k: got[k] for k in since} == since
