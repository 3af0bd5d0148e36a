"""The five parameters of a self-exciting model, against plain code."""

import numpy as np
import pytest
from catalogflow.operators import excite, robust


def simulated(seed, days, mu, k, alpha, c, p):
    """Background events and, generation by generation, those that each sets off."""
    draw = np.random.default_rng(seed)
    m_of = lambda n: draw.exponential(0.43, n)
    t = draw.uniform(0, days, draw.poisson(mu * days))
    m = m_of(len(t))
    all_t, all_m = [t], [m]
    while len(t):
        whole = k * 10 ** (alpha * m) * c ** (1 - p) / (p - 1)
        many = draw.poisson(whole)
        dt = c * ((1 - draw.random(many.sum())) ** (1 / (1 - p)) - 1)
        t = np.repeat(t, many) + dt
        t = t[t < days]
        m = m_of(len(t))
        all_t.append(t)
        all_m.append(m)
    t, m = np.concatenate(all_t), np.concatenate(all_m)
    return t, m


def likelihood(t, m, mu, k, alpha, c, p):
    dt = t[:, None] - t[None, :]
    with np.errstate(invalid="ignore"):
        g = np.where(dt > 0, (np.maximum(dt, 0) + c) ** -p, 0.0)
    w = k * 10 ** (alpha * m)
    whole = (w * (c ** (1 - p) - (t.max() - t + c) ** (1 - p)) / (p - 1)).sum()
    return np.log(mu + g @ w).sum() - mu * (t.max() - t.min()) - whole


def test_the_fit_is_the_likeliest_and_never_falls(spark):
    t, m = simulated(4, 300, 1.0, 0.012, 0.7, 0.02, 1.25)
    t = np.append(t, t[:5])  # events of one time
    m = np.append(m, m[5:10])
    frame = spark.createDataFrame([(float(a), float(b) + 3) for a, b in zip(t, m, strict=True)] + [(None, 1.0), (2.0, None)], "t double, m double")
    found, told, shares = excite.kernel_fitted(frame, t="t", m="m", reference=3.0, start=(0.8, 0.02, 0.8, 0.03, 1.3), rounds=16)
    assert all(b >= a - 1e-7 for a, b in zip(told, told[1:]))
    assert told[-1] == pytest.approx(likelihood(t, m, *found.values()), rel=1e-9)
    start = [np.log(1.0), np.log(0.012), 0.7, np.log(0.02), 0.25]
    best, least = robust.minimise(lambda x: -likelihood(t, m, np.exp(x[0]), np.exp(x[1]), x[2], np.exp(x[3]), 1 + abs(x[4]) + 1e-3), start, 1500)
    assert -least - told[-1] < 2  # near the flat top
    assert found["mu"] == pytest.approx(np.exp(best[0]), rel=0.2) and found["alpha_ln10"] == pytest.approx(best[2], abs=0.2)
    got = {r.t: r for r in shares.collect()}
    assert len(got) == len(set(t)) and sum(r.background for r in got.values()) == pytest.approx(found["mu"] * (t.max() - t.min()), rel=0.1)


def test_too_few_events(spark):
    with pytest.raises(ValueError, match="two times"):
        excite.kernel_fitted(spark.createDataFrame([(1.0, 2.0)] * 3, "t double, m double"), t="t", m="m", reference=2.0)
