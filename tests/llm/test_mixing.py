import numpy as np

from lectern.llm import mixing

GIVEN = "doc_id long, n_tokens long, p array<int>"


def test_scarce_domains_meet_their_targets(spark):
    """Toxic texts hold 0.84 % of the tokens and are to make up 2 %."""
    domains, targets = ["clean", "junk", "toxic"], mixing.TARGETS
    rows = [(k, 100, [990, 5, 5] if k % 2 else [1000, 0, 0]) for k in range(2000)]
    rows += [(3000 + k, 100, [0, 1000, 0]) for k in range(30)] + [(4000 + k, 100, [10, 0, 990]) for k in range(12)]
    rates = mixing.fit_rates(spark.createDataFrame(rows, GIVEN), domains, targets, "clean")
    expected = dict.fromkeys(domains, 0.0)
    for _, n, p in rows:
        rate = rates(np.array([p]) / 1000)[0]
        for d, x in zip(domains, p, strict=True):
            expected[d] += rate * n * x / 1000
    total = sum(expected.values())
    for d in domains:
        assert abs(expected[d] / total - targets[d]) < 0.02 * targets[d], (expected, rates.missing)


def test_what_no_rates_can_meet_is_told(spark):
    rows = [(k, 100, [1000, 0, 0]) for k in range(50)]
    rates = mixing.fit_rates(spark.createDataFrame(rows, GIVEN), ["clean", "junk", "toxic"], mixing.TARGETS, "clean")
    assert abs(rates.missing["toxic"] - 5000 * 2 / 97) < 1 and abs(rates.missing["clean"]) < 1


def test_rates_are_those_of_single_documents(spark):
    """The same descent, a document at a time, without profiles."""
    rng = np.random.default_rng(4)
    domains, targets = ["clean", "junk", "toxic"], {"clean": 0.9, "junk": 0.06, "toxic": 0.04}
    rows = []
    for k in range(300):
        p = np.floor(rng.dirichlet([4, 1, 1]) * 20).astype(int) * 50
        p[int(p.argmax())] += 1000 - p.sum()
        rows.append((k, int(rng.integers(0, 200)), p.tolist()))
    rates = mixing.fit_rates(spark.createDataFrame(rows, GIVEN), domains, targets, "clean")
    p, n = np.array([r[2] for r in rows]) / 1000, np.array([r[1] for r in rows], float)
    there = (p * n[:, None]).sum(axis=0)
    want = np.array([targets[d] for d in domains]) * there[0] / targets["clean"]
    assert (want <= there).all()
    every = there.sum()
    pairs = (p * n[:, None]).T @ p / every
    own = pairs.sum(axis=1)
    step = 1 / ((pairs / own[:, None]).sum(axis=1).max() + mixing.PULL)
    r, look, t = np.ones(len(rows)), np.ones(len(rows)), 1.0
    for _ in range(mixing.STEPS):
        residual = ((p * (n * look)[:, None]).sum(axis=0) - want) / every
        new = np.clip(look - step * (p @ (residual / own) + mixing.PULL * (look - 1)), 0, mixing.MOST)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, r, t = new + (t - 1) / t_next * (new - r), new, t_next
        if np.abs(residual).max() < 1e-5:
            break
    assert np.abs(rates(p) - r).max() < 1e-9
    reached = (p * (n * r)[:, None]).sum(axis=0)
    assert all(abs(rates.missing[d] - (want - reached)[k]) < 1e-6 for k, d in enumerate(domains))  # documents of many domains can't all be met; what is missed is told
