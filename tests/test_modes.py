"""k-modes by combinations of values, against a plain form over rows."""

import numpy as np

from loomwright.operators import clustering as C


def plain(values, modes, rounds=100):
    """The last modes whose cost was less than that before, and their cost."""
    cost = None
    for _ in range(rounds):
        off = (values[:, None] != modes[None]).sum(2)
        at, now = off.argmin(1), int(off.min(1).sum())
        if cost is not None and now >= cost:
            break
        cost, modes = now, modes.copy()
        for j in range(len(modes)):
            for c in range(values.shape[1]):
                seen, n = np.unique(values[at == j, c], return_counts=True)
                if len(seen):
                    modes[j, c] = max(zip(n, seen, strict=True))[1]
    return (values[:, None] != modes[None]).sum(2).min(1).sum(), cost


def test_modes_come_from_combinations_and_not_from_rows(spark, monkeypatch):
    rng, seen, one_pass = np.random.default_rng(4), [], C._modes_pass
    data = np.array([["abcde"[k] for k in r] for r in rng.geometric(0.4, (400, 4)).clip(1, 5) - 1])
    df = spark.createDataFrame([(i, *map(str, r)) for i, r in enumerate(data)], "id long, p string, q string, r string, s string").repartition(3)
    monkeypatch.setattr(C, "MODES_A_TABLE", 3)
    monkeypatch.setattr(C, "_modes_pass", lambda kinds, *a: seen.append(kinds.count()) or one_pass(kinds, *a))
    kinds = len({tuple(r) for r in data})
    first = np.array(C.first_modes(df, ["p", "q", "r", "s"], 8))
    assert len(first) == 8 and kinds < 400
    for k in (3, 8):
        seen.clear()
        got = sorted(C.kmodes(df, "id", ["p", "q", "r", "s"], k).collect())
        assert [r["id"] for r in got] == list(range(400)) and sum(r["mismatches"] for r in got) == plain(data, first[:k])[0]
        assert len(seen) > 1 and set(seen) == {kinds}
