"""Candidates of the decontamination against a plain count, and the work they take."""

import numpy as np

from docquorum.llm import decontaminate as dc


def test_candidates_share_slots_and_sums_are_made_once(monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}".encode() for k in range(400)]

    def words(n):
        return [vocabulary[k] for k in rng.integers(0, len(vocabulary), n)]

    space = np.vstack([rng.standard_normal((dc.SLOTS, 6)), np.zeros((1, 6))]).astype(np.float32)
    wanted = [words(n) for n in (5, 14, 30, 70, 130)]
    items = dc._Items([(k, b" ".join(w).decode()) for k, w in enumerate(wanted)], space)
    tokens = [words(9) + w + words(11) for w in wanted] + [[], words(3), wanted[1], words(200)]
    hashes = [dc.hashes_of(t) for t in tokens]

    sums, cumsum = [], np.cumsum
    monkeypatch.setattr(dc.np, "cumsum", lambda a, *r, **k: sums.append(np.ndim(a)) or cumsum(a, *r, **k))
    found = list(dc._candidates(tokens, hashes, space, items, -1.0, 0.5))
    assert sums.count(2) == 1  # before: anew for every width of a passage

    expected = set()
    for width, (numbers, _) in items.by_width.items():
        around = max(len(wanted[n]) for n in numbers)
        for d, t in enumerate(tokens):
            end = -(-len(t) // dc.STEP) * dc.STEP
            for at in range(0, end, width // 2):
                if at and at + width // 2 > end - dc.STEP:
                    continue
                for n in set(numbers.tolist()):
                    size = len(wanted[n])
                    near = t[max(0, at - around):at + width + around]
                    if sum(items.holds[n, s] for s in dc.slots_of(near)) >= 0.5 * size:
                        expected.add((d, n, at, width))
    assert expected and {c[:4] for c in found} == expected
