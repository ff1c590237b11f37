"""Alignment of runs of siblings is one method, whatever the lists' length."""

import numpy as np
import pytest

from tidepanel.llm import html_text


@pytest.mark.parametrize("seed", range(30))
def test_runs_are_aligned_alike_at_every_length(seed, monkeypatch):
    rng = np.random.default_rng(seed)

    def runs(n, kinds):
        ends = np.cumsum(rng.integers(1, 4, n)).tolist()
        return [(f"t{k}", a, b) for k, a, b in zip(rng.integers(0, kinds, n).tolist(), [0, *ends], ends)]

    kinds = int(rng.integers(2, 40))
    xs, ys = runs(int(rng.integers(1, 90)), kinds), runs(int(rng.integers(1, 90)), kinds + 2)
    found = []
    for most in (0, 10**9):
        monkeypatch.setattr(html_text, "RUN_PAIRS", most)
        found.append(html_text.aligned_runs(xs, ys))
    assert found[0] == found[1]


def test_long_lists_find_most_partners():
    """A name that comes early on one side and late on the other leads a match in order astray."""
    xs = [(f"t{i}", i, i + 1) for i in range(2000)]
    ys = [(x[0], i, i + 1) for i, x in enumerate([*xs[1:], xs[0]])]
    assert html_text.aligned_runs(xs, ys) == [(i, i - 1) for i in range(1999, 0, -1)]
