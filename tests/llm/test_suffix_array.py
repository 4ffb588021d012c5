from __future__ import annotations

import random

import numpy as np
import pytest

from corvane.llm.ngram_counts import suffix_array


@pytest.mark.parametrize("seed", range(40))
def test_whole_suffixes(seed):
    random.seed(seed)
    texts = [[random.randint(1, 1 + seed % 4) for _ in range(random.randint(1, 30))] for _ in range(random.randint(1, 8))]
    texts += [texts[0]] * (seed % 3)
    first, record = np.array(sum(texts, [])), np.repeat(np.arange(len(texts)) * 2, [len(t) for t in texts])
    rest = [t[k:] for t in texts for k in range(len(t))]
    suffixes, common = suffix_array(first, record)
    assert suffixes.tolist() == sorted(range(len(rest)), key=lambda i: (rest[i], i))
    for i, j, n in zip(suffixes, suffixes[1:], common):
        a, b = rest[i], rest[j]
        assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
