import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bwt

strings = st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=5)


@settings(max_examples=80, deadline=None)
@given(st.lists(strings, min_size=1, max_size=4), st.integers(1, 40))
def test_merge(groups, depth):
    shards = [bwt.build([np.array(s, np.int64) for s in g]) for g in groups]
    z, place, common = bwt.merge(shards, depth)
    rows = []
    for k, p in zip(z, place, strict=True):
        s = shards[k]
        x = s.suffix[p]
        rows.append(tuple(s.text[x : x + np.flatnonzero(s.text[x:] == 0)[0]].tolist()))
    assert sorted(r[:depth] for r in rows) == [r[:depth] for r in rows]
    for i in range(1, len(rows)):
        n = 0
        while n < min(len(rows[i]), len(rows[i - 1])) and rows[i][n] == rows[i - 1][n]:
            n += 1
        assert common[i] == min(n, depth)
    again = bwt.repeated(common, depth)
    for i, r in enumerate(rows):
        assert again[i] == (len(r) >= depth and sum(x[:depth] == r[:depth] for x in rows if len(x) >= depth) > 1)
