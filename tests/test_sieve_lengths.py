"""The sieve's search for the lengths of names."""

import random

import numpy as np
import pyarrow as pa

from folioscope.operators import names


def test_few_lengths_are_tried_where_names_begin_alike(monkeypatch):
    rng = random.Random(3)
    begin = "".join(rng.choice("abcdef ") for _ in range(64))
    wanted = [begin + "".join(rng.choice("uvwxyz") for _ in range(n)) for n in range(64)]
    data, at = names._utf8(pa.array(wanted))
    table = np.zeros(1 << 12, np.uint64)
    places = names._places(data, at, 64, 64 * len(table))
    np.bitwise_or.at(table, (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))
    texts = [begin + "ghi" * 30] * 200 + [f"{w} gh" for w in wanted]
    tried, hit = [], names.Sieve._hit

    def counted(self, h, k):
        tried.append(len(h) if k == 3 else 0)
        return hit(self, h, k)

    monkeypatch.setattr(names.Sieve, "_hit", counted)
    data, at = names._utf8(pa.array(texts))
    found = [np.concatenate(x) for x in zip(*names.Sieve(table, list(range(64, 128))).found(data, at), strict=True)]
    ends = {(int(r), int(n)) for r, p, n in zip(*found, strict=True) if p == at[r]}
    assert {(i, 64) for i in range(200)} | {(200 + i, 64 + i) for i in range(64)} <= ends
    assert sum(tried) < 8 * len(texts)
