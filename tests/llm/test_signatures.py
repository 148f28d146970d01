import random
import zlib

import numpy as np

from matchloom.llm import entities


def test_minima_of_many_cores_are_those_of_each():
    r = random.Random(5)
    cores = ["".join(r.choice("ABCDE1") for _ in range(r.randint(1, 12))) for _ in range(200)] + ["", "A", "AB" * 60_000]
    a, b = entities._hashers()
    parts = list(entities._few(cores))
    assert [c for p in parts for c in p] == cores and len(parts) > 1 or len(parts[0]) == len(cores)
    got = np.vstack([entities.minima(p) for p in parts])
    for core, low in zip(cores, got):
        grams = {core[i : i + 2] for i in range(len(core) - 1)} | {core[-1:] + core[:1]}
        h = [zlib.crc32(g.encode()) & entities._PRIME for g in grams]
        assert low.tolist() == [min((x % entities._PRIME * int(p) + int(q)) % entities._PRIME for x in h) for p, q in zip(a, b)]
