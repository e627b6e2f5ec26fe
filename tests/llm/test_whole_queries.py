"""Packing and the source mix as whole results against plain restatements of their rules."""

import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import packing, source_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = "doc_id bigint, text string, source string"


def texts(seed, n, most):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.choice((1, 2, rng.randint(1, most), rng.randint(1, most)))), rng.choice(["a", "b", "b", None])) for i in rng.sample(range(10 * n), n)]


def plain_pack(rows, lengths):
    """Every rule by search through plain lists."""
    top, costs = lengths[-1], {x: packing.default_cost(x) for x in lengths}
    pieces = [(i, n, p, p * top, min(top, n - p * top)) for i, n in rows for p in range(-(-n // top))]
    pieces.sort(key=lambda x: (-x[4], x[0], x[2]))
    best = None
    for longest in lengths:
        bins, stamp = [], 0  # [room, when it got that room, pieces]
        for k, piece in enumerate(pieces):
            size = piece[4]
            open_ = [b for b in bins if b[0] >= size]
            if open_:
                least = min(b[0] for b in open_)
                chosen = max((b for b in open_ if b[0] == least), key=lambda b: b[1])
            else:
                shortest = min(x for x in lengths if x >= size)
                unit = {x: costs[x] / (size + min(x - size, sum(q[4] for q in pieces[k + 1 :] if q[4] <= x - size))) for x in lengths if x == shortest or size <= x <= longest}
                chosen = [min(unit, key=lambda x: (unit[x], x)), 0, []]
                bins.append(chosen)
            stamp += 1
            chosen[0], chosen[1] = chosen[0] - size, stamp
            chosen[2].append(piece)
        kinds = [min(x for x in lengths if x >= sum(p[4] for p in b[2])) for b in bins]
        cost = sum(costs[x] for x in kinds)
        if best is None or cost < best[0]:
            best = (cost, bins, kinds)
    out = []
    for number, (b, kind) in enumerate(zip(best[1], best[2])):
        at, used = 0, sum(p[4] for p in b[2])
        for i, n, p, start, size in b[2]:
            out.append((i, n, p, start, size, number, kind, used, at))
            at += size
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_whole_packing_equals_the_plain_rules(spark, seed):
    rows = texts(seed, 150, 90)
    got = packing.pack(spark.createDataFrame(rows, KINDS), lengths=(8, 16, 32, 64)).collect()
    assert sorted(map(tuple, got)) == plain_pack([(i, len(WORD.findall(t))) for i, t, _ in rows], (8, 16, 32, 64))


def plain_draw(sizes, probs, seed):
    """The flight along the null space of documents and words, found by a singular value decomposition; then landing and exchange by trying everything."""
    p, draw = list(probs), iter(np.random.Generator(np.random.PCG64(seed)).random(len(sizes) + 8).tolist())
    while True:
        held = [i for i, x in enumerate(p) if 1e-9 < x < 1 - 1e-9][:3]
        if len(held) < 2 or len(held) == 2 and sizes[held[0]] != sizes[held[1]]:
            break
        s = [sizes[i] for i in held]
        u = np.array([1.0, -1.0, 0.0][: len(held)])
        if len(set(s)) > 1:
            u = np.linalg.svd(np.array([[1.0] * 3, s]))[2][-1]
            u *= np.sign(u @ [s[1] - s[2], s[2] - s[0], s[0] - s[1]])
            u[np.abs(u) < 1e-12] = 0
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(held, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(held, u) if x)
        step = up if next(draw) * (up + down) < down else -down
        for i, x in zip(held, u):
            p[i] += step * x
            p[i] = 0.0 if p[i] < 1e-9 else 1.0 if p[i] > 1 - 1e-9 else p[i]
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    meant, count = sum(sizes[i] * p[i] for i in left), sum(p[i] for i in left)
    for i, v in zip(left, min(product((0.0, 1.0), repeat=len(left)), key=lambda v: (abs(sum(sizes[i] * x for i, x in zip(left, v)) - meant), abs(sum(v) - count), v))):
        p[i] = v
    missing = sum(s * x for s, x in zip(sizes, probs)) - sum(s * x for s, x in zip(sizes, p))
    moves = [()] + [(i,) for i in range(len(p))] + [(i, j) for i in range(len(p)) if p[i] for j in range(len(p)) if not p[j]]
    for i in min(moves, key=lambda m: (abs(missing - sum(sizes[i] * (1 if not p[i] else -1) for i in m)), len(m), m)):
        p[i] = 1 - p[i]
    return p


@pytest.mark.parametrize("seed", range(3))
def test_whole_mix_equals_the_plain_rules(spark, seed):
    rows = texts(seed + 10, 90, 60)
    df = spark.createDataFrame(rows, KINDS)
    got = source_mix.mix(df).collect()
    hashes = dict(df.select("doc_id", F.xxhash64("doc_id", F.lit(17))).collect())
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    totals = Counter()
    for i, _, s in rows:
        totals[s] += size[i]
    goal = source_mix.targets(dict(totals))
    for number, s in enumerate(sorted(totals, key=lambda s: (s is None, s or ""))):
        ids = sorted((i for i, _, x in rows if x == s), key=lambda i: (-size[i], hashes[i], i))
        ratio = goal[s] / totals[s]
        base = int(ratio + 1e-9)
        drawn = plain_draw([size[i] for i in ids], [min(1.0, max(0.0, ratio - base))] * len(ids), [17, 0, number, 0])
        want = Counter((size[i], base + int(x)) for i, x in zip(ids, drawn))
        mine = [r for r in got if r["source"] == s]
        assert Counter((r["size"], r["copies"]) for r in mine) == want  # which of equally long ones moves is open
        assert all(r["target"] == pytest.approx(goal[s]) and r["source_size"] == totals[s] and r["taken"] == r["copies"] * r["size"] for r in mine)
