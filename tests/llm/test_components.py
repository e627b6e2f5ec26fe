"""Connected components: right on paths, stars and odd links, with plans of a round that stay small for the driver."""

import random

from tidegate.llm import _components
from tidegate.llm._base import Scratch


def brute(links):
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        if a is not None and b is not None and a != b:
            i, j = sorted((find(a), find(b)))
            up[j] = i
    return {i: find(i) for i in list(up)}


def test_rounds_join_twice_and_release_the_driver(spark, monkeypatch):
    rng = random.Random(5)
    path = [rng.randrange(10**6) for _ in range(60)]
    links = list(zip(path, path[1:])) + [(7, -i) for i in range(1, 40)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    links += [(None, 7), (7, None), (9, 9), links[0], links[0][::-1]]
    plans, released = {}, []
    write, release = Scratch.table, _components.release
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or write(self, df, name))
    monkeypatch.setattr(_components, "release", lambda s: released.append(release(s)))
    got = _components.connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "components"), "cc")
    assert {r["node"]: r["component"] for r in got.collect()} == brute(links)
    rounds = [p for n, p in plans.items() if n.startswith("cc-") and "low" not in n and n != "cc-0"]
    assert len(rounds) > 2 and len(released) == len(rounds)
    assert all(p.count("Join ") <= 2 for p in rounds)
