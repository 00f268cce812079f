"""Connected components against a plain union of the same edges."""
import random

import pytest

from shopaudit.llm import graph


def _plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("chunk, most", [(2 ** 20, 2), (300, 12)])
def test_components(spark, monkeypatch, chunk, most):
    """Few edges take no round, whatever their partitions; edges of several tasks take some."""
    written = []
    stored = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: written.append(name) or stored(df, name))
    monkeypatch.setattr(graph, "CHUNK", chunk, raising=False)
    pick = random.Random(5)
    path = pick.sample(range(10 ** 15), 600)
    edges = list(zip(path, path[1:])) + [(-1 - pick.randrange(900), -1 - pick.randrange(900)) for _ in range(700)] + [(2, 1), (1, 2), (2, 1), (7, 7)]
    found = graph.components(spark.createDataFrame(edges, "u long, v long").repartition(16)).collect()
    expected = _plain([e for e in edges if e[0] != e[1]])
    assert dict(map(tuple, found)) == expected and len(found) == len(expected)
    assert len(written) <= most
