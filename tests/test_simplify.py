"""Streets against walks from end to end."""

import random

from waymend.operators import simplify


def test_streets(spark):
    rng = random.Random(11)
    ways = [(k, k + 1, 2.0) for k in range(300)] + [(k + 1, k, 2.0) for k in range(300)]
    ways += [(150, 400, 1.0), (400, 401, 1.5), (401, 402, 1.0), (402, 160, 2.0)]
    ways += [(500, 501, 1.0), (501, 502, 1.0), (502, 500, 1.0), (600, 601, 3.0), (601, 602, 3.0), (602, 601, 3.0), (602, 603, 1.0), (603, 602, 1.0)]
    ways += [(700, 700, 1.0), (700, 701, 1.0), (701, 702, 1.0), (701, 702, 9.0), (703, 701, 1.0)]
    ways += [(a, b, float(rng.randrange(1, 9))) for a, b in {(rng.randrange(800, 830), rng.randrange(800, 830)) for _ in range(40)}]
    length = {}
    for u, v, w in ways:
        length[u, v] = min(w, length.get((u, v), w))
    out, into = {}, {}
    for u, v in length:
        out.setdefault(u, set()).add(v)
        into.setdefault(v, set()).add(u)
    nodes = set(out) | set(into)

    def passes(x):
        o, i = out.get(x, set()), into.get(x, set())
        return x not in o and len(o | i) == 2 and len(o) == len(i) and len(o) > 0

    want = {}
    for u in nodes:
        for v in out.get(u, ()) if not passes(u) else ():
            prev, cur, far, parts = u, v, length[u, v], 1
            while passes(cur):
                (nxt,) = (out[cur] | into[cur]) - {prev}
                far, parts = far + length[cur, nxt], parts + 1
                prev, cur = cur, nxt
            if cur != u:
                want[u, cur] = min(want.get((u, cur), (far, parts)), (far, parts))
    df = spark.createDataFrame(ways, "u long, v long, length double").repartition(3)
    assert {r.id: r.ends for r in simplify.street_ends(df).collect()} == {x: not passes(x) for x in nodes}
    got = {(r.u, r.v): (r.length, r.parts) for r in simplify.simplified(df).collect()}
    assert got == want and got[0, 150] == (300.0, 150) and got[150, 160] == (5.5, 4) and (160, 150) in got
