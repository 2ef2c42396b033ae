"""DuckDB statements for the queries of catalog.py."""

from __future__ import annotations

from ..operators.raster import gaussian_line
from .views import DENSE, SIDE, SPARSE, tile, with_views

S = SIDE
NEIGHBOURS = "(VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) o(dy, dx)"

NODES = ("nodes", "SELECT u AS id FROM {e} UNION SELECT v FROM {e}")
SYM = ("sym", "SELECT u, v, w FROM {e} UNION ALL SELECT v, u, w FROM {e}")
REACH = ("reach(s, n) AS", "SELECT id, id FROM nodes UNION SELECT s, v FROM reach JOIN sym ON sym.u = n")
#: As NODES and REACH, over all nodes, lone ones too.
ALL_NODES = ("nodes", "SELECT id FROM all_nodes UNION SELECT u FROM {e} UNION SELECT v FROM {e}")
LABELS = ("labels", "SELECT s AS node, min(n) AS component FROM reach GROUP BY s")
DEGREE = ("deg", "SELECT id, count(*) AS degree FROM (SELECT u AS id FROM {e} UNION ALL SELECT v FROM {e}) GROUP BY id")
DIST = (
    "dist(s, n, d) USING KEY (s, n) AS",
    "SELECT id, id, CAST(0 AS BIGINT) FROM nodes UNION "
    "SELECT x.s, x.v, x.d FROM (SELECT dist.s, sym.v, min(dist.d + sym.w) AS d FROM dist JOIN sym ON sym.u = dist.n GROUP BY 1, 2) x "
    "LEFT JOIN recurring.dist k ON k.s = x.s AND k.n = x.v WHERE k.d IS NULL OR x.d < k.d",
)


def graph(e: str, *steps: tuple[str, str]) -> list[tuple[str, str]]:
    return [(n, sql.format(e=e)) for n, sql in steps]


SCORE = graph(
    "edges",
    ("tight", "SELECT a.s, a.n AS u, b.n AS v FROM dist a JOIN sym ON sym.u = a.n JOIN dist b ON b.s = a.s AND b.n = sym.v AND a.d + sym.w = b.d"),
    ("walk(s, n, k) AS", "SELECT id, id, CAST(1 AS DOUBLE) FROM nodes UNION ALL SELECT walk.s, tight.v, sum(k) FROM walk JOIN tight ON tight.s = walk.s AND tight.u = walk.n GROUP BY 1, 2"),
    ("paths", "SELECT s, n, sum(k) AS k FROM walk GROUP BY 1, 2"),
    ("dp", "SELECT s, n, d, k FROM dist JOIN paths USING (s, n)"),
    ("part", "SELECT sv.n AS id, sum(sv.k * vt.k / st.k) AS score FROM dp sv JOIN dp vt ON vt.s = sv.n JOIN dp st ON st.s = sv.s AND st.n = vt.n AND sv.d + vt.d = st.d WHERE sv.n <> sv.s AND vt.n <> sv.n AND st.n <> st.s GROUP BY 1"),
    ("score", "SELECT id, coalesce(score, 0) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2) AS score FROM nodes LEFT JOIN part USING (id)"),
)
G = graph("edges", NODES, SYM)
GB = graph("broken_edges", NODES, SYM)
GA = graph("broken_edges", ALL_NODES, SYM)
BC = [*G, *graph("edges", DIST), *SCORE]
RANK = "ORDER BY round(score, 9) DESC, id"

DRAW = "CAST('0x' || substr(md5(concat(attempt, '-{x}')), 1, 8) AS BIGINT) % {n}"
OD = [
    ("place", "SELECT node AS id, component, row_number() OVER (ORDER BY node) - 1 AS rank FROM labels"),
    ("spots", "SELECT closed, place.rank AS spot, (SELECT count(*) FROM place) - CASE WHEN place.rank IS NULL THEN 0 ELSE 1 END AS room FROM closures LEFT JOIN place ON place.id = closed"),
    ("d0", f"SELECT closed, spot, attempt, {DRAW.format(x='u', n='room')} AS i, {DRAW.format(x='v', n='(room - 1)')} AS j FROM spots, range({{attempts}}) r(attempt) WHERE room > 1"),
    ("d1", "SELECT closed, spot, attempt, i, j + CASE WHEN j >= i THEN 1 ELSE 0 END AS j FROM d0"),
    ("d2", "SELECT closed, attempt, i + CASE WHEN i >= spot THEN 1 ELSE 0 END AS i, j + CASE WHEN j >= spot THEN 1 ELSE 0 END AS j FROM d1"),
    ("attempts", "SELECT closed, attempt, a.id AS u, b.id AS v, a.component = b.component AS connected FROM d2 JOIN place a ON a.rank = i JOIN place b ON b.rank = j"),
    ("od", "SELECT closed, attempt, u, v FROM attempts WHERE connected QUALIFY row_number() OVER (PARTITION BY closed ORDER BY attempt) <= {pairs}"),
]


def od(attempts: int, pairs: int) -> list[tuple[str, str]]:
    return [(n, sql.replace("{attempts}", str(attempts)).replace("{pairs}", str(pairs))) for n, sql in OD]


WAYS = [
    ("ways", "SELECT deg.id, a.y, a.x, CASE WHEN sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) < 1e-6 THEN 0 ELSE (a.y - b.y) / sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) END AS dy, "
     "CASE WHEN sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) < 1e-6 THEN 0 ELSE (a.x - b.x) / sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) END AS dx "
     "FROM deg JOIN sym ON sym.u = deg.id JOIN gpos a ON a.id = deg.id JOIN gpos b ON b.id = sym.v WHERE degree = 1"),
]


def bridges(distance: float, angle: float) -> list[tuple[str, str]]:
    return [
        *GA, *graph("broken_edges", DEGREE), *WAYS,
        ("near", f"SELECT a.id AS u, b.id AS v, sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS dist, a.dy AS ua, a.dx AS ub, b.dy AS va, b.dx AS vb, b.y - a.y AS ty, b.x - a.x AS tx FROM ways a JOIN ways b ON a.id < b.id AND sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) <= {distance}"),
        ("angled", "SELECT u, v, dist, degrees(acos(greatest(-1, least(1, (ua * ty + ub * tx) / greatest(dist, 1e-6))))) AS angle_u, degrees(acos(greatest(-1, least(1, -(va * ty + vb * tx) / greatest(dist, 1e-6))))) AS angle_v FROM near"),
        ("cand", f"SELECT * FROM angled WHERE angle_u <= {angle} AND angle_v <= {angle}"),
    ]


SHOWN = "u, v, round(dist, 6) AS dist, round(angle_u, 4) AS angle_u, round(angle_v, 4) AS angle_v"
FOREST = [
    ("c", "SELECT *, row_number() OVER (ORDER BY dist, u, v) AS k FROM ends"),
    ("cs", "SELECT k, a, b FROM c UNION ALL SELECT k, b, a FROM c"),
    ("hop(k, n) AS", "SELECT k, a FROM c UNION SELECT hop.k, cs.b FROM hop JOIN cs ON cs.a = hop.n AND cs.k < hop.k"),
    ("forest", "SELECT u, v, dist, angle_u, angle_v FROM c WHERE a <> b AND NOT EXISTS (SELECT 1 FROM hop WHERE hop.k = c.k AND hop.n = c.b)"),
]
PLAIN_ENDS = ("ends", "SELECT *, u AS a, v AS b FROM cand")
STRICT_ENDS = ("ends", "SELECT cand.*, x.component AS a, y.component AS b FROM cand JOIN labels x ON x.node = u JOIN labels y ON y.node = v")


def forest(distance: float, angle: float, strict: bool = False) -> list[tuple[str, str]]:
    return [*bridges(distance, angle), *([*graph("broken_edges", REACH, LABELS), STRICT_ENDS] if strict else [PLAIN_ENDS]), *FOREST]


ADJ = ("adj", f"SELECT m.tile_id, m.y, m.x, n.y AS ny, n.x AS nx FROM mask m, {NEIGHBOURS} JOIN mask n ON n.tile_id = m.tile_id AND n.y = m.y + dy AND n.x = m.x + dx")
KIND = ("kind", "SELECT m.tile_id, m.y, m.x, coalesce(k, 0) AS degree FROM mask m LEFT JOIN (SELECT tile_id, y, x, count(*) AS k FROM adj GROUP BY ALL) USING (tile_id, y, x)")


def pid(tile: str, y: str, x: str) -> str:
    return f"((CAST({tile} AS BIGINT) * 1048576 + {y}) * 1048576 + {x})"


ELLIPSE = "(SELECT dy, dx FROM range(-4, 5) a(dy), range(-4, 5) b(dx) WHERE abs(dx) <= round(sqrt(16 - dy * dy)))"
DILATED = ("wide", f"SELECT DISTINCT tile_id, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x FROM mask, {ELLIPSE} WHERE y + dy BETWEEN 0 AND {S - 1} AND x + dx BETWEEN 0 AND {S - 1}")
STARTS = "(VALUES (0), (24), (32))"
PATCHES = ("patches", f"SELECT tile_id, format('patch_y{{}}_x{{}}', ys, xs) AS patch_id, ys AS y_start, xs AS x_start, y - ys AS y, x - xs AS x FROM mask, {STARTS} a(ys), {STARTS} b(xs) WHERE y BETWEEN ys AND ys + 31 AND x BETWEEN xs AND xs + 31")
CROSS = "(VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)) o(dy, dx)"


def eroded(of: str) -> str:
    return (
        f"SELECT m.tile_id, m.y, m.x FROM {of} m, {CROSS} LEFT JOIN {of} n ON n.tile_id = m.tile_id AND n.y = m.y + dy AND n.x = m.x + dx "
        f"WHERE n.y IS NOT NULL OR m.y + dy NOT BETWEEN 0 AND {S - 1} OR m.x + dx NOT BETWEEN 0 AND {S - 1} GROUP BY ALL HAVING count(*) = 5"
    )


def opened(of: str) -> str:
    return f"SELECT DISTINCT tile_id, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x FROM {of}, {CROSS} WHERE y + dy BETWEEN 0 AND {S - 1} AND x + dx BETWEEN 0 AND {S - 1}"


MORPH = [(f"e{k + 1}", eroded("mask" if k == 0 else f"e{k}")) for k in range(12)]
MORPH += [(f"s{k}", f"SELECT * FROM {'mask' if k == 0 else f'e{k}'} EXCEPT SELECT * FROM ({opened(f'e{k + 1}')})") for k in range(12)]

RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
THIN = [
    ("ring", "SELECT m.tile_id, m.y, m.x, " + ", ".join(f"max(CASE WHEN ny - m.y = {dy} AND nx - m.x = {dx} THEN 1 ELSE 0 END) AS p{k}" for k, (dy, dx) in enumerate(RING)) + " FROM mask m LEFT JOIN adj ON adj.tile_id = m.tile_id AND adj.y = m.y AND adj.x = m.x GROUP BY ALL"),
]
TURNS = " + ".join(f"CASE WHEN p{k} = 0 AND p{(k + 1) % 8} = 1 THEN 1 ELSE 0 END" for k in range(8))
COUNT = " + ".join(f"p{k}" for k in range(8))


#: Sub-iterations of thinning that settle the test masks.
THIN_STEPS = 16


def thin(k: int) -> list[tuple[str, str]]:
    """One sub-iteration: thin<k> to thin<k + 1>."""
    of = "mask" if k == 0 else f"thin{k}"
    corners = "p0 * p2 * p4 = 0 AND p2 * p4 * p6 = 0" if k % 2 == 0 else "p0 * p2 * p6 = 0 AND p0 * p4 * p6 = 0"
    ring = "SELECT m.tile_id, m.y, m.x, " + ", ".join(f"max(CASE WHEN n.y - m.y = {dy} AND n.x - m.x = {dx} THEN 1 ELSE 0 END) AS p{j}" for j, (dy, dx) in enumerate(RING)) + f" FROM {of} m CROSS JOIN {NEIGHBOURS} LEFT JOIN {of} n ON n.tile_id = m.tile_id AND n.y = m.y + dy AND n.x = m.x + dx GROUP BY ALL"
    return [(f"thin{k + 1}", f"SELECT tile_id, y, x FROM ({ring}) WHERE NOT ({COUNT} BETWEEN 2 AND 6 AND {TURNS} = 1 AND {corners})")]


def cubic(m: int, n: int = S) -> str:
    """j, k, w: the weight of old place j of n for new place k of m."""
    at = f"((k + 0.5::DOUBLE) * {n} / {m} - 0.5)"
    d = "abs(place - (base + o))"
    return (
        f"SELECT least(greatest(CAST(base + o AS INT), 0), {n - 1}) AS j, k, CASE WHEN {d} <= 1 THEN (1.25 * {d} - 2.25) * {d} * {d} + 1 WHEN {d} < 2 THEN ((-0.75 * {d} + 3.75) * {d} - 6) * {d} + 3 ELSE 0 END AS w "
        f"FROM (SELECT k, {at} AS place, floor({at}) AS base FROM range({m}) r(k)), range(-1, 3) s(o)"
    )


def mirror(at: str) -> str:
    return f"CASE WHEN {at} < 0 THEN -({at}) WHEN {at} > {S - 1} THEN {2 * S - 2} - ({at}) ELSE {at} END"


def blurred(weights: list[float], columns: list[str]) -> tuple[list[tuple[str, str]], str]:
    """Steps and statement of a blur down the columns and along the rows."""
    taps = ", ".join(f"({d - len(weights) // 2}, {w!r}::DOUBLE)" for d, w in enumerate(weights))
    down = ", ".join(f"sum(n.{c} * w) AS {c}" for c in columns)
    done = ", ".join(f"round(sum(n.{c} * w), 6) AS {c}" for c in columns)
    steps = [("k(d, w)", f"VALUES {taps}"), ("down", f"SELECT g.tile_id, g.y, g.x, {down} FROM dense g CROSS JOIN k JOIN dense n ON n.tile_id = g.tile_id AND n.x = g.x AND n.y = {mirror('g.y + d')} GROUP BY ALL")]
    return steps, f"SELECT g.tile_id, g.y, g.x, {done} FROM down g CROSS JOIN k JOIN down n ON n.tile_id = g.tile_id AND n.y = g.y AND n.x = {mirror('g.x + d')} GROUP BY ALL"


def turned(of: str) -> str:
    """Two steps and a statement: the images of a step flipped, turned and brightened."""
    return (
        f"d AS (SELECT tile_id, {chance('horizontal')} < 0.5 AS h, {chance('vertical')} < 0.5 AS v, CASE WHEN {chance('turn')} < 0.5 THEN CAST(floor(4 * {chance('quarters')}) AS INT) ELSE 0 END AS q, {chance('bright')} < 0.3 AS l, 1 + 0.2::DOUBLE * (2 * {chance('scale')} - 1) AS k, 255 * 0.2::DOUBLE * (2 * {chance('shift')} - 1) AS m FROM (SELECT DISTINCT tile_id FROM {of})), "
        f"f AS (SELECT {of}.tile_id, CASE WHEN v THEN {S - 1} - y ELSE y END AS y, CASE WHEN h THEN {S - 1} - x ELSE x END AS x, q, " + ", ".join(f"CASE WHEN l THEN CAST(least(255, greatest(0, floor({c} * k + m))) AS INT) ELSE {c} END AS {c}" for c in "rgb") + f" FROM {of} JOIN d USING (tile_id)) "
        f"SELECT tile_id, CAST(CASE q WHEN 1 THEN {S - 1} - x WHEN 2 THEN {S - 1} - y WHEN 3 THEN x ELSE y END AS INT) AS y, CAST(CASE q WHEN 1 THEN y WHEN 2 THEN {S - 1} - x WHEN 3 THEN {S - 1} - y ELSE x END AS INT) AS x, r, g, b FROM f"
    )


def drawn(name: str, *more: str) -> str:
    """From 0 up to 1 by MD5 of the tile, the seed, a name and columns."""
    text = ", ".join(["tile_id", f"'-42-{name}'", *(x for c in more for x in ("'-'", c))])
    return f"(CAST('0x' || substr(md5(concat({text})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def shape(kind: str, count: int) -> str:
    """The shapes of a kind on tiles of S pixels, where radiuses are the least ones or drawn from the canopy's range."""
    number = lambda name, low, high: f"CAST({low} + floor({drawn(f'{kind}-{name}', 'k')} * {high - low + 1}) AS INT)"
    share = lambda name, low, high: f"{low}::DOUBLE + {drawn(f'{kind}-{name}', 'k')} * ({high}::DOUBLE - {low}::DOUBLE)"
    own = {
        "shadow": f"20 AS radius, {number('b', 3, 6)} AS corners, {share('c', 0.25, 0.55)} AS light",
        "canopy": f"{number('a', 25, 59)} AS rx, {number('b', 25, 59)} AS ry, {number('c', 0, 179)} AS turn, {number('d', 90, 129)} AS green",
        "cloud": f"40 AS rx, 40 AS ry, 0 AS turn, {share('b', 0.6, 0.9)} AS opacity",
    }[kind]
    return f"SELECT tile_id, k, {number('x', 0, S - 1)} AS cx, {number('y', 0, S - 1)} AS cy, {own} FROM (SELECT DISTINCT tile_id FROM dense), range({count}) r(k)"


def ellipse_pixels(kind: str) -> str:
    dy, dx, cos, sin = "(p.y - cy)", "(p.x - cx)", "cos(radians(turn))", "sin(radians(turn))"
    return f"SELECT p.tile_id, k, p.y, p.x FROM {kind}_shape s JOIN dense p ON p.tile_id = s.tile_id WHERE (({dx} * {cos} + {dy} * {sin}) / rx) ** 2 + (({dy} * {cos} - {dx} * {sin}) / ry) ** 2 <= 1"


#: Corners by angle; a pixel is inside if an odd number of edges cross its row at or left of it, or if it lies on an edge.
POLYGONS = [
    ("ray", f"SELECT tile_id, k, i, cy, cx, 2 * pi() * {drawn('shadow-angle', 'k', 'i')} AS angle, radius * (0.6::DOUBLE + {drawn('shadow-reach', 'k', 'i')} * (1.2::DOUBLE - 0.6::DOUBLE)) AS reach FROM shadow_shape JOIN range(6) r(i) ON i < corners"),
    ("corner", "SELECT tile_id, k, row_number() OVER (PARTITION BY tile_id, k ORDER BY angle, i) AS at, CAST(trunc(cy + reach * sin(angle)) AS INT) AS y, CAST(trunc(cx + reach * cos(angle)) AS INT) AS x, count(*) OVER (PARTITION BY tile_id, k) AS n FROM ray"),
    ("side", "SELECT a.tile_id, a.k, a.y AS ya, a.x AS xa, b.y AS yb, b.x AS xb FROM corner a JOIN corner b ON b.tile_id = a.tile_id AND b.k = a.k AND b.at = a.at % a.n + 1"),
    ("cross_at", f"SELECT *, CASE WHEN ya = yb THEN xa ELSE xa + (y - ya) * (xb - xa) / CAST(yb - ya AS DOUBLE) END AS x FROM side JOIN range({S}) r(y) ON y BETWEEN least(ya, yb) AND greatest(ya, yb)"),
    ("shadow_px", "SELECT tile_id, k, y, x FROM (SELECT p.tile_id, c.k, p.y, p.x, sum(CASE WHEN ya <> yb AND c.y < greatest(ya, yb) AND c.x <= p.x THEN 1 ELSE 0 END) % 2 = 1 AS inside, "
     "bool_or(CASE WHEN ya <> yb AND c.y < greatest(ya, yb) THEN c.x = p.x ELSE false END) AS touches, bool_or(CASE WHEN ya = yb THEN p.x BETWEEN least(xa, xb) AND greatest(xa, xb) ELSE p.x = floor(c.x + 0.5) END) AS drawn "
     "FROM dense p JOIN cross_at c ON c.tile_id = p.tile_id AND c.y = p.y GROUP BY 1, 2, 3, 4) WHERE inside OR touches OR drawn"),
]


def covered(kind: str, size: int, cells: str = "dense") -> list[tuple[str, str]]:
    """<kind>_cover: tile_id, k, y, x, cover of a kind's pixels <kind>_px, blurred."""
    taps = ", ".join(f"({d - size // 2}, {w!r}::DOUBLE)" for d, w in enumerate(gaussian_line(size)))
    return [
        (f"{kind}_w(d, w)", f"VALUES {taps}"),
        (f"{kind}_down", f"SELECT g.tile_id, m.k, g.y, m.x, sum(w) AS c FROM (SELECT DISTINCT tile_id, y FROM {cells}) g CROSS JOIN {kind}_w JOIN {kind}_px m ON m.tile_id = g.tile_id AND m.y = {mirror('g.y + d')} GROUP BY ALL"),
        (f"{kind}_cover", f"SELECT m.tile_id, m.k, m.y, g.x, sum(m.c * w) AS cover FROM (SELECT DISTINCT x FROM {cells}) g CROSS JOIN {kind}_w JOIN {kind}_down m ON m.x = {mirror('g.x + d')} GROUP BY ALL"),
    ]


def occluded(shadows: int, canopies: int, clouds: int) -> list[tuple[str, str]]:
    """Steps up to `out`: the dense tiles' images under their shapes."""
    counts = {"shadow": shadows, "canopy": canopies, "cloud": clouds}
    steps = [(f"{kind}_shape", shape(kind, n)) for kind, n in counts.items()] + POLYGONS + [(f"{kind}_px", ellipse_pixels(kind)) for kind in ("canopy", "cloud")]
    for kind, size in (("shadow", 21), ("canopy", 31), ("cloud", 51)):
        steps += covered(kind, size)
    steps.append(("o0", "SELECT tile_id, y, x, CAST(floor(p * 250) AS DOUBLE) AS r, CAST(y * 2 + 90 AS DOUBLE) AS g, CAST(trunc(x * 3 + t * 40) AS DOUBLE) AS b FROM dense"))
    laid = [(kind, k) for kind, n in counts.items() for k in range(n)]
    for j, (kind, k) in enumerate(laid):
        c = "coalesce(cover, 0)"
        new = {
            "shadow": {x: f"{x} * (1 - {c} * (1 - light))" for x in "rgb"},
            "canopy": {x: f"{x} * (1 - {c}) + {c} * {y}" for x, y in zip("rgb", ("25", "green", "30"))},
            "cloud": {x: f"{x} * (1 - {c} * opacity) + {c} * opacity * {y}" for x, y in zip("rgb", (240, 245, 250))},
        }[kind]
        steps.append((f"o{j + 1}", f"SELECT o.tile_id, o.y, o.x, {', '.join(f'{e} AS {x}' for x, e in new.items())} FROM o{j} o LEFT JOIN {kind}_cover m ON m.tile_id = o.tile_id AND m.y = o.y AND m.x = o.x AND m.k = {k} LEFT JOIN {kind}_shape s ON s.tile_id = o.tile_id AND s.k = {k}"))
    return [*steps, ("out", "SELECT tile_id, y, x, " + ", ".join(f"CAST(floor(least(255, greatest(0, round({c}, 6)))) AS INT) AS {c}" for c in "rgb") + f" FROM o{len(laid)}")]


def chance(name: str) -> str:
    return f"(CAST('0x' || substr(md5(concat(tile_id, '-42-{name}')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def conv(name: str, col: str, kernel: list[tuple[int, int, int]]) -> tuple[str, str]:
    values = ", ".join(f"({dy}, {dx}, {w})" for dy, dx, w in kernel)
    return name, f"SELECT g.tile_id, g.y, g.x, sum(coalesce(n.{col}, 0) * k) AS {name} FROM dense g, (VALUES {values}) o(dy, dx, k) LEFT JOIN dense n ON n.tile_id = g.tile_id AND n.y = g.y + dy AND n.x = g.x + dx GROUP BY ALL"


SOBEL_X = [(-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1)]
SOBEL_Y = [(-1, -1, -1), (-1, 0, -2), (-1, 1, -1), (1, -1, 1), (1, 0, 2), (1, 1, 1)]
LAP = [(-1, 0, 1), (0, -1, 1), (0, 0, -4), (0, 1, 1), (1, 0, 1)]
EDGE = [
    conv("gxp", "p", SOBEL_X), conv("gyp", "p", SOBEL_Y), conv("gxt", "t", SOBEL_X), conv("gyt", "t", SOBEL_Y),
    ("sob", "SELECT tile_id, y, x, sqrt(gxp ** 2 + gyp ** 2 + 1e-6) AS edge_p, sqrt(gxt ** 2 + gyt ** 2 + 1e-6) AS edge_t FROM gxp JOIN gyp USING (tile_id, y, x) JOIN gxt USING (tile_id, y, x) JOIN gyt USING (tile_id, y, x)"),
]
LAPS = [conv("lp", "p", LAP), conv("lt", "t", LAP)]
DICE = "(SELECT 1 - (2 * sum(p * t) + 1) / (sum(p) + sum(t) + 1) FROM dense)"
BCE = "(SELECT avg(greatest(ln(p / (1 - p)), 0) - ln(p / (1 - p)) * t + ln(1 + exp(-abs(ln(p / (1 - p)))))) FROM dense)"
BOUND = "(SELECT avg(abs(edge_p - edge_t)) FROM sob)"
CONN = "(SELECT avg(CASE WHEN abs(lt) < 0.5 THEN abs(lp) * t ELSE 0 END) FROM dense JOIN lp USING (tile_id, y, x) JOIN lt USING (tile_id, y, x))"

MOST_LINKED = "SELECT id AS closed FROM deg ORDER BY degree DESC, id LIMIT {n}"
LINKED = lambda n: [*graph("edges", DEGREE), ("closures", MOST_LINKED.format(n=n))]

ROADS = [int(S * s) for s in (0.25, 0.5, 0.75)], [int(S * s) for s in (0.2, 0.5, 0.8)]
BENDS = [(int(S * b), int(S * a)) for a, b in ((0.1, 0.1), (0.4, 0.35), (0.7, 0.85))]


def near_segment(a: tuple[int, int], b: tuple[int, int]) -> str:
    dy, dx = b[0] - a[0], b[1] - a[1]
    t = f"greatest(0, least(1, ((y - {a[0]}) * {dy} + (x - {a[1]}) * {dx}) / {dy * dy + dx * dx}.0::DOUBLE))"
    return f"sqrt((y - ({a[0]} + {t} * {dy})) ** 2 + (x - ({a[1]} + {t} * {dx})) ** 2) <= 2.5"


ROAD = " OR ".join([*(f"abs(y - {r}) <= 3.5" for r in ROADS[0]), *(f"abs(x - {c}) <= 3.5" for c in ROADS[1]), near_segment(BENDS[0], BENDS[1]), near_segment(BENDS[1], BENDS[2])])


def image(k: int) -> str:
    parts = ", ".join(f"CAST(sum({c}) * {k} % 256 AS INT) AS {n}" for n, c in (("r", "l_partkey"), ("g", "l_suppkey"), ("b", "l_orderkey")))
    return f"SELECT {tile(SPARSE)} AS tile_id, CAST(l_partkey % {S} AS INT) AS y, CAST(l_orderkey % {S} AS INT) AS x, {parts} FROM lineitem GROUP BY 1, 2, 3"


FAR = (
    "far(c, s, n, d) USING KEY (c, s, n) AS",
    "SELECT DISTINCT closed, u, u, CAST(0 AS BIGINT) FROM od UNION SELECT x.c, x.s, x.v, x.d FROM (SELECT far.c, far.s, sym.v, min(far.d + sym.w) AS d FROM far JOIN sym ON sym.u = far.n WHERE sym.v <> far.c GROUP BY 1, 2, 3) x "
    "LEFT JOIN recurring.far k ON k.c = x.c AND k.s = x.s AND k.n = x.v WHERE k.d IS NULL OR x.d < k.d",
)
CLOSE = [
    ("closures", f"SELECT id AS closed FROM score {RANK} LIMIT 3"),
    *graph("edges", REACH, LABELS),
    *od(1000, 100),
    ("base", "SELECT od.*, d AS base FROM od JOIN dist ON s = u AND n = v"),
    FAR,
    ("trips", "SELECT base.*, far.d AS after, max(base) OVER (PARTITION BY closed) * 5.0::DOUBLE AS worst FROM base LEFT JOIN far ON c = closed AND s = u AND n = v"),
    ("sums", "SELECT closed, avg(base) AS b, avg(coalesce(CAST(after AS DOUBLE), worst)) AS p, count(*) - count(after) AS severed, count(*) AS total FROM trips GROUP BY 1"),
    ("km", "SELECT u AS closed, sum(w) / 1000 AS km FROM sym GROUP BY 1"),
]

def feistel(v: str) -> str:
    """v moved on: its digits h and l of bases a and b."""
    draw = lambda k, half: f"CAST('0x' || substr(md5(concat('42-', epoch, '-{k}-', {half})), 1, 8) AS BIGINT)"
    high, low = f"({v} // b)", f"({v} % b)"
    for k in (0, 2):
        high = f"(({high} + {draw(k, low)}) % a)"
        low = f"(({low} + {draw(k + 1, high)}) % b)"
    return f"({high} * b + {low})"


#: Numbers outside the rows go on until they fall inside.
EPOCHS = (
    "WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), s AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM n), q AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM s), "
    "r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part), "
    f"walk(epoch, p_partkey, v, n, a, b) AS (SELECT epoch, p_partkey, {feistel('i')}, n, a, b FROM r, q, range(3) e(epoch) UNION ALL SELECT epoch, p_partkey, {feistel('v')}, n, a, b FROM walk WHERE v >= n) "
    "SELECT CAST(epoch AS INT) AS epoch, v // 64 AS batch, v % 64 AS place, p_partkey FROM walk WHERE v < n"
)
#: All pixels of the raster near each segment, whatever tile they are in.
WAY_TILES = (
    f"WITH p AS (SELECT s_suppkey // 4 AS way, s_suppkey AS pos, (13.2::DOUBLE - (12.89::DOUBLE + s_suppkey * 37 % 101 / 101.0::DOUBLE * 0.32::DOUBLE)) / (13.2::DOUBLE - 12.9::DOUBLE) * {16 * S - 1} AS y, (77.49::DOUBLE + s_suppkey * 53 % 97 / 97.0::DOUBLE * 0.42::DOUBLE - 77.5::DOUBLE) / (77.9::DOUBLE - 77.5::DOUBLE) * {16 * S - 1} AS x FROM supplier), "
    "s AS (SELECT y AS ya, x AS xa, lead(y) OVER w AS yb, lead(x) OVER w AS xb FROM p WINDOW w AS (PARTITION BY way ORDER BY pos, y, x)), "
    f"c AS (SELECT s.*, unnest(range(greatest(0, CAST(floor(least(ya, yb) - 1.5) AS INT)), least({16 * S - 1}, CAST(ceil(greatest(ya, yb) + 1.5) AS INT)) + 1)) AS y FROM s WHERE yb IS NOT NULL), "
    f"d AS (SELECT c.*, unnest(range(greatest(0, CAST(floor(least(xa, xb) - 1.5) AS INT)), least({16 * S - 1}, CAST(ceil(greatest(xa, xb) + 1.5) AS INT)) + 1)) AS x FROM c), "
    "t AS (SELECT *, CASE WHEN ya = yb AND xa = xb THEN 0 ELSE greatest(0, least(1, ((y - ya) * (yb - ya) + (x - xa) * (xb - xa)) / greatest((yb - ya) ** 2 + (xb - xa) ** 2, 1e-9))) END AS k FROM d) "
    f"SELECT DISTINCT CAST(y // {S} * 16 + x // {S} AS INT) AS tile_id, CAST(y % {S} AS INT) AS y, CAST(x % {S} AS INT) AS x FROM t WHERE (y - (ya + k * (yb - ya))) ** 2 + (x - (xa + k * (xb - xa))) ** 2 <= 2.25"
)
#: A street passes through a node if its ways come in from one of two neighbours and leave to the other, in one direction or both.
STREETS = [
    ("way", "SELECT u, v, w AS length FROM broken_edges UNION ALL SELECT v, u, w FROM broken_edges WHERE w % 3 <> 0"),
    ("junction", "SELECT id, count(DISTINCT other) AS n, sum(o) AS o, sum(i) AS i FROM (SELECT u AS id, v AS other, 1 AS o, 0 AS i FROM way UNION ALL SELECT v, u, 0, 1 FROM way) GROUP BY id"),
    ("street_end", "SELECT id, NOT (n = 2 AND o = i AND o IN (1, 2)) AS ends FROM junction"),
]
LATTICE = "(SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS side FROM supplier)"


def normal(name: str, *place: str) -> str:
    drawn = "md5(concat('42-" + name + "', " + ", ".join(f"'-', {p}" for p in place) + "))"
    u, v = (f"((CAST('0x' || substr({drawn}, {at}, 8) AS BIGINT) + 1) / 4294967297.0::DOUBLE)" for at in (1, 9))
    return f"(sqrt(-2 * ln({u})) * cos(2 * pi() * {v}))"


TERRAIN = (
    f"WITH tiles AS (SELECT DISTINCT {tile(DENSE)} AS tile_id FROM lineitem), coarse AS (SELECT tile_id, y, x, {normal('coarse', 'tile_id', 'y', 'x')} AS noise FROM tiles, range({S // 4}) a(y), range({S // 4}) b(x)), "
    f"w AS ({cubic(S, S // 4)}), down AS (SELECT tile_id, w.k AS y, x, sum(noise * w) AS noise FROM coarse JOIN w ON w.j = y GROUP BY 1, 2, 3), "
    "wide AS (SELECT tile_id, y, w.k AS x, 1 / (1 + exp(-3 * sum(noise * w))) AS m FROM down JOIN w ON w.j = x GROUP BY 1, 2, 3) "
    "SELECT tile_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, " + ", ".join(f"CAST(floor(least(255, greatest(0, round({a} * m + {b} * (1 - m) + 10 * {normal(c, 'tile_id', 'y', 'x')}, 6)))) AS INT) AS {c}" for c, a, b in zip("rgb", (34, 112, 45), (140, 120, 95))) + " FROM wide"
)

SQL: dict[str, str] = {
    "graph_summary": with_views("broken_edges all_nodes", [*GA, *graph("broken_edges", REACH, LABELS)], "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM broken_edges) AS edges, (SELECT count(DISTINCT component) FROM labels) AS components"),
    "connected_components": with_views("edges", [*G, *graph("edges", REACH, LABELS)], "SELECT node, component FROM labels"),
    "node_degree": with_views("edges gpos", graph("edges", DEGREE), "SELECT id, coalesce(degree, 0) AS degree FROM gpos LEFT JOIN deg USING (id)"),
    "betweenness": with_views("edges", BC, "SELECT id, round(score, 6) AS score FROM score"),
    "betweenness_with_lone_nodes": with_views("broken_edges all_nodes", [*GA, *graph("broken_edges", DIST), *SCORE], "SELECT id, round(score, 6) AS score FROM score"),
    "betweenness_by_blocks": with_views("broken_edges all_nodes", [*GA, *graph("broken_edges", DIST), *SCORE], "SELECT id, round(score, 6) AS score FROM score"),
    "articulation_points": with_views(
        "broken_edges", [*GB, ("rest(x, s, n) AS", "SELECT u, v, v FROM sym UNION SELECT x, s, v FROM rest JOIN sym ON sym.u = n WHERE v <> x"), ("piece", "SELECT x, s, min(n) AS piece FROM rest GROUP BY 1, 2")],
        "SELECT x AS id, count(DISTINCT piece) AS n_blocks FROM piece GROUP BY 1 HAVING count(DISTINCT piece) > 1",
    ),
    "gatekeeper_topn": with_views("edges gpos", [*BC, *graph("edges", DEGREE)], f"SELECT id, round(round(score, 9), 6) AS score, degree, round(y, 6) AS y, round(x, 6) AS x, degree <= 1 AS is_endpoint FROM score JOIN deg USING (id) JOIN gpos USING (id) {RANK} LIMIT 10"),
    "top_gatekeeper": with_views("edges", BC, f"SELECT id, round(round(score, 9), 6) AS score FROM score {RANK} LIMIT 1"),
    "node_closure": with_views(
        "edges", [*BC, *CLOSE],
        "SELECT closed AS closed_node_id, round(CASE WHEN severed = total THEN 0 ELSE greatest(0, least(1, b / greatest(p, 1e-6))) END, 6) AS resilience_index, "
        "round(CASE WHEN severed = total THEN CAST('inf' AS DOUBLE) ELSE (p - b) / greatest(b, 1e-6) * 100 END, 6) AS travel_time_impact_pct, round(km, 6) AS affected_segment_length_km, "
        "severed > 0 AS disconnected, CAST(severed AS BIGINT) AS disconnected_pair_count, CAST(total AS BIGINT) AS total_pairs_evaluated, round(b, 6) AS baseline_avg_length_m, round(p, 6) AS perturbed_avg_length_m FROM sums JOIN km USING (closed)",
    ),
    "od_sample": with_views("edges", [*G, *graph("edges", REACH, LABELS), *LINKED(1), *od(1000, 100)], "SELECT closed, attempt, u, v FROM od"),
    "topological_accuracy": with_views(
        "edges gpos", [*G, *graph("edges", REACH, LABELS, DIST), ("closures", "SELECT CAST(NULL AS BIGINT) AS closed"), *od(50, 50),
        ("t", "SELECT connected, d, sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) * 10 AS direct FROM attempts JOIN gpos a ON a.id = u JOIN gpos b ON b.id = v LEFT JOIN dist ON s = u AND n = v")],
        "SELECT round(coalesce(avg(CASE WHEN connected THEN abs(d - direct) / greatest(direct, 1e-3) END), 0) * 100, 6) AS mean_error_pct, round(100.0::DOUBLE * sum(CAST(connected AS INT)) / count(*), 6) AS reachable_pct FROM t",
    ),
    "topological_accuracy_of_truth": with_views(
        "broken_edges edges gpos all_nodes", [*GA, *graph("broken_edges", REACH, LABELS, DIST), ("closures", "SELECT CAST(NULL AS BIGINT) AS closed"), *od(50, 50),
        ("tsym", "SELECT u, v, w FROM edges UNION ALL SELECT v, u, w FROM edges"), ("tn", "SELECT DISTINCT u AS id FROM tsym"),
        (DIST[0].replace("dist", "tdist"), DIST[1].replace("sym", "tsym").replace("FROM nodes", "FROM tn").replace("dist", "tdist")),
        ("t", "SELECT connected, dist.d AS d, coalesce(tdist.d, sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) * 10) AS direct FROM attempts JOIN gpos a ON a.id = u JOIN gpos b ON b.id = v LEFT JOIN dist ON dist.s = u AND dist.n = v LEFT JOIN tdist ON tdist.s = u AND tdist.n = v")],
        "SELECT round(coalesce(avg(CASE WHEN connected THEN abs(d - direct) / greatest(direct, 1e-3) END), 0) * 100, 6) AS mean_error_pct, round(100.0::DOUBLE * sum(CAST(connected AS INT)) / count(*), 6) AS reachable_pct FROM t",
    ),
    "reachability": with_views("broken_edges all_nodes", [*GA, *graph("broken_edges", REACH, LABELS), ("closures", "SELECT CAST(NULL AS BIGINT) AS closed"), *od(200, 200)], "SELECT attempt, u, v, connected AS reachable FROM attempts"),
    "shortest_paths": with_views("edges", [*G, *graph("edges", DIST)], "SELECT s AS src, n AS node, d AS dist FROM dist"),
    "overlay_distances": with_views("edges", [*G, *LINKED(3), *graph("edges", DIST)], "SELECT s AS src, n AS node, d AS dist FROM dist WHERE s IN (SELECT closed FROM closures)"),
    "overlay_closures": with_views("edges", [*G, *graph("edges", REACH, LABELS), *LINKED(1), *od(1000, 100), FAR], "SELECT closed, attempt, od.u, od.v, far.d AS after FROM od LEFT JOIN far ON c = closed AND s = od.u AND n = od.v"),
    "parallel_edge_min": with_views("multi_edges", [], "SELECT least(u, v) AS u, greatest(u, v) AS v, min(length) AS weight, arg_min(highway, (length, highway)) AS highway FROM multi_edges GROUP BY 1, 2"),
    "affected_km": with_views("edges", G, "SELECT u AS id, round(sum(w) / 1000, 6) AS km FROM sym GROUP BY 1"),
    "node_removal": with_views("edges", LINKED(3), "SELECT closed, u, v, w FROM edges, closures WHERE u <> closed AND v <> closed"),
    "node_location": with_views("edges gpos", G, "SELECT id, round(y, 6) AS y, round(x, 6) AS x FROM nodes JOIN gpos USING (id)"),
    "edge_geometry": with_views("edges gpos", [], "SELECT u, v, round(a.y, 6) AS yu, round(a.x, 6) AS xu, round(b.y, 6) AS yv, round(b.x, 6) AS xv FROM edges JOIN gpos a ON a.id = u JOIN gpos b ON b.id = v"),
    "edge_style": with_views("edges", LINKED(1), "SELECT u, v, CASE WHEN hit THEN 'red' ELSE 'green' END AS colour, CASE WHEN hit THEN 5 ELSE 2 END AS width, CASE WHEN hit THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS opacity FROM (SELECT *, u IN (SELECT closed FROM closures) OR v IN (SELECT closed FROM closures) AS hit FROM edges)"),
    "node_style": with_views("edges", [*G, *LINKED(5)], "SELECT id, CASE WHEN id = (SELECT closed FROM closures LIMIT 1) THEN 'red' WHEN id IN (SELECT closed FROM closures) THEN 'orange' ELSE 'blue' END AS colour, CASE WHEN id = (SELECT closed FROM closures LIMIT 1) THEN 10 WHEN id IN (SELECT closed FROM closures) THEN 7 ELSE 4 END AS radius FROM nodes"),
    "kpi_flags": "SELECT l_orderkey, l_linenumber, 1 - l_discount * 3 < 0.8 AS index_low, l_tax * 100 > 5 AS impact_high FROM lineitem",
    "validate_location": "SELECT c_custkey, c_acctbal / 100 BETWEEN -90 AND 90 AND c_custkey % 400 - 200 BETWEEN -180 AND 180 AND c_custkey * 7 % 6000 BETWEEN 100 AND 5000 AS valid FROM customer",
    "binarize_threshold": f"WITH q AS (SELECT {tile(DENSE)} AS tile_id, CAST(l_partkey % {S} AS INT) AS y, CAST(l_orderkey % {S} AS INT) AS x, max(l_discount) AS p FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT tile_id, y, x, CASE WHEN tile_id % 2 = 0 THEN p * 10 ELSE p * 2550 END AS p FROM q), t AS (SELECT *, max(p) OVER (PARTITION BY tile_id) AS top FROM s) SELECT tile_id, y, x FROM t WHERE p > CASE WHEN top > 1 THEN 0.5 * 255 ELSE 0.5 END",
    "occlusion_mask": f"WITH a AS ({image(1)}), b AS ({image(2)}) SELECT tile_id, y, x FROM a JOIN b USING (tile_id, y, x) WHERE (abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b)) / 3 > 60",
    "overlay_roads": with_views("mask", [("i", image(1))], "SELECT i.tile_id, i.y, i.x, " + ", ".join(f"CAST(CASE WHEN mask.y IS NULL THEN {c} ELSE floor({c} * (1 - 0.6::DOUBLE) + 200 * 0.6::DOUBLE) END AS INT) AS {c}" for c in "rgb") + " FROM i LEFT JOIN mask ON mask.tile_id = i.tile_id AND mask.y = i.y AND mask.x = i.x"),
    "mask_summary": with_views("mask", [], "SELECT tile_id, count(*) AS road_pixels FROM mask GROUP BY 1"),
    "mask_set_ops": with_views("mask pred", [], "SELECT 'and' AS op, * FROM (SELECT * FROM mask INTERSECT SELECT * FROM pred) UNION ALL SELECT 'or', * FROM (SELECT * FROM mask UNION SELECT * FROM pred) UNION ALL SELECT 'minus', * FROM (SELECT * FROM mask EXCEPT SELECT * FROM pred)"),
    "geo_to_pixel": "SELECT c_custkey, CAST(trunc((90 - c_acctbal / 100) / 180 * 511) AS INT) AS py, CAST(trunc((c_custkey % 360 - 180 + 180.0::DOUBLE) / 360 * 511) AS INT) AS px FROM customer",
    "positional_split": "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderpriority) * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM orders",
    "running_best": "SELECT event_id, coalesce(value >= max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM events",
    "endpoint_trajectory": with_views("broken_edges gpos", [*GB, *graph("broken_edges", DEGREE), *WAYS], "SELECT id, round(dy, 6) AS dy, round(dx, 6) AS dx FROM ways"),
    "angular_deviation": "SELECT vec_id, round(degrees(acos(greatest(-1, least(1, (a * c + b * d) / sqrt(a * a + b * b) / sqrt(c * c + d * d))))), 4) AS degrees FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings)",
    "endpoint_range_join": with_views("broken_edges gpos all_nodes", bridges(60, 90), "SELECT u, v, round(dist, 6) AS dist FROM near"),
    "candidate_bridges": with_views("broken_edges gpos all_nodes", bridges(60, 90), f"SELECT {SHOWN} FROM cand"),
    "heal_bridges": with_views("broken_edges gpos all_nodes", forest(60, 90), f"SELECT {SHOWN} FROM forest"),
    "heal_bridges_narrow": with_views("broken_edges gpos all_nodes", forest(30, 45), f"SELECT {SHOWN} FROM forest"),
    "heal_bridges_strict": with_views("broken_edges gpos all_nodes", forest(60, 90, True), f"SELECT {SHOWN} FROM forest"),
    "heal_bridges_of_one_component": with_views("edges gpos", [], "SELECT CAST(0 AS BIGINT) AS u, CAST(0 AS BIGINT) AS v, 0::DOUBLE AS dist, 0::DOUBLE AS angle_u, 0::DOUBLE AS angle_v FROM edges WHERE false"),
    "heal_summary": with_views(
        "broken_edges gpos all_nodes", [*forest(60, 90), *graph("broken_edges", REACH, LABELS), ("s2", "SELECT u, v FROM sym UNION SELECT u, v FROM forest UNION SELECT v, u FROM forest"), ("r2(s, n) AS", "SELECT id, id FROM nodes UNION SELECT s, v FROM r2 JOIN s2 ON s2.u = n")],
        "SELECT (SELECT count(*) FROM forest) AS healed_edges_added, (SELECT count(DISTINCT component) FROM labels) AS components_before, (SELECT count(DISTINCT m) FROM (SELECT s, min(n) AS m FROM r2 GROUP BY s)) AS components_after, (SELECT count(*) FROM cand) AS candidate_bridges_evaluated",
    ),
    "connectivity_ratio": with_views(
        "broken_edges gpos all_nodes", [*forest(60, 90), *graph("broken_edges", REACH, LABELS), ("s2", "SELECT u, v FROM sym UNION SELECT u, v FROM forest UNION SELECT v, u FROM forest"), ("r2(s, n) AS", "SELECT id, id FROM nodes UNION SELECT s, v FROM r2 JOIN s2 ON s2.u = n"),
        ("a", "SELECT max(k) AS k FROM (SELECT component, count(*) AS k FROM labels GROUP BY 1)"), ("b", "SELECT max(k) AS k FROM (SELECT m, count(*) AS k FROM (SELECT s, min(n) AS m FROM r2 GROUP BY 1) GROUP BY 1)")],
        "SELECT a.k AS largest_before, b.k AS largest_after, round(b.k / a.k, 6) AS connectivity_gain, round(b.k / (SELECT count(*) FROM nodes), 6) AS connectivity_coverage FROM a, b",
    ),
    "pixel_adjacency": with_views("mask", [ADJ], "SELECT * FROM adj"),
    "pixel_classify": with_views("mask", [ADJ, KIND], "SELECT *, CASE WHEN degree <= 1 THEN 'endpoint' WHEN degree = 2 THEN 'interior' ELSE 'intersection' END AS kind FROM kind"),
    "component_area_filter": with_views("mask", [ADJ, ("walk(t, y, x, a, b) AS", "SELECT tile_id, y, x, y, x FROM mask UNION SELECT t, walk.y, walk.x, ny, nx FROM walk JOIN adj ON adj.tile_id = t AND adj.y = a AND adj.x = b")], "SELECT t AS tile_id, y, x FROM walk GROUP BY 1, 2, 3 HAVING count(*) >= 15"),
    "pixel_components": with_views("mask", [ADJ, ("walk(t, y, x, a, b) AS", "SELECT tile_id, y, x, y, x FROM mask UNION SELECT t, walk.y, walk.x, ny, nx FROM walk JOIN adj ON adj.tile_id = t AND adj.y = a AND adj.x = b")], f"SELECT t AS tile_id, y, x, min({pid('t', 'a', 'b')}) AS label FROM walk GROUP BY 1, 2, 3"),
    "mask_dilate": with_views("mask", [DILATED], "SELECT * FROM wide"),
    "mask_iou_dice": with_views("mask pred", [("b", "SELECT tile_id, p.y AS py, t.y AS ty FROM (SELECT *, 1 AS k FROM pred) p FULL JOIN mask t USING (tile_id, y, x)")], "SELECT tile_id, round(count(CASE WHEN py IS NOT NULL AND ty IS NOT NULL THEN 1 END) / count(*), 6) AS iou, round(2 * count(CASE WHEN py IS NOT NULL AND ty IS NOT NULL THEN 1 END) / (count(py) + count(ty)), 6) AS dice FROM b GROUP BY 1"),
    "mask_relaxed_iou": with_views("mask pred", [DILATED, ("u", "SELECT tile_id, count(*) AS u FROM (SELECT * FROM mask UNION SELECT * FROM pred) GROUP BY 1"), ("i", "SELECT tile_id, count(*) AS i FROM (SELECT * FROM pred INTERSECT SELECT * FROM wide) GROUP BY 1")], "SELECT tile_id, round(least(1, coalesce(i, 0) / u), 6) AS relaxed_iou FROM u LEFT JOIN i USING (tile_id)"),
    "relaxed_ious": with_views("mask pred", [("far", f"SELECT p.tile_id, p.y, p.x, min(greatest(abs(p.x - m.x) - 0.5::DOUBLE, 0) ** 2 + (p.y - m.y) ** 2) AS d FROM pred p JOIN mask m USING (tile_id) GROUP BY 1, 2, 3"),
        ("u", "SELECT tile_id, count(*) AS u FROM (SELECT * FROM mask UNION SELECT * FROM pred) GROUP BY 1")],
        "SELECT u.tile_id, CAST(t AS INT) AS tolerance, round(least(1, (SELECT count(*) FROM far WHERE far.tile_id = u.tile_id AND d <= t * t) / u), 6) AS relaxed_iou FROM u, (VALUES (0), (1), (2), (4), (8)) r(t)"),
    "distance_to_mask": with_views("mask pred", [("far", f"SELECT p.tile_id, p.y, p.x, min(CAST((p.x - m.x) ** 2 + (p.y - m.y) ** 2 AS DOUBLE)) AS d2 FROM pred p JOIN mask m USING (tile_id) GROUP BY 1, 2, 3")], "SELECT tile_id, y, x, d2 FROM far"),
    "occlusion_recall": with_views("mask pred occ", [("h", "SELECT * FROM mask INTERSECT SELECT * FROM occ"), ("k", "SELECT tile_id, count(*) AS n, count(p.y) AS k FROM h LEFT JOIN (SELECT tile_id, y, x FROM pred) p USING (tile_id, y, x) GROUP BY 1")], "SELECT t.tile_id, round(coalesce((SELECT count(*) FROM h JOIN pred USING (tile_id, y, x) WHERE h.tile_id = t.tile_id) / nullif((SELECT count(*) FROM h WHERE h.tile_id = t.tile_id), 0), 1), 6) AS recall FROM (SELECT DISTINCT tile_id FROM mask) t"),
    "extract_patches": with_views("mask", [PATCHES], "SELECT tile_id, patch_id, y_start, x_start, y, x FROM patches"),
    "stitch_patches": with_views("mask", [], "SELECT tile_id, y, x, 255.0::DOUBLE AS value FROM mask"),
    "punch_hole": with_views("mask", [], f"SELECT * FROM mask WHERE (y - {S // 2}) ** 2 + (x - {S // 2}) ** 2 > 225"),
    "flip_rotate": with_views("mask", [], f"SELECT tile_id, 'horizontal' AS variant, y, {S - 1} - x AS x FROM mask UNION ALL SELECT tile_id, 'vertical', {S - 1} - y, x FROM mask UNION ALL SELECT tile_id, 'rot90', {S - 1} - x, y FROM mask"),
    "morph_skeleton": with_views("mask", MORPH, " UNION ".join(f"SELECT tile_id, y, x FROM s{k}" for k in range(12))),
    "thinning_step": with_views("mask", [ADJ, *THIN], f"SELECT tile_id, y, x FROM ring WHERE NOT ({COUNT} BETWEEN 2 AND 6 AND {TURNS} = 1 AND p0 * p2 * p4 = 0 AND p2 * p4 * p6 = 0)"),
    "skeletonize": with_views("mask", [step for k in range(THIN_STEPS) for step in thin(k)], f"SELECT tile_id, y, x FROM thin{THIN_STEPS}"),
    "skeleton_nodes": with_views("mask", [ADJ, KIND], f"SELECT {pid('tile_id', 'y', 'x')} AS id, tile_id, y, x, degree, degree <= 1 AS is_endpoint FROM kind WHERE degree <> 2"),
    "skeleton_graph": with_views(
        "mask", [ADJ, KIND,
        ("links", f"SELECT {pid('a.tile_id', 'a.y', 'a.x')} AS a, {pid('a.tile_id', 'a.ny', 'a.nx')} AS b, k.degree = 2 AS inside, m.degree = 2 AS n_inside, sqrt(abs(a.y - a.ny) + abs(a.x - a.nx)) AS step FROM adj a JOIN kind k ON k.tile_id = a.tile_id AND k.y = a.y AND k.x = a.x JOIN kind m ON m.tile_id = a.tile_id AND m.y = a.ny AND m.x = a.nx"),
        ("inr", f"SELECT {pid('tile_id', 'y', 'x')} AS a FROM kind WHERE degree = 2"), ("il", "SELECT a, b, step FROM links WHERE inside AND n_inside"), ("iw(s, n) AS", "SELECT a, a FROM inr UNION SELECT s, b FROM iw JOIN il ON il.a = n"), ("ch", "SELECT s AS a, min(n) AS chain FROM iw GROUP BY 1"),
        ("wi", "SELECT chain, sum(step) AS w FROM il JOIN ch USING (a) WHERE a < b GROUP BY 1"), ("en", "SELECT chain, min(b) AS u, max(b) AS v, sum(step) AS e, count(*) AS n FROM links JOIN ch USING (a) WHERE inside AND NOT n_inside GROUP BY 1"),
        ("every", "SELECT a AS u, b AS v, step AS len FROM links WHERE NOT inside AND NOT n_inside AND a < b UNION ALL SELECT u, v, e + coalesce(w, 0) FROM en LEFT JOIN wi USING (chain) WHERE n = 2 AND u <> v")],
        "SELECT u, v, round(min(len) * 10, 6) AS weight, round(min(len), 6) AS length_px FROM every GROUP BY 1, 2",
    ),
    "skeleton_paths": with_views(
        "mask", [ADJ, KIND,
        ("links", f"SELECT {pid('a.tile_id', 'a.y', 'a.x')} AS a, {pid('a.tile_id', 'a.ny', 'a.nx')} AS b, k.degree = 2 AS inside, m.degree = 2 AS n_inside, CAST(abs(a.y - a.ny) = 1 AND abs(a.x - a.nx) = 1 AS INT) AS across FROM adj a JOIN kind k ON k.tile_id = a.tile_id AND k.y = a.y AND k.x = a.x JOIN kind m ON m.tile_id = a.tile_id AND m.y = a.ny AND m.x = a.nx"),
        ("walk(u, first, prev, cur, k, n_across, open) AS", "SELECT a, b, a, b, 1, across, n_inside FROM links WHERE NOT inside UNION ALL SELECT u, first, cur, b, k + 1, n_across + across, n_inside FROM walk JOIN links ON a = cur AND b <> prev WHERE open"),
        ("done", "SELECT u, first, cur AS v, k, n_across, k - n_across + n_across * sqrt(2::DOUBLE) AS len FROM walk WHERE NOT open AND u < cur"),
        ("best", "SELECT u, v, arg_min(first, (len, first)) AS first FROM done GROUP BY 1, 2")],
        "SELECT u, v, CAST(k AS INT) AS pos, CAST(cur // 1048576 % 1048576 AS INT) AS y, CAST(cur % 1048576 AS INT) AS x FROM best JOIN walk USING (u, first) UNION ALL SELECT u, v, 0, CAST(u // 1048576 % 1048576 AS INT), CAST(u % 1048576 AS INT) FROM best",
    ),
    "polyline_length": "WITH s AS (SELECT l_orderkey AS path_id, sqrt((l_partkey % 97 - lag(l_partkey % 97) OVER w) ** 2 + (l_suppkey % 89 - lag(l_suppkey % 89) OVER w) ** 2) AS step FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 97, l_suppkey % 89)) SELECT path_id, round(coalesce(sum(step), 0), 6) AS length FROM s GROUP BY 1",
    "rasterize_ways": f"WITH p AS (SELECT {tile(SPARSE)} AS tile_id, l_orderkey AS way, l_linenumber AS pos, CAST(l_orderkey % 48 + l_suppkey % 16 AS DOUBLE) AS y, CAST(l_linenumber * 9 - 8 AS DOUBLE) AS x FROM lineitem), "
    "s AS (SELECT tile_id, y AS ya, x AS xa, lead(y) OVER w AS yb, lead(x) OVER w AS xb FROM p WINDOW w AS (PARTITION BY tile_id, way ORDER BY pos, y, x)), "
    f"c AS (SELECT s.*, unnest(range(greatest(0, CAST(floor(least(ya, yb) - 1.5) AS INT)), least({S - 1}, CAST(ceil(greatest(ya, yb) + 1.5) AS INT)) + 1)) AS y FROM s WHERE yb IS NOT NULL), "
    f"d AS (SELECT c.*, unnest(range(greatest(0, CAST(floor(least(xa, xb) - 1.5) AS INT)), least({S - 1}, CAST(ceil(greatest(xa, xb) + 1.5) AS INT)) + 1)) AS x FROM c), "
    "t AS (SELECT *, CASE WHEN ya = yb AND xa = xb THEN 0 ELSE greatest(0, least(1, ((y - ya) * (yb - ya) + (x - xa) * (xb - xa)) / greatest((yb - ya) ** 2 + (xb - xa) ** 2, 1e-9))) END AS k FROM d) "
    "SELECT DISTINCT tile_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM t WHERE (y - (ya + k * (yb - ya))) ** 2 + (x - (xa + k * (xb - xa))) ** 2 <= 2.25",
    "normalise": f"WITH i AS ({image(1)}) SELECT tile_id, y, x, round(r / 255, 6) AS r, round(g / 255, 6) AS g, round(b / 255, 6) AS b FROM i",
    "swap_channels": f"WITH i AS ({image(1)}) SELECT tile_id, y, x, b AS r, g, r AS b FROM i",
    "occlusion_shapes": with_views("dense", [("shadow_shape", shape("shadow", 3)), *POLYGONS], "SELECT tile_id, CAST(k AS INT) AS k, y, x FROM shadow_px"),
    "occlude": with_views("dense", occluded(3, 2, 1), "SELECT * FROM out"),
    "augment": "WITH i AS (" + image(1) + "), " + turned("i"),
    "occluded_variants": with_views("dense", occluded(2, 2, 1), "SELECT * FROM (WITH " + turned("out") + ")"),
    "side_by_side": with_views("mask pred", [], f"SELECT tile_id, y, x, 255 AS r, 255 AS g, 255 AS b FROM mask UNION ALL SELECT tile_id, y, CAST(x + {S} AS INT), 127, 127, 127 FROM pred"),
    "gaussian_blur": with_views("dense", *blurred(gaussian_line(5, 1.0), ["p"])),
    "gaussian_blur_wide": with_views("dense", *blurred(gaussian_line(51), ["p", "t"])),
    "resize": with_views("dense", [("wy", cubic(24)), ("wx", cubic(40))], "SELECT tile_id, CAST(wy.k AS INT) AS y, CAST(wx.k AS INT) AS x, round(sum(sqrt(p) * wy.w * wx.w), 6) AS p FROM dense JOIN wy ON wy.j = y JOIN wx ON wx.j = x GROUP BY 1, 2, 3"),
    "epoch_means": "SELECT l_linenumber AS epoch, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss FROM lineitem GROUP BY 1",
    "epoch_batches": EPOCHS,
    "ways_to_tiles": WAY_TILES,
    "sample_rows": "SELECT p_partkey, p_name FROM part ORDER BY md5(concat(p_partkey, '-42')), p_partkey LIMIT 5",
    "synthetic_road_mask": f"SELECT tile_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT DISTINCT {tile(DENSE)} AS tile_id FROM lineitem), range({S}) a(y), range({S}) b(x) WHERE {ROAD}",
    "synthetic_tiles": TERRAIN,
    "grid_places": f"SELECT i AS id, round(12.97::DOUBLE + i // side * 0.003::DOUBLE, 6) AS lat, round(77.59::DOUBLE + i % side * 0.003::DOUBLE, 6) AS lon FROM {LATTICE}, range(side * side) r(i)",
    "network_around": with_views(
        "multi_edges all_nodes",
        [("spot", "SELECT id, 12.97::DOUBLE + id // 10 * 0.003::DOUBLE AS lat, 77.59::DOUBLE + id % 10 * 0.003::DOUBLE AS lon FROM all_nodes"),
         ("close", "SELECT id FROM spot WHERE 2 * 6371000 * asin(least(1, sqrt(sin(radians(12.985::DOUBLE - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(12.985::DOUBLE)) * sin(radians(77.605::DOUBLE - lon) / 2) ** 2))) <= 1500"),
         ("e", "SELECT least(u, v) AS u, greatest(u, v) AS v, min(length) AS weight, arg_min(highway, (length, highway)) AS highway FROM multi_edges WHERE u <> v AND u IN (SELECT id FROM close) AND v IN (SELECT id FROM close) GROUP BY 1, 2"),
         ("sym", "SELECT u, v FROM e UNION ALL SELECT v, u FROM e"), ("nodes", "SELECT DISTINCT u AS id FROM sym"), REACH, LABELS,
         ("big", "SELECT component FROM labels GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")],
        "SELECT e.* FROM e JOIN labels ON node = u WHERE component IN (SELECT component FROM big)",
    ),
    "grid_graph": f"WITH e AS (SELECT i AS u, i + 1 AS v FROM {LATTICE}, range(side * side) r(i) WHERE i % side < side - 1 UNION ALL SELECT i, i + side FROM {LATTICE}, range(side * (side - 1)) r(i)) SELECT u, v, 50 + CAST('0x' || substr(md5(concat(u, '-', v)), 1, 8) AS BIGINT) % 151 AS w FROM e",
    "street_ends": with_views("broken_edges", STREETS, "SELECT id, ends FROM street_end"),
    "simplified_streets": with_views(
        "broken_edges", [*STREETS, ("walk(u, prev, cur, length, parts) AS", "SELECT u, u, v, length, 1 FROM way JOIN street_end ON id = u AND ends UNION ALL SELECT walk.u, cur, way.v, walk.length + way.length, parts + 1 FROM walk JOIN street_end ON id = cur AND NOT ends JOIN way ON way.u = cur AND way.v <> prev"),
        ("street", "SELECT walk.u, cur AS v, length, parts FROM walk JOIN street_end ON id = cur AND ends WHERE walk.u <> cur")],
        "SELECT u, v, min(length) AS length, arg_min(parts, (length, parts)) AS parts FROM street GROUP BY 1, 2",
    ),
    "dice_loss": with_views("dense", [], f"SELECT round({DICE}, 6) AS dice_loss"),
    "bce_loss": with_views("dense", [], f"SELECT round({BCE}, 6) AS bce_loss"),
    "boundary_loss": with_views("dense", EDGE, f"SELECT round({BOUND}, 6) AS boundary_loss"),
    "connectivity_loss": with_views("dense", LAPS, f"SELECT round({CONN}, 6) AS connectivity_loss"),
    "composite_loss": with_views("dense", [*EDGE, *LAPS], f"SELECT round({DICE}, 6) AS dice_loss, round({BCE}, 6) AS bce_loss, round({BOUND}, 6) AS boundary_loss, round({CONN}, 6) AS connectivity_loss, round({DICE} * 1.0 + {BCE} * 0.5 + {BOUND} * 0.2 + {CONN} * 0.1, 6) AS total_loss"),
    "sobel_edges": with_views("dense", EDGE, "SELECT tile_id, y, x, round(edge_p, 6) AS edge_p, round(edge_t, 6) AS edge_t FROM sob"),
    "laplacian": with_views("dense", LAPS, "SELECT tile_id, y, x, round(lp, 6) + 0.0::DOUBLE AS lap_p, round(lt, 6) + 0.0::DOUBLE AS lap_t FROM lp JOIN lt USING (tile_id, y, x)"),
    "graphml_roundtrip": with_views("edges", [], "SELECT u, v, CAST(w AS DOUBLE) AS weight, round(w / 10, 6) AS length_px, false AS healed FROM edges"),
}
