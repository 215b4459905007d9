"""DuckDB SQL of the spectral and stencil queries: planes are lists of 64 values, p, in row order."""

from __future__ import annotations

import math

_PLANES = "p0 AS (SELECT label AS capture_id, vec_id AS frame_idx, list_transform(embedding, lambda v: v::DOUBLE + {offset}::DOUBLE) AS p FROM embeddings)"
_OUT = "SELECT capture_id, frame_idx, px::INT AS px, round({plane}[px + 1], 6) AS v FROM {source}, range(64) r(px)"


def _cell(of: str, x: str, y: str) -> str:
    """The value at (x, y), with repeated edges."""
    return f"{of}[least(greatest({y}, 0), 7) * 8 + least(greatest({x}, 0), 7) + 1]"


def _each(value: str) -> str:
    return f"list_transform(range(64), lambda q: {value})"


def blur(of: str, into: str, source: str, to: str, sigma: float) -> str:
    """CTEs from source to `to` with a column `into`: of under a separable Gaussian with repeated edges."""
    radius = max(1, math.ceil(3 * sigma))
    raw = [math.exp(-0.5 * (j / sigma) ** 2) for j in range(-radius, radius + 1)]
    taps = [(j, w / sum(raw)) for j, w in zip(range(-radius, radius + 1), raw, strict=True)]
    down = " + ".join(f"{w!r}::DOUBLE * {_cell(of, 'q % 8', f'(q // 8 + ({j}))')}" for j, w in taps)
    across = " + ".join(f"{w!r}::DOUBLE * {_cell('half', f'(q % 8 + ({j}))', 'q // 8')}" for j, w in taps)
    return f"{to}_half AS (SELECT *, {_each(down)} AS half FROM {source}), {to} AS (SELECT * EXCLUDE half, {_each(across)} AS {into} FROM {to}_half)"


def unsharp(sigma: float, amount: float, low: float, high: float, offset: float) -> str:
    ease = f"least(greatest((p[q + 1] - {low}) / ({high} - {low})::DOUBLE, 0), 1)"
    value = f"least(greatest(p[q + 1] + (p[q + 1] - b[q + 1]) * {amount}::DOUBLE * ({ease} * {ease} * (3 - 2 * {ease})), 0), 1)"
    return f"WITH {_PLANES.format(offset=offset)}, {blur('p', 'b', 'p0', 'p1', sigma)}, o AS (SELECT capture_id, frame_idx, {_each(value)} AS p FROM p1) {_OUT.format(plane='p', source='o')}"


def wavelet(amounts: list[float], base: float, threshold: float) -> str:
    steps, source = [], "z"
    for i, amount in enumerate(amounts):
        steps.append(blur("rest", "smooth", source, f"w{i}", base * 2**i))
        band = "(rest[q + 1] - smooth[q + 1])"
        kept = f"{amount}::DOUBLE * sign({band}) * greatest(abs({band}) - {threshold * 2 ** (-i / 2)!r}::DOUBLE, 0)"
        steps.append(f"s{i} AS (SELECT capture_id, frame_idx, smooth AS rest, {_each(f'done[q + 1] + {kept}')} AS done FROM w{i})")
        source = f"s{i}"
    start = f"z AS (SELECT capture_id, frame_idx, p AS rest, {_each('0::DOUBLE')} AS done FROM p0)"
    total = f"o AS (SELECT capture_id, frame_idx, {_each('rest[q + 1] + done[q + 1]')} AS p FROM {source})"
    return f"WITH {_PLANES.format(offset=0)}, {start}, {', '.join(steps)}, {total} {_OUT.format(plane='p', source='o')}"


def richardson_lucy(sigma: float, rounds: int, offset: float) -> str:
    steps, source = ["z AS (SELECT *, p AS e FROM p0)"], "z"
    for i in range(rounds):
        steps.append(blur("e", "seen", source, f"a{i}", sigma))
        steps.append(f"b{i} AS (SELECT capture_id, frame_idx, p, e, {_each('p[q + 1] / greatest(seen[q + 1], 1e-6::DOUBLE)')} AS ratio FROM a{i})")
        steps.append(blur("ratio", "back", f"b{i}", f"c{i}", sigma))
        steps.append(f"d{i} AS (SELECT capture_id, frame_idx, p, {_each('least(greatest(e[q + 1] * back[q + 1], 0), 10)')} AS e FROM c{i})")
        source = f"d{i}"
    return f"WITH {_PLANES.format(offset=offset)}, {', '.join(steps)} {_OUT.format(plane='e', source=source)}"


_NEAR = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _box(of: str) -> str:
    return _each("(" + " + ".join(_cell(of, f"(q % 8 + ({dx}))", f"(q // 8 + ({dy}))") for dx, dy in _NEAR) + ") / 9")


def guided(eps: float) -> str:
    return f"""WITH {_PLANES.format(offset=0)}, s AS (SELECT *, {_each("p[q + 1] * p[q + 1]")} AS pp FROM p0), m AS (SELECT *, {_box("p")} AS mean, {_box("pp")} AS square FROM s),
a AS (SELECT *, {_each("greatest(square[q + 1] - mean[q + 1] * mean[q + 1], 0)")} AS var FROM m), c AS (SELECT *, {_each(f"var[q + 1] / (var[q + 1] + {eps}::DOUBLE)")} AS a FROM a),
d AS (SELECT *, {_each("(1 - a[q + 1]) * mean[q + 1]")} AS b FROM c), e AS (SELECT *, {_box("a")} AS am, {_box("b")} AS bm FROM d), o AS (SELECT capture_id, frame_idx, {_each("am[q + 1] * p[q + 1] + bm[q + 1]")} AS p FROM e)
{_OUT.format(plane="p", source="o")}"""


def bilateral(space: float, value: float) -> str:
    def near(dx: int, dy: int) -> tuple[str, str]:
        v = _cell("p", f"(q % 8 + ({dx}))", f"(q // 8 + ({dy}))")
        return v, f"exp({-(dx * dx + dy * dy) / (2 * space**2)!r}::DOUBLE - power({v} - p[q + 1], 2) / {2 * value**2!r}::DOUBLE)"

    parts = [near(dx, dy) for dx, dy in _NEAR]
    mean = f"({' + '.join(f'{v} * {g}' for v, g in parts)}) / ({' + '.join(g for _, g in parts)})"
    return f"WITH {_PLANES.format(offset=0)}, o AS (SELECT capture_id, frame_idx, {_each(mean)} AS p FROM p0) {_OUT.format(plane='p', source='o')}"


def wiener(sigma: float, snr: float, offset: float) -> str:
    """The filter as a circular convolution with its own kernel, a sum of cosines."""
    k = f"exp({-2 * math.pi**2 * sigma**2!r}::DOUBLE * (power(least(u, 8 - u) / 8::DOUBLE, 2) + power(least(w, 8 - w) / 8::DOUBLE, 2)))"
    kernel = f"""k AS (SELECT d, sum(k / (k * k + 1 / {snr}::DOUBLE) * cos(2 * pi() * (u * (d % 8) + w * (d // 8)) / 8)) / 64 AS h FROM (SELECT u, w, {k} AS k FROM range(8) a(u), range(8) b(w)), range(64) c(d) GROUP BY d),
ks AS (SELECT list(h ORDER BY d) AS h FROM k)"""
    value = "list_sum(list_transform(range(64), lambda s: p[s + 1] * h[((q // 8 - s // 8 + 8) % 8) * 8 + (q % 8 - s % 8 + 8) % 8 + 1]))"
    return f"WITH {_PLANES.format(offset=offset)}, {kernel}, o AS (SELECT capture_id, frame_idx, {_each(f'least(greatest({value}, 0), 1)')} AS p FROM p0, ks) {_OUT.format(plane='p', source='o')}"


def fft_bands() -> str:
    """Energies by the transform's own sums, each frequency for itself."""

    def part(f: str) -> str:
        return f"list_sum(list_transform(range(64), lambda q: p[q + 1] * {f}(2 * pi() * (u * (q % 8) + w * (q // 8)) / 8)))"

    return f"""WITH {_PLANES.format(offset=0)}, e AS (SELECT capture_id, frame_idx, sqrt(power(least(u, 8 - u), 2) + power(least(w, 8 - w), 2)) AS r, power({part("cos")}, 2) + power({part("sin")}, 2) AS e FROM p0, range(8) a(u), range(8) b(w) WHERE u + w > 0)
SELECT capture_id, frame_idx, round(coalesce(sum(e) FILTER (r >= 1 AND r < 2), 0) / greatest(sum(e), 1e-30), 6) AS mid, round(coalesce(sum(e) FILTER (r >= 2), 0) / greatest(sum(e), 1e-30), 6) AS high FROM e GROUP BY ALL"""
