"""SQL of a few turns of the iterative jobs, on frames of 8 by 8 cells: one set of CTEs for each step."""

from __future__ import annotations

from collections.abc import Callable

CELL = "USING (image_id, iy, ix)"
ABSOLUTE = "ab AS (SELECT image_id, iy, ix, abs(v) AS v FROM px)"
#: What spectral.random_phase draws for seed 0.
DRAWS = (
    "d0 AS (SELECT image_id, iy, ix, ((image_id % 2147483647) * 48271 + (iy * 8 + ix) * 69621 + 1) % 2147483647 AS x FROM px), d1 AS (SELECT * REPLACE ((x * x + 48271) % 2147483647 AS x) FROM d0), "
    "d2 AS (SELECT * REPLACE ((x * x + 69621) % 2147483647 AS x) FROM d1), rd AS (SELECT image_id, iy, ix, ((x * x + 16807) % 2147483647)::DOUBLE / 2147483647 AS v FROM d2)"
)
_OUTSIDE = "sum(sqrt(re * re + im * im)) FILTER (masked)"


def random_phase(dft: Callable, magnitudes: str = "mg") -> str:
    """CTE ph: `magnitudes` with the phases of the drawn frames."""
    turned = ", ".join(f"m.v * {f}(atan2(q.im, q.re)) AS {n}" for f, n in (("cos", "re"), ("sin", "im")))
    return f"{DRAWS}, {dft('rd', 'q', -1, 'v', '0')}, ph AS MATERIALIZED (SELECT image_id, iy, ix, {turned} FROM {magnitudes} m JOIN q {CELL})"


def _error(name: str, state: str, masks: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT image_id, count(*) FILTER (masked) AS n_masked, coalesce({_OUTSIDE}, 0) AS total_error, sqrt(coalesce({_OUTSIDE}, 0)) / nullif(count(*) FILTER (masked), 0) AS error FROM {state} JOIN {masks} {CELL} GROUP BY image_id)"


def _step(dft: Callable, at: int, masks: str, takes: str, beta: float) -> str:
    """CTE s<at + 1> from s<at>: a step of the frames in which `takes` holds."""
    new = ", ".join(f"CASE WHEN masked OR s.re < 0 THEN g{p} - {beta} * s.{p} ELSE s.{p} END AS {p}" for p in ("re", "im"))
    scaled = ", ".join(f"t.{p} * s.v / CASE WHEN sqrt(t.re * t.re + t.im * t.im) = 0 THEN 1 ELSE sqrt(t.re * t.re + t.im * t.im) END AS {p}" for p in ("re", "im"))
    chosen = ", ".join(f"CASE WHEN {takes} THEN {a}.{p} ELSE s.{b}{p} END AS {b}{p}" for a, b in ((f"c{at}", "g"), (f"o{at}", "")) for p in ("re", "im"))
    return (
        f"c{at} AS MATERIALIZED (SELECT s.image_id, iy, ix, {new} FROM s{at} s JOIN {masks} {CELL}), {dft(f'c{at}', f't{at}', -1)}, "
        f"m{at} AS MATERIALIZED (SELECT image_id, iy, ix, {scaled} FROM t{at} t JOIN s{at} s {CELL}), {dft(f'm{at}', f'o{at}', 1)}, "
        f"s{at + 1} AS MATERIALIZED (SELECT s.image_id, iy, ix, s.v, {chosen} FROM s{at} s JOIN c{at} {CELL} JOIN o{at} {CELL} JOIN pa USING (image_id) LEFT JOIN w{at} USING (image_id))"
    )


def shrink_wrap(dft: Callable, blurred: Callable, kernel: str, params: str, cycles: int, steps: int, beta: float) -> str:
    """CTEs s<cycle * steps> and e<cycle>, from px, k8 and pa (image_id, n_hio, n_cycles, target, share)."""
    parts = [ABSOLUTE, dft("ab", "f", -1, "v", "0"), "mg AS MATERIALIZED (SELECT image_id, iy, ix, sqrt(re * re + im * im) AS v FROM f)", dft("mg", "g", 1, "v", "0"), kernel, params]
    parts.append(f"s0 AS MATERIALIZED (SELECT image_id, iy, ix, v, re AS gre, im AS gim, re, im FROM mg JOIN g {CELL})")
    at = 0
    for cycle in range(1, cycles + 1):
        parts.append(f"n{cycle} AS MATERIALIZED (SELECT image_id, iy, ix, sqrt(re * re + im * im) AS v FROM s{at})")
        parts.append(f"h{cycle} AS MATERIALIZED ({blurred('ix', f'n{cycle}')}), b{cycle} AS MATERIALIZED ({blurred('iy', f'h{cycle}')})")
        parts.append(f"k{cycle} AS MATERIALIZED (SELECT image_id, iy, ix, t AS threshold, v < t AS masked FROM (SELECT *, share * max(v) OVER (PARTITION BY image_id) AS t FROM b{cycle} JOIN pa USING (image_id)))")
        for step in range(1, steps + 1):
            parts.append(f"w{at} AS (SELECT image_id FROM pa)")
            parts.append(_step(dft, at, f"k{cycle}", f"n_hio >= {step}", beta))
            at += 1
        parts.append(_error(f"e{cycle}", f"s{at}", f"k{cycle}"))
    return ", ".join(parts)


def hybrid(dft: Callable, params: str, masks: str, steps: int, beta: float) -> str:
    """CTEs s<step> and w<step> (image_id, error, whether a further step is due), from px, k8, pa and ma (cells with masked)."""
    parts = [ABSOLUTE, dft("ab", "f", -1, "v", "0"), "mg AS MATERIALIZED (SELECT image_id, iy, ix, sqrt(re * re + im * im) AS v FROM f)", random_phase(dft), dft("ph", "u", 1), params, masks]
    parts.append(f"s0 AS MATERIALIZED (SELECT image_id, iy, ix, v, re AS gre, im AS gim, re, im FROM mg JOIN u {CELL})")
    for at in range(steps + 1):
        before = f" AND w{at - 1}.due" if at else ""
        parts.append(_error(f"e{at}", f"s{at}", "ma"))
        parts.append(f"w{at} AS MATERIALIZED (SELECT image_id, e.error, e.n_masked, e.total_error, coalesce(NOT e.error < target, true) AND n_cycles > {at}{before} AS due FROM e{at} e JOIN pa USING (image_id){f' JOIN w{at - 1} USING (image_id)' if at else ''})")
        if at < steps:
            parts.append(_step(dft, at, "ma", f"w{at}.due", beta))
    return ", ".join(parts)
