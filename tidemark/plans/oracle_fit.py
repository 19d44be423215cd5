"""A local fit of two L-BFGS steps as SQL, unrolled; for the SQL twins of what trains with it."""

from __future__ import annotations

from tidemark.functions.softmax import TOLERANCE, TRIES

STEPS = 2


def fit(name: str, vectors: str, weights: str) -> list[str]:
    """CTEs ending in ``{name}fit``: ``shard, class, feature, value, delta, loss, rows``.

    ``vectors`` has ``shard, row_id, label, feature, x`` and the intercept as
    feature -1; ``weights`` has ``shard, class, feature, value`` for every group.
    """
    a = name
    parts = [
        f"{a}n AS MATERIALIZED (SELECT shard, COUNT(*) AS n FROM {vectors} WHERE feature = -1 GROUP BY shard)",
        f"""{a}sc AS MATERIALIZED (SELECT shard, feature, CASE WHEN feature = -1 OR n < 2 THEN CAST(1 AS DOUBLE)
            WHEN (q - s * s / n) / (n - 1) > 1e-12 * GREATEST(1.0, q / n) THEN SQRT((q - s * s / n) / (n - 1)) ELSE 0 END AS scale
            FROM (SELECT shard, feature, SUM(x) AS s, SUM(x * x) AS q FROM {vectors} GROUP BY ALL) JOIN {a}n USING (shard))""",
        f"""{a}u AS MATERIALIZED (SELECT shard, row_id, label, feature, x / scale AS x FROM {vectors} JOIN {a}sc USING (shard, feature) WHERE scale > 0)""",
        f"""{a}w0 AS MATERIALIZED (SELECT w.shard, w.class, w.feature, w.value, COALESCE(scale, CASE WHEN n < 2 THEN 1 ELSE 0 END) AS scale,
            w.value * COALESCE(scale, CASE WHEN n < 2 THEN 1 ELSE 0 END) AS p
            FROM {weights} w JOIN {a}n USING (shard) LEFT JOIN {a}sc USING (shard, feature))""",
        f"""{a}z0 AS MATERIALIZED (SELECT shard, row_id, label, class, SUM(x * p) AS z FROM {a}u JOIN {a}w0 USING (shard, feature) GROUP BY ALL)""",
        *_slopes(a, 0, f"{a}w0"),
        f"""{a}l0 AS MATERIALIZED (SELECT shard, SUM(lse - z) / ANY_VALUE(n) AS loss FROM {a}q0 JOIN {a}n USING (shard) WHERE class = label GROUP BY shard)""",
    ]
    for i in range(STEPS):
        parts += _step(a, i)
    last = f"{a}g{STEPS}"
    parts.append(
        f"""{a}fit AS MATERIALIZED (SELECT g.shard, class, feature, value, CASE WHEN scale > 0 THEN p / scale - value ELSE 0 END AS delta,
            loss, n AS rows FROM {last} g JOIN {a}l{STEPS} USING (shard) JOIN {a}n USING (shard))"""
    )
    return parts


def _slopes(a: str, i: int, weights: str) -> list[str]:
    """Chances per row, and the gradient of the mean loss beside the weights."""
    return [
        f"""{a}q{i} AS MATERIALIZED (SELECT *, EXP(z - m) / SUM(EXP(z - m)) OVER (PARTITION BY shard, row_id) AS chance,
            m + LN(SUM(EXP(z - m)) OVER (PARTITION BY shard, row_id)) AS lse
            FROM (SELECT *, MAX(z) OVER (PARTITION BY shard, row_id) AS m FROM {a}z{i}))""",
        f"""{a}g{i} AS MATERIALIZED (SELECT w.*, COALESCE(d, 0) / n AS g FROM {weights} w JOIN {a}n USING (shard) LEFT JOIN
            (SELECT q.shard, class, feature, SUM((chance - CASE WHEN class = q.label THEN 1 ELSE 0 END) * x) AS d
             FROM {a}q{i} q JOIN {a}u USING (shard, row_id) GROUP BY ALL) USING (shard, class, feature))""",
    ]


def _step(a: str, i: int) -> list[str]:
    if i == 0:
        direction = f"{a}d0 AS MATERIALIZED (SELECT shard, class, feature, -g AS d, g, scale FROM {a}g0)"
    else:
        # The inverse Hessian of one remembered step s and turn y; without curvature, or if it points up, steepest descent.
        direction = f"""{a}k{i} AS MATERIALIZED (SELECT shard, SUM(s * y) AS sy, SUM(y * y) AS yy, SUM(s * g) AS sg, SUM(y * g) AS yg FROM {a}g{i} GROUP BY shard),
    {a}c{i} AS MATERIALIZED (SELECT shard, class, feature, g, scale, CASE WHEN sy > 1e-12
            THEN -((g - sg / sy * y) * sy / yy + s * (sg / sy - (yg - sg / sy * yy) * sy / yy / sy)) ELSE -g END AS d
            FROM {a}g{i} JOIN {a}k{i} USING (shard)),
    {a}d{i} AS MATERIALIZED (SELECT shard, class, feature, g, scale, CASE WHEN SUM(d * g) OVER (PARTITION BY shard) >= 0 THEN -g ELSE d END AS d FROM {a}c{i})"""
    first = "1 / SQRT(SUM(d * d))" if i == 0 else "CAST(1 AS DOUBLE)"
    parts = [
        direction,
        f"""{a}r{i} AS MATERIALIZED (SELECT z.shard, z.row_id, z.label, z.class, z.z, dz FROM {a}z{i} z JOIN
            (SELECT shard, row_id, class, SUM(x * d) AS dz FROM {a}u JOIN {a}d{i} USING (shard, feature) GROUP BY ALL) USING (shard, row_id, class))""",
        f"""{a}t{i}_0 AS MATERIALIZED (SELECT shard, loss AS loss0, SUM(d * g) AS slope0, {first} AS len, CAST(0 AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high,
            CAST(NULL AS DOUBLE) AS best, CAST(NULL AS DOUBLE) AS least, SQRT(SUM(g * g)) <= {TOLERANCE} * GREATEST(1.0, ABS(loss)) AS done
            FROM {a}d{i} JOIN {a}l{i} USING (shard) GROUP BY shard, loss)""",
    ]
    for k in range(TRIES):
        parts += _try(a, i, k)
    parts += [
        f"{a}b{i} AS MATERIALIZED (SELECT shard, COALESCE(best, 0) AS len, COALESCE(least, loss0) AS loss FROM {a}t{i}_{TRIES})",
        f"""{a}z{i + 1} AS MATERIALIZED (SELECT r.shard, row_id, label, class, z + len * dz AS z FROM {a}r{i} r JOIN {a}b{i} USING (shard))""",
        f"""{a}w{i + 1} AS MATERIALIZED (SELECT shard, class, feature, o.value, o.scale, o.p + len * d AS p, len * d AS s, o.g AS g_before
            FROM {a}g{i} o JOIN {a}d{i} USING (shard, class, feature) JOIN {a}b{i} USING (shard))""",
        *[p.replace("SELECT w.*,", f"SELECT w.*, COALESCE(d, 0) / n - w.g_before AS y,") for p in _slopes(a, i + 1, f"{a}w{i + 1}")],
        f"{a}l{i + 1} AS MATERIALIZED (SELECT shard, loss FROM {a}b{i})",
    ]
    return parts


def _try(a: str, i: int, k: int) -> list[str]:
    return [
        f"""{a}e{i}_{k} AS MATERIALIZED (SELECT shard, SUM(CASE WHEN class = label THEN lse - u END) / ANY_VALUE(n) AS loss,
            SUM(dz * (EXP(u - lse) - CASE WHEN class = label THEN 1 ELSE 0 END)) / ANY_VALUE(n) AS slope
            FROM (SELECT *, m + LN(SUM(EXP(u - m)) OVER (PARTITION BY shard, row_id)) AS lse FROM
                (SELECT *, MAX(u) OVER (PARTITION BY shard, row_id) AS m FROM
                    (SELECT r.*, r.z + t.len * r.dz AS u FROM {a}r{i} r JOIN {a}t{i}_{k} t USING (shard) WHERE NOT t.done)))
            JOIN {a}n USING (shard) GROUP BY shard)""",
        f"""{a}t{i}_{k + 1} AS MATERIALIZED (SELECT shard, loss0, slope0,
            CASE WHEN done OR fine THEN len WHEN high2 IS NULL THEN len * 1.5 ELSE (low2 + high2) / 2 END AS len, low2 AS low, high2 AS high,
            CASE WHEN fine OR better THEN len ELSE best END AS best, CASE WHEN fine OR better THEN loss ELSE least END AS least, done OR fine AS done
            FROM (SELECT *, CASE WHEN NOT worse AND NOT fine AND slope <= 0 THEN len ELSE low END AS low2,
                    CASE WHEN worse OR (NOT fine AND slope > 0) THEN len ELSE high END AS high2, NOT worse AND (least IS NULL OR loss <= least) AS better
                FROM (SELECT *, NOT worse AND ABS(slope) <= -0.9 * slope0 AS fine
                    FROM (SELECT t.*, e.loss, e.slope, COALESCE(e.loss > loss0 + 1e-4 * len * slope0, TRUE) AS worse
                        FROM {a}t{i}_{k} t LEFT JOIN {a}e{i}_{k} e USING (shard)))))""",
    ]


def minimum(penalty: float, steps: int = 70, momentum: float = 0.6) -> list[str]:
    """CTEs ending in ``best``: objective and dual bound after so many accelerated gradient steps from zero, without line search.

    ``v`` has the rows and ``k`` the keys; intercepts are free of the penalty.
    """
    parts = [
        "n AS MATERIALIZED (SELECT COUNT(*) AS n, (SELECT SUM(x * x) FROM v WHERE feature >= 0) / COUNT(*) AS size FROM v WHERE feature = -1)",
        "m0 AS MATERIALIZED (SELECT class, feature, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS y FROM k)",
    ]
    for i in range(steps):
        parts += _chances(i)
        parts.append(
            f"""m{i + 1} AS MATERIALIZED (SELECT class, feature, p, p + {momentum} * (p - before) AS y FROM
                (SELECT m.class, m.feature, m.p AS before, CASE WHEN m.feature = -1 THEN m.y - COALESCE(g, 0)
                    ELSE m.y - (COALESCE(g, 0) + {penalty} * m.y) / (size + 2 * {penalty}) END AS p
                 FROM m{i} m LEFT JOIN f{i} USING (class, feature), n))"""
        )
    parts += [p.replace("x * y", "x * p") for p in _chances(steps)]
    parts.append(
        f"""best AS (SELECT n AS rows, (SELECT SUM(nll) FROM h{steps} WHERE class = label) / n
                + {penalty} / 2 * (SELECT SUM(p * p) FROM m{steps} WHERE feature >= 0) AS objective,
            (SELECT SUM(-chance * LN(chance)) FROM h{steps}) / n
                - (SELECT SUM(g * g) FROM f{steps} WHERE feature >= 0) / (2 * {penalty}) AS lower_bound FROM n)"""
    )
    return parts


def _chances(i: int) -> list[str]:
    return [
        f"""h{i} AS MATERIALIZED (SELECT row_id, label, class, EXP(z - lse) AS chance, lse - z AS nll FROM
            (SELECT *, m + LN(SUM(EXP(z - m)) OVER (PARTITION BY row_id)) AS lse FROM
                (SELECT *, MAX(z) OVER (PARTITION BY row_id) AS m FROM
                    (SELECT row_id, label, class, SUM(x * y) AS z FROM v JOIN m{i} USING (feature) GROUP BY ALL))))""",
        f"""f{i} AS MATERIALIZED (SELECT class, feature, SUM((chance - CASE WHEN class = h.label THEN 1 ELSE 0 END) * x) / ANY_VALUE(n) AS g
            FROM h{i} h JOIN v USING (row_id), n GROUP BY class, feature)""",
    ]
