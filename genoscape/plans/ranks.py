"""Average ranks of ties within groups, without a task that holds a whole group.

Equal values are counted first, so a value that fills a third of a group is one row. The
distinct values of a group are cut into up to ``BINS`` ranges of equal width between two
outer quantiles; what lies below a range is a running sum over ranges, and only the values of
one range are sorted together. The quantiles decide where work is done, never the result:
the range of a value is a monotone function of it, so ranks are exact."""

from __future__ import annotations

#: Most ranges of a group, and how many distinct values a group may hold for each.
BINS, PER_BIN = 4096, 4096


def _same(keys: list[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} <=> {b}.{k}" for k in keys)


def rank_tables(keys: str, values: tuple[str, ...], source: str, weight: str = "count(*)") -> str:
    """Common table expressions: pairs (keys, values, m) of a source and, for each value column, ranks_<column> (keys, v, r)."""
    by = [k.strip() for k in keys.split(",")]
    parts = [f"pairs AS (SELECT {keys}, {', '.join(f'cast({v} AS double) AS {v}' for v in values)}, {weight} AS m FROM {source} GROUP BY {keys}, {', '.join(values)})"]
    for v in values:
        own = ", ".join(f"t.{k}" for k in by)
        parts += [
            f"tied_{v} AS (SELECT {keys}, {v} AS v, sum(m) AS m FROM pairs GROUP BY {keys}, {v})",
            f"span_{v} AS (SELECT {keys}, percentile_approx(v, array(0.001, 0.999)) AS q, least({BINS}, ceil(count(*) / {PER_BIN})) AS bins FROM tied_{v} GROUP BY {keys})",
            f"""binned_{v} AS (SELECT {own}, t.v, t.m, CASE WHEN s.q[1] > s.q[0] THEN floor(least(s.bins - 1.0D, greatest(0.0D, (t.v - s.q[0]) / (s.q[1] - s.q[0]) * s.bins))) ELSE 0 END AS bin
            FROM tied_{v} AS t JOIN span_{v} AS s ON {_same(by, "t", "s")})""",
            f"below_{v} AS (SELECT {keys}, bin, sum(sum(m)) OVER (PARTITION BY {keys} ORDER BY bin) - sum(m) AS below FROM binned_{v} GROUP BY {keys}, bin)",
            f"""ranks_{v} AS (SELECT {own}, t.v, b.below + sum(t.m) OVER (PARTITION BY {own}, t.bin ORDER BY t.v) - (t.m - 1) / 2.0D AS r
            FROM binned_{v} AS t JOIN below_{v} AS b ON {_same(by, "t", "b")} AND t.bin = b.bin)""",
        ]
    return ",\n    ".join(parts)


def graded(keys: str, source: str, weight: str = "count(*)") -> str:
    """n, pearson, spearman, mse, mae and defined of y and yhat in each group; moments are taken around the group's means, whose rounding must not make a constant vary."""
    by = [k.strip() for k in keys.split(",")]
    own = ", ".join(f"p.{k}" for k in by)

    def moment(a: str, b: str) -> str:
        return f"sum(p.m * ({a}) * ({b}))"

    y, yhat, ry, rp = "p.y - c.my", "p.yhat - c.mp", "ry.r - (c.n + 1) / 2.0D", "rp.r - (c.n + 1) / 2.0D"
    return f"""WITH {rank_tables(keys, ("y", "yhat"), source, weight)},
    centers AS (SELECT {keys}, sum(m) AS n, sum(m * y) / sum(m) AS my, sum(m * yhat) / sum(m) AS mp, max(y) > min(y) AND max(yhat) > min(yhat) AS varied FROM pairs GROUP BY {keys}),
    moments AS (SELECT {own}, max(c.n) AS n, bool_and(c.varied) AS varied, {moment(y, y)} AS yy, {moment(yhat, yhat)} AS pp, {moment(y, yhat)} AS yp, {moment(ry, ry)} AS ryy, {moment(rp, rp)} AS rpp, {moment(ry, rp)} AS ryp,
    sum(p.m * (p.y - p.yhat) * (p.y - p.yhat)) AS se, sum(p.m * abs(p.y - p.yhat)) AS ae FROM pairs AS p JOIN centers AS c ON {_same(by, "p", "c")}
    JOIN ranks_y AS ry ON {_same(by, "p", "ry")} AND p.y = ry.v JOIN ranks_yhat AS rp ON {_same(by, "p", "rp")} AND p.yhat = rp.v GROUP BY {own}),
    judged AS (SELECT *, varied AND sqrt(yy / n) > 1e-12 AND sqrt(pp / n) > 1e-12 AS defined FROM moments)
    SELECT {keys}, n, CASE WHEN defined AND n >= 2 THEN yp / sqrt(yy) / sqrt(pp) ELSE 0.0D END AS pearson, CASE WHEN n >= 2 AND ryy > 0 AND rpp > 0 THEN ryp / sqrt(ryy) / sqrt(rpp) ELSE 0.0D END AS spearman,
    se / n AS mse, ae / n AS mae, defined FROM judged"""


def ranked(keys: str, carry: str, source: str) -> str:
    """The rows of a source with the ranks of y (ry) and yhat (rp)."""
    by = [k.strip() for k in keys.split(",")]
    own = ", ".join(f"p.{k.strip()}" for k in f"{keys}, {carry}".split(","))
    return f"""WITH {rank_tables(keys, ("y", "yhat"), source)}
    SELECT {own}, p.y, p.yhat, ry.r AS ry, rp.r AS rp FROM {source} AS p JOIN ranks_y AS ry ON {_same(by, "p", "ry")} AND p.y = ry.v JOIN ranks_yhat AS rp ON {_same(by, "p", "rp")} AND p.yhat = rp.v"""
