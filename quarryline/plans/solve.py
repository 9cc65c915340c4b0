"""DuckDB SQL for small least squares: Gauss-Jordan steps and reweighted steps written out, to hold fits against."""

from __future__ import annotations


def gauss_jordan(name: str, src: str, d: int) -> list[str]:
    """CTEs from ``src`` (g, a{i}_{j}, c{i}) to ``name`` (g, b{i}, v{i}): solutions and the diagonal of the inverse."""
    wide = 2 * d + 1
    first = [f"a{i}_{j} AS m{i}_{j}" if j < d else f"c{i} AS m{i}_{j}" if j == d else f"{float(j - d - 1 == i)}::DOUBLE AS m{i}_{j}" for i in range(d) for j in range(wide)]
    out, last = [f"{name}_0 AS MATERIALIZED (SELECT g, {', '.join(first)} FROM {src})"], f"{name}_0"
    for p in range(d):
        cells = [f"m{i}_{j} / m{p}_{p} AS m{i}_{j}" if i == p else f"m{i}_{j} - m{i}_{p} * m{p}_{j} / m{p}_{p} AS m{i}_{j}" for i in range(d) for j in range(wide)]
        out.append(f"{name}_{p + 1} AS MATERIALIZED (SELECT g, {', '.join(cells)} FROM {last})")
        last = f"{name}_{p + 1}"
    picked = [f"m{i}_{d} AS b{i}, m{i}_{d + 1 + i} AS v{i}" for i in range(d)]
    return [*out, f"{name} AS MATERIALIZED (SELECT g, {', '.join(picked)} FROM {last})"]


def glm(source: str, y: str, x: list[str], family: str, by: str = "0", weight: str = "1", steps: int = 9) -> str:
    """The WITH clauses of a fit: ``fit`` (g, b{i}, v{i}, dev), intercept first."""
    d = len(x) + 1
    v = ["1", *[f"x{i}" for i in range(d - 1)]]
    parts = [f"rows_ AS MATERIALIZED (SELECT {by} AS g, ({y})::DOUBLE AS y, ({weight})::DOUBLE AS w, {', '.join(f'({c})::DOUBLE AS x{i}' for i, c in enumerate(x))} FROM ({source}))"]
    poisson = family == "poisson"
    for k in range(steps + 1):
        if k:
            eta = " + ".join(f"b{i} * {c}" for i, c in enumerate(v))
            link = f"SELECT r.*, {eta} AS eta FROM rows_ r JOIN f{k - 1} f ON r.g IS NOT DISTINCT FROM f.g"
            mu = f"SELECT *, {'exp(eta)' if poisson else '1 / (1 + exp(-eta))'} AS mu FROM ({link})"
        else:
            mu = f"SELECT *, {'ln(mu)' if poisson else 'ln(mu / (1 - mu))'} AS eta FROM (SELECT *, {'y + 0.1' if poisson else '(w * y + 0.5) / (w + 1)'} AS mu FROM rows_)"
        dev = "2 * w * (CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - y + mu)" if poisson else "2 * w * (CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END + CASE WHEN y < 1 THEN (1 - y) * ln((1 - y) / (1 - mu)) ELSE 0 END)"
        z = f"SELECT *, w * {'mu' if poisson else 'mu * (1 - mu)'} AS h, eta + (y - mu) / {'mu' if poisson else '(mu * (1 - mu))'} AS z, {dev} AS dv FROM ({mu})"
        sums = [f"sum(h * {v[i]} * {v[j]}) AS a{i}_{j}" for i in range(d) for j in range(d)] + [f"sum(h * {v[i]} * z) AS c{i}" for i in range(d)]
        parts.append(f"s{k} AS MATERIALIZED (SELECT g, {', '.join(sums)}, sum(dv) AS dev FROM ({z}) GROUP BY g)")
        parts += gauss_jordan(f"f{k}", f"s{k}", d)
    return ", ".join([*parts, f"fit AS (SELECT f.*, s.dev FROM f{steps} f JOIN s{steps} s ON f.g IS NOT DISTINCT FROM s.g)"])


def ridge(source: str, y: str, x: list[str], fold: str, regs: list[float]) -> str:
    """The WITH clauses of ridge per fold and penalty: ``scored`` (fold, reg, mse, r2) on the fold of the fit to the others."""
    d = len(x)
    z = [*[f"x{i}" for i in range(d)], "y"]
    pairs = [(i, j) for i in range(d + 1) for j in range(d + 1)]
    sums = ", ".join(["count(*)::DOUBLE AS n", *[f"sum({c}) AS t{i}" for i, c in enumerate(z)], *[f"sum({z[i]} * {z[j]}) AS q{i}_{j}" for i, j in pairs]])
    names = ["n", *[f"t{i}" for i in range(d + 1)], *[f"q{i}_{j}" for i, j in pairs]]
    rest = ", ".join(f"(SELECT sum({c}) FROM k) - {c} AS {c}" for c in names)
    cov = lambda i, j: f"(q{i}_{j} / n - t{i} * t{j} / n / n)"
    cells = ", ".join([*[f"{cov(i, j)}{' + reg' if i == j else ''} AS a{i}_{j}" for i in range(d) for j in range(d)], *[f"{cov(i, d)} AS c{i}" for i in range(d)]])
    guess = " - ".join(["(r.t{0} / r.n)".format(d), *[f"b{i} * r.t{i} / r.n" for i in range(d)]])
    fitted = " + ".join(["a", *[f"b{i} * x{i}" for i in range(d)]])
    return ", ".join([
        f"rows_ AS MATERIALIZED (SELECT {fold} AS fold, ({y})::DOUBLE AS y, {', '.join(f'({c})::DOUBLE AS x{i}' for i, c in enumerate(x))} FROM ({source}))",
        f"k AS MATERIALIZED (SELECT fold, {sums} FROM rows_ GROUP BY 1)",
        f"rest AS MATERIALIZED (SELECT fold, {rest} FROM k)",
        f"sys AS MATERIALIZED (SELECT (fold, reg) AS g, {cells} FROM rest, (SELECT unnest({regs}::DOUBLE[]) AS reg))",
        *gauss_jordan("w", "sys", d),
        f"model AS MATERIALIZED (SELECT w.g[1]::INTEGER AS fold, w.g[2]::DOUBLE AS reg, {guess} AS a, {', '.join(f'b{i}' for i in range(d))} FROM w JOIN rest r ON r.fold = w.g[1])",
        f"scored AS (SELECT fold, reg, avg(pow(y - ({fitted}), 2)) AS mse, 1 - avg(pow(y - ({fitted}), 2)) / var_pop(y) AS r2 FROM rows_ JOIN model USING (fold) GROUP BY fold, reg)",
    ])
