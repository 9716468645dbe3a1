"""Check SQL: shared pieces in DuckDB's dialect.

Every text here restates, independently of the Spark code, what a working
table or an operator must return.
"""

from __future__ import annotations

SEED = 42


def u(key: str, stream: str, seed: int = SEED) -> str:
    """Keyed uniform draw."""
    text = f"concat_ws('|', CAST({key} AS VARCHAR), '{stream}', '{seed}')"
    return f"(('0x' || substr(md5({text}), 1, 8))::UBIGINT / 4294967296.0)"


def sig(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def f1_of(tp: str, fp: str, fn: str) -> str:
    return f"coalesce(2.0 * {tp} / nullif(2.0 * {tp} + {fp} + {fn}, 0), 0)"


def student_p(t: str, df: int) -> str:
    """Two-sided p of Student's t for a fixed number of degrees, by its finite trigonometric series."""
    th = f"atan(abs({t}) / sqrt({df}.0))"
    series, coef = [], 1.0
    if df % 2 == 0:
        for j in range(df // 2):
            series.append(f"{coef!r}::DOUBLE * pow(cos({th}), {2 * j})")
            coef *= (2 * j + 1) / (2 * j + 2)
        return f"(1 - sin({th}) * ({' + '.join(series)}))"
    for j in range((df - 1) // 2):
        series.append(f"{coef!r}::DOUBLE * pow(cos({th}), {2 * j + 1})")
        coef *= (2 * j + 2) / (2 * j + 3)
    return f"(1 - 2 / pi() * ({th} + sin({th}) * ({' + '.join(series) or '0'})))"


FEATURES = ["a", "n", "s"]

# pool of fixed scorers: name, fill rule, weights of a, n, s, intercept
SCORERS = [
    ("ds_mean", "mean", (1.2, -0.8, 0.5), -0.2),
    ("stacked_zero", "zero", (0.5, 1.0, -1.0), 0.1),
    ("vanilla_half", "half", (-1.0, 0.7, 0.9), 0.0),
]
RATES = [10, 30, 50]
TRIALS = 12


def _score(fill: dict[str, str], w: tuple, b: float) -> str:
    terms = " + ".join(f"({fill[x]}) * {v}" for x, v in zip(FEATURES, w))
    return f"round({sig(f'{b} + {terms}')}, 9)"


def _fill(kind: str, src: str = "", mean: str = "mu.{}") -> dict[str, str]:
    by = {"zero": lambda x: "0.0", "half": lambda x: "0.5", "mean": lambda x: mean.format(x)}
    return {x: f"coalesce({src}{x}, {by[kind](x)})" for x in FEATURES}


_PREDS = " UNION ALL ".join(
    f"SELECT row_id, role, y, {i} AS idx, '{name}' AS model, "
    + ", ".join(f"{e} AS {x}" for x, e in _fill(kind, "cfm.").items())
    + f", {_score(_fill(kind, 'cfm.'), w, b)} AS p FROM cfm, mu WHERE role <> 'train'"
    for i, (name, kind, w, b) in enumerate(SCORERS)
)

_RATE_PREDS = " UNION ALL ".join(
    f"SELECT rate, row_id, y, '{name}' AS model, {_score(_fill(kind), w, b)} AS p "
    f"FROM swept JOIN mur USING (rate)"
    for name, kind, w, b in SCORERS
).replace("mu.", "mur.m_")

CTES: dict[str, tuple[list[str], str]] = {
    "cf": (
        [],
        """SELECT c_custkey AS row_id, c_acctbal AS a, CAST(coalesce(o.n, 0) AS DOUBLE) AS n,
        coalesce(o.s, 0.0) AS s, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s
        FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey""",
    ),
    "lim": (
        ["cf"],
        "SELECT " + ", ".join(f"min({x}) AS lo_{x}, max({x}) AS hi_{x}" for x in FEATURES) + " FROM cf",
    ),
    "cfs": (
        ["cf", "lim"],
        "SELECT row_id, y, " + ", ".join(f"({x} - lo_{x}) / (hi_{x} - lo_{x}) AS {x}" for x in FEATURES)
        + f""", CASE WHEN {u('row_id', 'role')} < 0.2 THEN 'test' WHEN {u('row_id', 'role')} < 0.6 THEN 'val'
        ELSE 'train' END AS role FROM cf, lim""",
    ),
    "cfm": (
        ["cfs"],
        "SELECT row_id, y, role, "
        + ", ".join(f"CASE WHEN {u('row_id', 'cell:' + x)} >= 0.3 THEN {x} END AS {x}" for x in FEATURES)
        + " FROM cfs",
    ),
    "mu": (["cfm"], "SELECT " + ", ".join(f"avg({x}) AS {x}" for x in FEATURES) + " FROM cfm WHERE role = 'train'"),
    "preds": (["cfm", "mu"], _PREDS),
    "swept": (
        ["cfs"],
        "SELECT rate, row_id, y, "
        + ", ".join(f"CASE WHEN {u('row_id', 'cell:' + x)} >= rate / 100.0 THEN {x} END AS {x}" for x in FEATURES)
        + f" FROM cfs, (VALUES {', '.join(f'({r})' for r in RATES)}) r(rate)",
    ),
    "mur": (["swept"], "SELECT rate, " + ", ".join(f"avg({x}) AS m_{x}" for x in FEATURES) + " FROM swept GROUP BY rate"),
    "rate_preds": (["swept", "mur"], _RATE_PREDS),
    "results": (
        ["rate_preds"],
        f"""SELECT rate, row_id % {TRIALS} AS trial, model, 'accuracy' AS metric,
        round(avg(CASE WHEN round_even(p, 0) = y THEN 1.0 ELSE 0.0 END), 6) AS value
        FROM rate_preds GROUP BY ALL
        UNION ALL
        SELECT rate, row_id % {TRIALS}, model, 'f1_score',
        round({f1_of('count(*) FILTER (round_even(p, 0) = 1 AND y = 1)',
                     'count(*) FILTER (round_even(p, 0) = 1 AND y <> 1)',
                     'count(*) FILTER (round_even(p, 0) <> 1 AND y = 1)')}, 6)
        FROM rate_preds GROUP BY ALL""",
    ),
}


def sql(needs: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """WITH clause of the needed tables (and what they need) in front of ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for n in needs:
        visit(n)
    parts = [(n, CTES[n][1]) for n in order] + list(extra or [])
    if not parts:
        return body
    # MATERIALIZED keeps a table that several others read from being computed again
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({t})" for n, t in parts) + "\n" + body
