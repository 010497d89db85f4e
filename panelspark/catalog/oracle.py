"""DuckDB statements that compute each query's result independently.

Every statement is a chain of named CTEs over the supplied tables. Where a Spark operator
avoids a window or solves in closed form, the statement here takes the direct route
(windows per date, quantile aggregates, Gauss-Jordan elimination), so agreement is evidence.
"""

from __future__ import annotations

import re

from panelspark.catalog.fixtures import BODIES, DEPENDS, oracle_body

CTES: dict[str, str] = {}

BY_ASSET = "PARTITION BY barrid ORDER BY date"


def log1p(x: str) -> str:
    return f"ln(1e0 + ({x}))"


# Rolling illiquidity ------------------------------------------------------------------

CTES["uni"] = """
SELECT date, barrid, price, daily_volume, "return"/100e0 AS ret, specific_risk/100e0 AS risk,
  predicted_beta AS beta
FROM fx_assets WHERE in_universe"""


def rolling(
    source: str, name: str, rows: int = 22, vol_rows: int | None = None, key: str = "barrid"
) -> None:
    """Register ``name``: the source rows plus ``illiq`` and ``price_lag``."""
    frame = (
        f"PARTITION BY {key} ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW"
    )
    order = f"PARTITION BY {key} ORDER BY date"
    CTES[f"{name}_x"] = f"""
SELECT *, abs(ret)/(daily_volume*price) AS x FROM {source}"""
    CTES[f"{name}_m"] = f"""
SELECT *, CASE WHEN count(x) OVER ({frame}) >= {rows} THEN avg(x) OVER ({frame}) END AS m
FROM {name}_x"""
    scaled = "m*1e7"
    if vol_rows is not None:
        wide = (
            f"PARTITION BY {key} ORDER BY date "
            f"ROWS BETWEEN {vol_rows - 1} PRECEDING AND CURRENT ROW"
        )
        scaled = (
            f"m/(CASE WHEN count(ret) OVER ({wide}) >= {vol_rows} "
            f"THEN stddev_samp(ret) OVER ({wide}) END)*1e7"
        )
    CTES[f"{name}_s"] = f"SELECT *, {log1p(scaled)} AS s FROM {name}_m"
    CTES[name] = f"""
SELECT *, lag(s, 2) OVER ({order}) AS illiq, lag(price, 1) OVER ({order}) AS price_lag
FROM {name}_s"""


NO_POSINF = "{0} IS NOT NULL AND NOT isnan({0}) AND {0} < 'inf'::DOUBLE"
FINITE = "{0} IS NOT NULL AND isfinite({0})"

rolling("uni", "d6")
rolling("uni", "d6v", 66, 66)
CTES["kept"] = f"""
SELECT date, barrid, ret AS r, illiq FROM d6
WHERE price_lag > 5 AND {NO_POSINF.format("illiq")}"""


def ewm() -> None:
    """The exponential mean as a recursion over each asset's rows."""
    CTES["ew_n"] = f"""
SELECT date, barrid, abs(ret)/(daily_volume*price) AS x,
  row_number() OVER ({BY_ASSET}) AS i FROM uni"""
    # Decay 65/67 per row; both recursions restart nowhere, NULL rows only decay.
    CTES["ew"] = """
SELECT date, barrid, i, x, CASE WHEN x IS NULL THEN 0e0 ELSE x END AS num,
  CASE WHEN x IS NULL THEN 0e0 ELSE 1e0 END AS den,
  CASE WHEN x IS NULL THEN 0 ELSE 1 END AS seen
FROM ew_n WHERE i = 1
UNION ALL
SELECT n.date, n.barrid, n.i, n.x,
  e.num*65e0/67e0 + CASE WHEN n.x IS NULL THEN 0e0 ELSE n.x END,
  e.den*65e0/67e0 + CASE WHEN n.x IS NULL THEN 0e0 ELSE 1e0 END,
  e.seen + CASE WHEN n.x IS NULL THEN 0 ELSE 1 END
FROM ew e JOIN ew_n n ON n.barrid = e.barrid AND n.i = e.i + 1"""


ewm()


# Cross-section ------------------------------------------------------------------------


def value_bins(source: str, name: str) -> None:
    """Register ``name``: source rows plus a five-way value bin per date."""
    # Spelled out because the exact form of the interpolation decides on which side of a
    # break two values land that differ in their last bit only.
    cuts = []
    for k in range(1, 5):
        spot = f"({k}e0/5e0*(n - 1))"
        low, high = f"l[CAST(floor({spot}) AS INT) + 1]", f"l[CAST(ceil({spot}) AS INT) + 1]"
        cuts.append(f"{low} + ({high} - {low})*({spot} - floor({spot})) AS q{k}")
    over = " + ".join(f"(illiq > q{k})::INT" for k in range(1, 5))
    CTES[f"{name}_q"] = f"""
SELECT date, {", ".join(cuts)}
FROM (SELECT date, list(illiq ORDER BY illiq) AS l, count(*) AS n FROM {source} GROUP BY date)"""
    CTES[name] = f"""
SELECT s.*, CAST({over} AS VARCHAR) AS bin FROM {source} s JOIN {name}_q USING (date)"""


def series(source: str, name: str, target: bool) -> None:
    """Register ``name``: complete (date, bin, r) rows with the spread."""
    legs = ", ".join(f"avg(r) FILTER (WHERE bin = '{k}') AS b{k}" for k in range(5))
    CTES[f"{name}_w"] = f"SELECT date, {legs} FROM {source} GROUP BY date"
    parts = [f"SELECT date, '{k}' AS bin, b{k} AS r FROM {name}_w" for k in range(5)]
    parts.append(f"SELECT date, 'spread' AS bin, b4 - b0 AS r FROM {name}_w")
    CTES[f"{name}_l"] = "\nUNION ALL ".join(parts)
    scaled = "r/(stddev_samp(r) OVER (PARTITION BY bin)*(sqrt(252e0)/5e-2))"
    CTES[name] = f"SELECT date, bin, {scaled if target else 'r'} AS r FROM {name}_l"


value_bins("kept", "binned")
series("binned", "raw_series", target=False)
series("binned", "ret_series", target=True)


def cumulative(source: str, name: str, keys: str = "bin") -> None:
    CTES[f"{name}_g"] = f"SELECT *, {log1p('r')} AS g FROM {source}"
    part = f"PARTITION BY {keys} " if keys else ""
    CTES[name] = f"""
SELECT *, CASE WHEN g IS NOT NULL THEN
  sum(g) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING)*100e0 END AS c
FROM {name}_g"""


def filled_curve(source: str) -> str:
    """SELECT of one forward-filled column per label."""
    labels = ["0", "1", "2", "3", "4", "spread"]
    wide = ", ".join(f"max(c) FILTER (WHERE bin = '{b}') AS v_{b}" for b in labels)
    filled = ", ".join(
        f"round(last_value(v_{b} IGNORE NULLS) OVER "
        f"(ORDER BY date ROWS UNBOUNDED PRECEDING), 7) + 0e0 AS bin_{b}"
        for b in labels
    )
    return (
        f"SELECT date, {filled} FROM (SELECT date, {wide} FROM {source} GROUP BY date)"
    )


def summary(source: str, key: str, periods: int, digits: int = 8) -> str:
    lead = f"{key}, " if key else ""
    group = f" GROUP BY {key}" if key else ""
    return f"""
SELECT {lead}round(m, {digits}) + 0e0 AS mean_return, round(v, {digits}) + 0e0 AS volatility,
  round(m/v, {digits}) + 0e0 AS sharpe
FROM (SELECT {lead}avg(r)*{periods}e0 AS m, stddev_samp(r)*sqrt({periods}e0) AS v
      FROM {source}{group})"""


cumulative("ret_series", "ret_curve")


# Regression by Gauss-Jordan elimination -----------------------------------------------


def gauss_jordan(source: str, name: str, n: int, width: int, keep: str) -> None:
    """Register ``name``: ``source`` with its a{i}_{j} block reduced to the identity.

    ``a`` has ``n`` rows and ``width`` columns; columns past ``n`` end up as solutions.
    """
    before = source
    for pivot in range(n):
        cells = []
        for i in range(n):
            for j in range(width):
                scaled = f"a{pivot}_{j}/a{pivot}_{pivot}"
                if i == pivot:
                    cells.append(f"{scaled} AS a{i}_{j}")
                else:
                    cells.append(f"a{i}_{j} - a{i}_{pivot}*({scaled}) AS a{i}_{j}")
        after = name if pivot == n - 1 else f"{name}_{pivot}"
        CTES[after] = f"SELECT {keep}, {', '.join(cells)} FROM {before}"
        before = after


def least_squares(source: str, name: str, xs: list[str], key: str) -> None:
    """Register ``name`` (key, variable, coefficient, tstat) for y = r_rf on ``xs``."""
    terms = ["1e0", *xs]
    k = len(terms)
    lead = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    block = [f"sum({terms[i]}*{terms[j]}) AS a{i}_{j}" for i in range(k) for j in range(k)]
    unit = [f"{int(i == j)}e0 AS a{i}_{k + j}" for i in range(k) for j in range(k)]
    right = [f"sum({terms[i]}*r_rf) AS a{i}_{2 * k}" for i in range(k)]
    known = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in [*xs, "r_rf"])
    CTES[f"{name}_a"] = f"""
SELECT {lead}count(*) AS n, {', '.join(block + unit + right)}
FROM {source} WHERE {known} {group}"""
    gauss_jordan(f"{name}_a", f"{name}_i", k, 2 * k + 1, f"{lead}n")
    fitted = " + ".join(f"f.a{i}_{2 * k}*{term}" for i, term in enumerate(terms))
    match = f"s.{key} = f.{key}" if key else "true"
    CTES[f"{name}_r"] = f"""
SELECT {f"s.{key}, " if key else ""}sum((r_rf - ({fitted}))*(r_rf - ({fitted}))) AS rss
FROM {source} s JOIN {name}_i f ON {match} WHERE {known} {f"GROUP BY s.{key}" if key else ""}"""
    rows = [
        f"""SELECT {f"f.{key}, " if key else ""}'{label}' AS variable, a{i}_{2 * k} AS coefficient,
  a{i}_{2 * k}/sqrt(rss/(n - {k})*a{i}_{k + i}) AS tstat
FROM {name}_i f JOIN {name}_r s ON {match}"""
        for i, label in enumerate(["Intercept", *xs])
    ]
    CTES[name] = "\nUNION ALL ".join(rows)


THREE = ["mkt_rf", "smb", "hml"]
FIVE = [*THREE, "rmw", "cma"]
FACTORS = [*FIVE, "rf"]


def regression(source: str, name: str, factors: str = "fx_factors", keys: str = "bin") -> None:
    """Register ``name``: returns with led factors, in percent."""
    lead = ", ".join(f"lead({c}) OVER (ORDER BY date) AS {c}" for c in FACTORS)
    CTES[f"{name}_lead"] = f"SELECT date, {lead} FROM {factors}"
    percent = ", ".join(f"{c}*100e0 AS {c}" for c in FACTORS)
    lead_keys = f"{keys}, " if keys else ""
    CTES[name] = f"""
SELECT date, {lead_keys}r*100e0 AS r, {percent}, (r - rf)*100e0 AS r_rf
FROM {source} LEFT JOIN {name}_lead USING (date) WHERE r IS NOT NULL"""


regression("ret_series", "reg")
least_squares("reg", "fit3", THREE, "bin")
least_squares("reg", "fit5", FIVE, "")


def fit_rows(source: str, key: str) -> str:
    lead = f"{key}, " if key else ""
    return (
        f"SELECT {lead}variable, round(coefficient, 7) + 0e0 AS coefficient, "
        f"round(tstat, 7) + 0e0 AS tstat FROM {source}"
    )


def fit_table(source: str, xs: list[str]) -> str:
    cells = [
        f"round(max({kind}) FILTER (WHERE variable = '{v}'), 7) + 0e0 AS \"{kind}_{v}\""
        for kind in ("coefficient", "tstat")
        for v in ["Intercept", *xs]
    ]
    return f"SELECT bin, {', '.join(cells)} FROM {source} GROUP BY bin"


# Scores, weights and coefficients -----------------------------------------------------


def scored(source: str, name: str, signal: str, condition: str) -> None:
    """Register ``name``: date, barrid, score, alpha, beta, risk."""
    CTES[f"{name}_k"] = f"""
SELECT date, barrid, beta, risk, {signal} AS x FROM {source}
WHERE price_lag > 5 AND {condition} AND risk IS NOT NULL AND beta IS NOT NULL"""
    CTES[f"{name}_z"] = f"""
SELECT *, (x - avg(x) OVER (PARTITION BY date))/
  (CASE WHEN count(*) OVER (PARTITION BY date) > 1 AND NOT bad
        THEN sd ELSE CASE WHEN bad THEN 'nan'::DOUBLE END END) AS score
FROM (SELECT *, stddev_samp(CASE WHEN isfinite(x) THEN x END) OVER (PARTITION BY date) AS sd,
        max((NOT isfinite(x))::INT) OVER (PARTITION BY date) = 1 AS bad FROM {name}_k)"""
    CTES[name] = f"SELECT *, score*0.05e0*risk AS alpha FROM {name}_z"


def mvo(source: str, name: str, gamma: str, invest: bool = True, beta: bool = True) -> None:
    """Register ``name`` (date, barrid, w) from per-date window sums."""
    CTES[f"{name}_u"] = f"""
SELECT date, barrid, alpha, beta, CASE WHEN isfinite(alpha) AND isfinite(beta) AND risk > 0
  THEN 1e0/(risk*risk) END AS p FROM {source}"""
    CTES[f"{name}_s"] = f"""
SELECT *, count(p) OVER d AS n, sum(p) OVER d AS sa, sum(p*beta) OVER d AS sb,
  sum(p*beta*beta) OVER d AS sc, sum(p*alpha) OVER d AS sp, sum(p*alpha*beta) OVER d AS sq
FROM (SELECT date, barrid, p, beta, CASE WHEN p IS NOT NULL THEN alpha END AS alpha FROM {name}_u)
WINDOW d AS (PARTITION BY date)"""
    if invest and beta:
        first, second = "(sc*sp - sb*sq)/(sa*sc - sb*sb)", "(sa*sq - sb*sp)/(sa*sc - sb*sb)"
        sound = "n >= 3 AND sa*sc - sb*sb > sa*sc*1e-12"
    elif invest:
        first, second, sound = "sp/sa", "0e0", "n >= 2"
    elif beta:
        first, second, sound = "0e0", "sq/sc", "n >= 2 AND sc > 0"
    else:
        first, second, sound = "0e0", "0e0", "n >= 1"
    CTES[name] = f"""
SELECT date, barrid, CASE WHEN {sound}
  THEN (alpha - {first} - ({second})*beta)*p/{gamma} END AS w FROM {name}_s"""


scored("d6", "sc", "illiq", FINITE.format("illiq"))
mvo("sc", "w50", "50e0")
mvo("sc", "w6000", "6000e0")
mvo("sc", "w99", "99e0")
mvo("sc", "w10", "10e0")
mvo("sc", "w_beta", "50e0", invest=False)
mvo("sc", "w_invest", "50e0", beta=False)
mvo("sc", "w_free", "50e0", invest=False, beta=False)

CTES["fwd"] = f"""
SELECT date, barrid, lead("return"/100e0) OVER ({BY_ASSET}) AS f
FROM fx_assets WHERE in_universe"""
CTES["stored"] = """
SELECT *, 'illiq' AS signal, 50e0 AS gamma FROM w50
UNION ALL SELECT *, 'liquidity' AS signal, 6000e0 AS gamma FROM w6000"""


def coefficients(source: str, forward: str, name: str, ranked: bool) -> str:
    CTES[f"{name}_p"] = f"""
SELECT date, alpha AS x, f AS y FROM {source} JOIN {forward} USING (date, barrid)
WHERE alpha IS NOT NULL AND f IS NOT NULL"""
    x, y = "x", "y"
    if ranked:
        CTES[f"{name}_o"] = f"""
SELECT date,
  rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1)/2e0 AS rx,
  rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1)/2e0 AS ry
FROM {name}_p"""
        x, y = "rx", "ry"
    body = f"{name}_o" if ranked else f"{name}_p"
    CTES[f"{name}_i"] = f"""
SELECT date, count(*) AS n_assets, CASE WHEN stddev_samp({x})*stddev_samp({y}) <> 0
  THEN covar_samp({x}, {y})/(stddev_samp({x})*stddev_samp({y})) END AS ic
FROM {body} GROUP BY date"""
    last = "ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW"
    return f"""
SELECT date, n_assets, round(ic, 8) + 0e0 AS ic,
  round(CASE WHEN count(ic) OVER ({last}) >= 22 THEN avg(ic) OVER ({last}) END, 8) + 0e0 AS ic_mean,
  round(CASE WHEN ic IS NOT NULL THEN sum(ic) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) END, 8)
    + 0e0 AS ic_cumulative
FROM {name}_i"""


def factor_risk() -> None:
    """Register ``w_factor``: weights under exposures, factor covariances, specific risk."""
    names = ["USSLOWL_EARNQLTY", "USSLOWL_PROFIT", "USSLOWL_VALUE"]
    x = ["x0", "x1", "x2"]
    load = ", ".join(f"coalesce({c}, 0e0) AS x{i}" for i, c in enumerate(names))
    known = " AND ".join(f"{c} IS NOT NULL" for c in names)
    CTES["fr_u"] = f"""
SELECT u.date, u.barrid, u.beta, CASE WHEN {known} THEN u.p END AS p, u.alpha, {load}
FROM (SELECT date, barrid, beta, p, CASE WHEN p IS NOT NULL THEN alpha END AS alpha FROM w50_u) u
LEFT JOIN fx_exposures e ON e.date = u.date AND e.barrid = u.barrid"""
    sides = ["1e0", "beta", "alpha"]
    m = [f"coalesce(sum(p*{x[i]}*{x[j]}), 0) AS m{i}_{j}" for i in range(3) for j in range(3)]
    v = [f"coalesce(sum(p*{x[i]}*{s}), 0) AS v{i}_{t}" for i in range(3) for t, s in enumerate(sides)]
    d = [
        f"coalesce(sum(p*{sides[i]}*{sides[j]}), 0) AS d{i}_{j}" for i in range(3) for j in range(3)
    ]
    CTES["fr_s"] = f"SELECT date, count(p) AS n, {', '.join(m + v + d)} FROM fr_u GROUP BY date"
    f = [
        f"max(covariance) FILTER (WHERE factor_1 = '{names[min(i, j)]}' "
        f"AND factor_2 = '{names[max(i, j)]}')/1e4 AS f{i}_{j}"
        for i in range(3)
        for j in range(3)
    ]
    CTES["fr_f"] = f"SELECT date, {', '.join(f)} FROM fx_covariances GROUP BY date"
    factor_multipliers("fr")
    pull = " + ".join(f"x{i}*(y{i}_2 - l1*y{i}_0 - l2*y{i}_1)" for i in range(3))
    CTES["w_factor"] = f"""
SELECT u.date, u.barrid, (alpha - l1 - l2*beta - ({pull}))*p/50e0 AS w
FROM fr_u u LEFT JOIN fr_l l ON l.date = u.date"""


def factor_multipliers(name: str) -> None:
    """Register ``{name}_l`` with l1, l2 and y, from the sums ``{name}_s`` and matrices ``{name}_f``."""
    system = []
    for i in range(3):
        for j in range(3):
            mf = " + ".join(f"m{i}_{t}*f{t}_{j}" for t in range(3))
            system.append(f"{int(i == j)}e0 + {mf} AS a{i}_{j}")
        system += [f"v{i}_{t} AS a{i}_{3 + t}" for t in range(3)]
    carried = [f"v{i}_{t}" for i in range(3) for t in range(3)]
    carried += [f"d{i}_{t}" for i in range(3) for t in range(3)]
    carried += [f"f{i}_{t}" for i in range(3) for t in range(3)]
    keep = f"date, n, {', '.join(carried)}"
    CTES[f"{name}_a"] = f"SELECT {keep}, {', '.join(system)} FROM {name}_s JOIN {name}_f USING (date)"
    gauss_jordan(f"{name}_a", f"{name}_z", 3, 6, keep)
    y = [
        " + ".join(f"f{i}_{k}*a{k}_{3 + t}" for k in range(3)) + f" AS y{i}_{t}"
        for i in range(3)
        for t in range(3)
    ]
    CTES[f"{name}_y"] = f"SELECT {keep}, {', '.join(y)} FROM {name}_z"

    def inner(s: int, t: int) -> str:
        return f"(d{s}_{t} - (" + " + ".join(f"v{i}_{s}*y{i}_{t}" for i in range(3)) + "))"

    CTES[f"{name}_i"] = f"""
SELECT *, {inner(0, 0)} AS sa, {inner(0, 1)} AS sb, {inner(1, 1)} AS sc, {inner(0, 2)} AS sp,
  {inner(1, 2)} AS sq FROM {name}_y"""
    CTES[f"{name}_l"] = f"""
SELECT *, (sc*sp - sb*sq)/(sa*sc - sb*sb) AS l1, (sa*sq - sb*sp)/(sa*sc - sb*sb) AS l2
FROM {name}_i WHERE n >= 3 AND sa*sc - sb*sb > sa*sc*1e-12"""


factor_risk()


def industry_risk() -> None:
    """Register ``w_industry``: weights under the three styles and sixty industries.

    Every asset has one industry, and industries covary with nothing, so their part of the risk
    is inverted industry by industry; what is left is the solve for three factors.
    """
    CTES["ir_u"] = "SELECT *, CAST(barrid AS INT)%60 AS ind FROM fr_u"
    vectors = {"o": "1e0", "b": "beta", "a": "alpha", "x0": "x0", "x1": "x1", "x2": "x2"}
    sums = ", ".join(f"sum(p*{v}) AS s_{u}" for u, v in vectors.items())
    # The last matrix on or before the date; industries have a variance by number.
    CTES["ir_d"] = """
SELECT d.date, max(m.date) AS found FROM (SELECT DISTINCT date FROM ir_u) d
JOIN (SELECT DISTINCT date FROM fx_covariances_monthly) m ON m.date <= d.date GROUP BY d.date"""
    CTES["ir_g"] = f"SELECT date, ind, {sums} FROM ir_u WHERE p IS NOT NULL GROUP BY date, ind"
    CTES["ir_h"] = """
SELECT g.*, covariance/1e4/(1e0 + covariance/1e4*s_o) AS h
FROM ir_g g JOIN ir_d d USING (date) JOIN fx_covariances_monthly c
  ON c.date = d.found AND c.factor_1 = CONCAT('IND', CAST(ind AS STRING)) AND c.factor_2 = c.factor_1"""

    def product(u: str, v: str, name: str) -> tuple[str, str]:
        left = f"coalesce(sum(p*{vectors[u]}*{vectors[v]}), 0) AS {name}"
        return left, f"coalesce(sum(h*s_{u}*s_{v}), 0) AS {name}"

    x, sides = ["x0", "x1", "x2"], ["o", "b", "a"]
    cells = [product(x[i], x[j], f"m{i}_{j}") for i in range(3) for j in range(3)]
    cells += [product(x[i], s, f"v{i}_{t}") for i in range(3) for t, s in enumerate(sides)]
    cells += [product(sides[i], sides[j], f"d{i}_{j}") for i in range(3) for j in range(3)]
    names = [left.rsplit(" ", 1)[1] for left, _ in cells]
    CTES["ir_p"] = f"SELECT date, count(p) AS n, {', '.join(c[0] for c in cells)} FROM ir_u GROUP BY date"
    CTES["ir_c"] = f"SELECT date, {', '.join(c[1] for c in cells)} FROM ir_h GROUP BY date"
    less = ", ".join(f"p.{c} - c.{c} AS {c}" for c in names)
    CTES["ir_s"] = f"SELECT p.date, p.n, {less} FROM ir_p p JOIN ir_c c USING (date)"
    styles = ["USSLOWL_EARNQLTY", "USSLOWL_PROFIT", "USSLOWL_VALUE"]
    f = [
        f"max(covariance) FILTER (WHERE factor_1 = '{styles[min(i, j)]}' "
        f"AND factor_2 = '{styles[max(i, j)]}')/1e4 AS f{i}_{j}"
        for i in range(3)
        for j in range(3)
    ]
    CTES["ir_f"] = f"""
SELECT d.date, {', '.join(f)} FROM ir_d d JOIN fx_covariances_monthly c ON c.date = d.found GROUP BY d.date"""
    factor_multipliers("ir")
    pulls = [f"(y{i}_2 - l1*y{i}_0 - l2*y{i}_1)" for i in range(3)]
    own = " - ".join(["alpha - l1 - l2*beta", *(f"x{i}*{pulls[i]}" for i in range(3))])
    all_of = " - ".join(["s_a - l1*s_o - l2*s_b", *(f"s_x{i}*{pulls[i]}" for i in range(3))])
    CTES["w_industry"] = f"""
SELECT u.date, u.barrid, (({own}) - h*({all_of}))*p/50e0 AS w
FROM ir_u u LEFT JOIN ir_l l ON l.date = u.date LEFT JOIN ir_h h ON h.date = u.date AND h.ind = u.ind"""


industry_risk()


# Monthly signals ----------------------------------------------------------------------

CTES["mkt_d"] = """
SELECT *, CAST(date_trunc('month', date) AS DATE) AS month, abs(ret)/(vol*abs(prc)) AS x,
  lag(abs(prc)) OVER (PARTITION BY permno ORDER BY date) AS pl
FROM fx_market_daily"""


def monthly_market(daily: str, name: str) -> None:
    CTES[f"{name}_a"] = f"""
SELECT permno, month, avg(x) AS x, coalesce(product(ret + 1e0), 1e0) - 1e0 AS ret,
  last(pl ORDER BY date) AS price_lag, count(*) AS n_days FROM {daily} GROUP BY permno, month"""
    CTES[name] = f"""
SELECT permno, month AS date, lag(x) OVER w AS liquidity, ret, price_lag, n_days,
  lag(n_days) OVER w AS n_days_lag FROM {name}_a WINDOW w AS (PARTITION BY permno ORDER BY month)"""


monthly_market("mkt_d", "d4")


def monthly_panel(source: str, name: str) -> None:
    """Register ``name``: daily rows joined to the lagged monthly aggregate."""
    CTES[f"{name}_p"] = f"""
SELECT *, CAST(date_trunc('month', date) AS DATE) AS month,
  lag(price) OVER ({BY_ASSET}) AS price_lag FROM {source}"""
    CTES[f"{name}_d"] = f"SELECT *, abs(ret)/(daily_volume*price_lag) AS x FROM {name}_p"
    CTES[f"{name}_m"] = f"""
SELECT barrid, month, lag(x) OVER w AS liquidity, lag(n) OVER w AS n_days_lag
FROM (SELECT barrid, month, avg(x) AS x, count(x) AS n FROM {name}_d GROUP BY barrid, month)
WINDOW w AS (PARTITION BY barrid ORDER BY month)"""
    CTES[name] = f"SELECT d.*, m.liquidity, m.n_days_lag FROM {name}_d d LEFT JOIN {name}_m m USING (barrid, month)"


monthly_panel("uni", "d5")


def rank_bins(source: str, name: str) -> None:
    """Register ``name``: ordinal-rank bins from interpolated rank quantiles."""
    CTES[f"{name}_r"] = f"""
SELECT *, row_number() OVER (PARTITION BY date ORDER BY liquidity, permno) AS rk FROM {source}"""
    cuts = ", ".join(f"quantile_cont(rk, {k}e0/5e0) AS q{k}" for k in range(1, 5))
    over = " + ".join(f"(rk > q{k})::INT" for k in range(1, 5))
    CTES[f"{name}_q"] = f"SELECT date, {cuts} FROM {name}_r GROUP BY date"
    CTES[name] = f"""
SELECT s.*, CAST({over} AS VARCHAR) AS bin FROM {name}_r s JOIN {name}_q USING (date)"""


CTES["d4_kept"] = f"""
SELECT *, ret AS r FROM d4 WHERE n_days_lag >= 5 AND {FINITE.format("liquidity")}"""
rank_bins("d4_kept", "d2")


# Studies ------------------------------------------------------------------------------

SPAN = "date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'"
SHORT = "date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'"

CTES["x1_d"] = f"""
SELECT *, CAST(date_trunc('month', date) AS DATE) AS month, abs(ret)/(vol*abs(prc)) AS x,
  lag(abs(prc)) OVER (PARTITION BY permno ORDER BY date) AS pl
FROM fx_market_daily WHERE {SPAN}"""
monthly_market("x1_d", "x1_m")
CTES["x1_kept"] = f"""
SELECT *, ret AS r FROM x1_m WHERE n_days_lag >= 5 AND {FINITE.format("liquidity")}"""
rank_bins("x1_kept", "x1_b")
series("x1_b", "x1_series", target=False)
cumulative("x1_series", "x1_curve")

CTES["x2_src"] = f"""
SELECT date, CAST(permno AS VARCHAR) AS barrid, ret, prc AS price, vol AS daily_volume
FROM fx_market_daily WHERE {SPAN}"""
rolling("x2_src", "x2")
CTES["x2_kept"] = f"""
SELECT date, barrid, ret AS r, illiq FROM x2
WHERE price_lag > 1 AND {NO_POSINF.format("illiq")}"""
value_bins("x2_kept", "x2_b")
series("x2_b", "x2_series", target=True)
cumulative("x2_series", "x2_curve")
CTES["x2p_kept"] = f"""
SELECT date, barrid, ret AS r, illiq FROM x2
WHERE price_lag > 5 AND {NO_POSINF.format("illiq")}"""
value_bins("x2p_kept", "x2p_b")
series("x2p_b", "x2p_series", target=True)
CTES["x_factors"] = f"SELECT * FROM fx_factors WHERE {SPAN}"
regression("x2_series", "x2_reg", "x_factors")
least_squares("x2_reg", "x2_fit", THREE, "bin")


def composite(source: str, name: str, value: str) -> None:
    CTES[name] = f"""
SELECT u.date, u.barrid, u.price, u.ret, e.USSLOWL_EARNQLTY, e.USSLOWL_PROFIT, e.USSLOWL_VALUE,
  lag({value}, 2) OVER (PARTITION BY u.barrid ORDER BY u.date) AS illiq,
  lag(u.price) OVER (PARTITION BY u.barrid ORDER BY u.date) AS price_lag
FROM {source} u LEFT JOIN fx_exposures e ON e.date = u.date AND e.barrid = u.barrid"""


SUM_OF_THREE = "(e.USSLOWL_EARNQLTY + e.USSLOWL_PROFIT + e.USSLOWL_VALUE)/4e0"
composite("uni", "d8", SUM_OF_THREE)
composite("uni", "d8r", "e.USSLOWL_LIQUIDTY*-1e0")
CTES["x3_src"] = f"SELECT * FROM uni WHERE {SPAN}"
composite("x3_src", "x3", SUM_OF_THREE)
CTES["x3_kept"] = f"""
SELECT date, barrid, ret AS r, illiq FROM x3
WHERE price_lag > 5 AND {NO_POSINF.format("illiq")}"""
value_bins("x3_kept", "x3_b")
series("x3_b", "x3_series", target=True)
cumulative("x3_series", "x3_curve")
regression("x3_series", "x3_reg", "x_factors")
least_squares("x3_reg", "x3_fit", FIVE, "bin")

CTES["x4_src"] = f"SELECT * FROM uni WHERE {SPAN}"
rolling("x4_src", "x4")
scored("x4", "x4_sc", "illiq", "illiq IS NOT NULL")
mvo("x4_sc", "x4_w", "50e0")

CTES["x5_src"] = f"""
SELECT date, barrid, price, daily_volume, "return" AS ret, specific_risk AS risk,
  predicted_beta AS beta FROM fx_assets WHERE in_universe AND {SPAN}"""
monthly_panel("x5_src", "x5")
scored("x5", "x5_sc", "liquidity", f"{FINITE.format('liquidity')} AND n_days_lag >= 5")
mvo("x5_sc", "x5_w", "6000e0")
CTES["x5_fwd"] = f"""
SELECT date, barrid, lead(ret) OVER ({BY_ASSET}) AS f FROM x5_src"""

CTES["x_fwd"] = f"""
SELECT date, barrid, lead("return"/100e0) OVER ({BY_ASSET}) AS f
FROM fx_assets WHERE in_universe AND {SPAN}"""
CTES["x6_series"] = """
SELECT date, coalesce(sum(f*w), 0) AS r FROM w50 LEFT JOIN x_fwd USING (date, barrid) GROUP BY date"""
cumulative("x6_series", "x6_curve", "")
regression("x6_series", "x6_reg", "x_factors", "")
least_squares("x6_reg", "x6_fit", FIVE, "")
CTES["x7_series"] = f"""
SELECT date, signal, coalesce(sum(f*w), 0) AS r
FROM (SELECT * FROM stored WHERE {SPAN}) LEFT JOIN x_fwd USING (date, barrid)
GROUP BY date, signal"""
cumulative("x7_series", "x7_curve", "signal")


# Statements ---------------------------------------------------------------------------


def _names(sql: str) -> list[str]:
    return [w for w in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))]


def statement(final: str) -> str:
    """``final`` preceded by exactly the CTEs it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        body = CTES.get(name) or oracle_body(name)
        needs = DEPENDS[name] if name in BODIES else _names(body)
        for need in needs:
            if need != name and (need in CTES or need in BODIES):
                visit(need)
        ordered.append(name)

    for name in _names(final):
        if name in CTES or name in BODIES:
            visit(name)
    chain = ",\n".join(
        f"{name} AS ({CTES.get(name) or oracle_body(name)})" for name in ordered
    )
    return f"WITH RECURSIVE {chain}\n{final}" if chain else final


def r(column: str, digits: int, alias: str | None = None) -> str:
    return f'round({column}, {digits}) + 0e0 AS "{alias or column.strip(chr(34))}"'


def rs(columns: list[str], digits: int = 9) -> str:
    return ", ".join(r(c, digits) for c in columns)


def weights_of(name: str, digits: int = 9) -> str:
    return f"SELECT date, barrid, {r('w', digits, 'weight')} FROM {name}"


def stats_of(kept: str, digits: int = 9) -> str:
    parts = {"mean": "avg(illiq)", "std": "stddev_samp(illiq)", "min": "min(illiq)"}
    parts |= {f"q{q}": f"quantile_cont(illiq, 0.{q})" for q in (25, 50, 75)}
    parts["max"] = "max(illiq)"
    return f"SELECT {', '.join(r(v, digits, k) for k, v in parts.items())} FROM {kept}"


def histogram_of(kept: str) -> str:
    return f"""
SELECT b.bin, {r('lo + (hi - lo)/50*b.bin', 8, 'lo')}, {r('lo + (hi - lo)/50*(b.bin + 1)', 8, 'hi')},
  (SELECT count(*) FROM {kept}
   WHERE least(49, CAST(floor((illiq - lo)*50/(hi - lo)) AS BIGINT)) = b.bin) AS "count"
FROM (SELECT unnest(range(50)) AS bin) b
JOIN (SELECT min(illiq) AS lo, max(illiq) AS hi FROM {kept}) ON true"""


YEAR = "CAST(year(date) AS INTEGER) AS year"


def key_counts(table: str, keys: list[str]) -> str:
    """The key report of one table; no key part of the supplied tables is NULL."""
    names = ", ".join(keys)
    return f"""
SELECT '{table}' AS "table", CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, count(*) AS n_keys,
  CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_null_keys
FROM (SELECT {names}, count(*) AS n FROM {table} GROUP BY {names})"""


def all_statements() -> dict[str, str]:
    """One DuckDB statement per query name."""
    finals = {
        "load_assets": f"""
SELECT date, barrid, ticker, {rs(['price', '"return"', 'specific_risk'], 12)}
FROM fx_assets WHERE in_universe AND {SHORT}""",
        "load_exposures": f"""
SELECT date, barrid, {rs(['USSLOWL_EARNQLTY', 'USSLOWL_PROFIT', 'USSLOWL_VALUE'])}
FROM fx_exposures WHERE {SHORT}""",
        "load_exposures_in_universe": f"""
SELECT e.date, e.barrid, {rs(['USSLOWL_EARNQLTY', 'USSLOWL_PROFIT', 'USSLOWL_VALUE'])}
FROM fx_exposures e JOIN fx_assets a ON a.date = e.date AND a.barrid = e.barrid
WHERE a.in_universe AND e.{SHORT}""",
        "load_market_daily": f"""
SELECT date, permno, cusip, primaryexch, {rs(['ret', 'prc', 'vol', 'shrout'], 12)}
FROM fx_market_daily WHERE {SHORT}""",
        "load_factors": f"SELECT date, {rs(FACTORS)} FROM fx_factors WHERE {SHORT}",
        "write_alphas": f"""
SELECT date, barrid, {r('alpha', 9)}, 'illiq' AS signal, {YEAR} FROM sc""",
        "write_weights": f"""
SELECT date, barrid, {r('w', 9, 'weight')}, {YEAR} FROM w50 WHERE year(date) = 1996
UNION ALL SELECT date, barrid, {r('w', 9, 'weight')}, {YEAR} FROM w10 WHERE year(date) <> 1996""",
        "read_weights": f"""
SELECT date, barrid, {r('w', 10, 'weight')}, 'illiq' AS signal, 50e0 AS gamma, {YEAR}
FROM w50 WHERE {SHORT}
UNION ALL SELECT date, barrid, {r('w', 10, 'weight')}, 'illiq' AS signal, 99e0 AS gamma, {YEAR}
FROM w99 WHERE {SHORT}""",
        "illiq_daily": f"SELECT date, barrid, {r('x', 12, 'illiq')} FROM d6_x",
        "illiq_monthly_market": f"""
SELECT permno, date, {rs(['liquidity', 'ret', 'price_lag'], 10)}, n_days, n_days_lag FROM d4""",
        "illiq_monthly_panel": f"""
SELECT date, barrid, {r('price_lag', 12)}, {r('x', 12, 'raw_liq')}, {r('liquidity', 12)},
  n_days_lag FROM d5""",
        "illiq_rolling": f"SELECT date, barrid, {r('illiq', 9)} FROM d6",
        "illiq_rolling_ewm": f"""
SELECT date, barrid, round(lag(s, 2) OVER ({BY_ASSET}), 8) + 0e0 AS illiq
FROM (SELECT date, barrid,
        CASE WHEN x IS NOT NULL AND seen >= 66 THEN {log1p('num/den*1e7')} END AS s FROM ew)""",
        "illiq_rolling_vol_scaled": f"SELECT date, barrid, {r('illiq', 8)} FROM d6v",
        "vol_scaled_momentum": f"""
SELECT date, barrid, round(lag(v, 21) OVER ({BY_ASSET}), 8) + 0e0 AS vol_scaled_momentum
FROM (SELECT date, barrid, CASE WHEN count(ret) OVER w >= 230
        THEN sum({log1p('ret')}) OVER w / stddev_samp(ret) OVER w END AS v FROM uni
      WINDOW w AS (PARTITION BY barrid ORDER BY date ROWS BETWEEN 229 PRECEDING AND CURRENT ROW))""",
        "composite_exposure_signal": f"""
SELECT date, barrid, {rs(['USSLOWL_EARNQLTY', 'USSLOWL_PROFIT', 'USSLOWL_VALUE', 'illiq'])}
FROM d8""",
        "reversed_exposure_signal": f"SELECT date, barrid, {r('illiq', 9)} FROM d8r",
        "market_cap": f"""
SELECT date, permno, shrout*prc AS market_cap FROM fx_market_daily""",
        "universe_filter": f"""
SELECT date, barrid, {r('beta', 9, 'predicted_beta')}, {r('illiq', 9)} FROM d6 WHERE price_lag > 12
AND {NO_POSINF.format('illiq')} AND risk IS NOT NULL AND beta IS NOT NULL""",
        "exchange_filter": f"""
SELECT date, permno, primaryexch, {r('ret', 9)} FROM fx_market_daily
WHERE primaryexch IN ('N', 'A')""",
        "exposure_values": f"""
SELECT DISTINCT {r('USSLOWL_PROFIT', 9)} FROM fx_exposures
WHERE USSLOWL_PROFIT IS NOT NULL AND USSLOWL_EARNQLTY IS NOT NULL""",
        "quantile_bins": "SELECT date, barrid, bin FROM binned",
        "rank_quantile_bins": "SELECT date, permno, bin FROM d2",
        "zscore_by_date": f"SELECT date, barrid, {r('score', 8)} FROM sc",
        "signal_stats": stats_of("kept"),
        "histogram": histogram_of("kept"),
        "bin_returns": f"""
SELECT date, bin, {r('avg(r)', 9, 'return')} FROM binned GROUP BY date, bin""",
        "spread_returns": f"SELECT date, bin, {r('r', 9, 'return')} FROM raw_series",
        "vol_target": f"SELECT date, bin, {r('r', 9, 'return')} FROM ret_series",
        "cumulative_log_return": f"""
SELECT date, bin, {r('c', 7, 'cumulative_return')} FROM ret_curve""",
        "cumulative_wide_ffill": filled_curve("ret_curve"),
        "performance_summary": summary("ret_series", "bin", 252),
        "performance_summary_overall": summary("ret_series", "", 252),
        "lead_factors": f"SELECT date, {rs(FACTORS)} FROM reg_lead",
        "regression_frame": f"""
SELECT date, bin, {r('r', 9, 'return')}, {rs(FACTORS)}, {r('r_rf', 9, 'return_rf')} FROM reg""",
        "ols_by_group": fit_rows("fit3", "bin"),
        "ols_overall": fit_rows("fit5", ""),
        "regression_table_wide": fit_table("fit3", THREE),
        "alphas": f"""
SELECT date, barrid, {r('alpha', 9)}, {r('beta', 9, 'predicted_beta')},
  {r('risk', 9, 'specific_risk')} FROM sc""",
        "forward_returns": f"SELECT date, barrid, {r('f', 9, 'forward_return')} FROM fwd",
        "forward_returns_known": f"""
SELECT date, barrid, {r('f*100e0', 9, 'forward_return')} FROM fwd WHERE f IS NOT NULL""",
        "information_coefficients": coefficients("sc", "fwd", "ic_rank", True),
        "information_coefficients_pearson": coefficients("sc", "fwd", "ic_value", False),
        "mvo_weights": weights_of("w50"),
        "mvo_weights_zero_beta": weights_of("w_beta"),
        "mvo_weights_zero_investment": weights_of("w_invest"),
        "mvo_weights_unconstrained": weights_of("w_free"),
        "mvo_weights_factor_risk": weights_of("w_factor"),
        "mvo_weights_industry_risk": weights_of("w_industry"),
        "load_covariances": """
SELECT date, factor_1, factor_2, round(covariance, 9) + 0e0 AS covariance FROM fx_covariances_monthly
WHERE date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'""",
        "covariance_report": """
SELECT date, n_factors, n_missing, n_factors = 3 AND e*(p*v - pv*pv) - ep*(ep*v - pv*ev) + ev*(ep*pv - p*ev) > 0
  AND e*p - ep*ep > 0 AND e > 0 AS positive_definite, round(asymmetry, 9) + 0e0 AS asymmetry, asymmetry = 0 AS symmetric
FROM (SELECT date, 3 AS n_factors, 3*2 - count(covariance) AS n_missing, 0e0 AS asymmetry,
  max(covariance) FILTER (WHERE factor_1 LIKE '%EARNQLTY' AND factor_2 LIKE '%EARNQLTY') AS e,
  max(covariance) FILTER (WHERE factor_1 LIKE '%PROFIT' AND factor_2 LIKE '%PROFIT') AS p,
  max(covariance) FILTER (WHERE factor_1 LIKE '%VALUE' AND factor_2 LIKE '%VALUE') AS v,
  max(covariance) FILTER (WHERE factor_1 LIKE '%EARNQLTY' AND factor_2 LIKE '%PROFIT') AS ep,
  max(covariance) FILTER (WHERE factor_1 LIKE '%EARNQLTY' AND factor_2 LIKE '%VALUE') AS ev,
  max(covariance) FILTER (WHERE factor_1 LIKE '%PROFIT' AND factor_2 LIKE '%VALUE') AS pv
  FROM fx_covariances GROUP BY date)""",
        "backtest_by_year": f"""
SELECT date, barrid, {r('w', 9, 'weight')}, 'illiq' AS signal, 50e0 AS gamma, {YEAR} FROM w50""",
        "portfolio_returns": f"""
SELECT date, {r('coalesce(sum(f*w), 0)', 9, 'return')}
FROM w50 LEFT JOIN fwd USING (date, barrid) GROUP BY date""",
        "multi_signal_weights": f"""
SELECT date, barrid, {r('w', 11, 'weight')}, signal FROM stored WHERE {SHORT}""",
        "performance_summary_rounded": summary("ret_series", "bin", 252, 4),
        "study_monthly_quantile": summary("x1_series", "bin", 12),
        "study_monthly_quantile_curve": filled_curve("x1_curve"),
        "study_daily_quantile": summary("x2_series", "bin", 252),
        "study_daily_quantile_regression": fit_table("x2_fit", THREE),
        "study_daily_quantile_stats": stats_of("x2_kept"),
        "study_daily_quantile_histogram": histogram_of("x2_kept"),
        "study_daily_quantile_curve": f"SELECT date, bin, {r('c', 7, 'cumulative_return')} FROM x2_curve",
        "study_daily_quantile_price5": summary("x2p_series", "bin", 252),
        "study_exposure_quantile_stats": stats_of("x3_kept"),
        "study_exposure_quantile_histogram": histogram_of("x3_kept"),
        "study_exposure_quantile_curve": f"SELECT date, bin, {r('c', 7, 'cumulative_return')} FROM x3_curve",
        "study_exposure_quantile": summary("x3_series", "bin", 252),
        "study_exposure_quantile_regression": fit_table("x3_fit", FIVE),
        "key_report": " UNION ALL ".join(
            key_counts(table, keys)
            for table, keys in (
                ("fx_assets", ["date", "barrid"]),
                ("fx_market_daily", ["date", "permno"]),
                ("fx_exposures", ["date", "barrid"]),
                ("fx_factors", ["date"]),
                ("lineitem", ["l_shipdate", "l_suppkey"]),
            )
        ),
        "key_violations": """
SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS asset, count(*) AS n_rows
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
        "study_illiq_backtest": weights_of("x4_w"),
        "study_monthly_illiq_backtest": weights_of("x5_w", 12),
        "extend_illiq_backtest": weights_of("x4_w"),
        "extend_monthly_illiq_backtest": weights_of("x5_w", 12),
        "study_monthly_illiq_backtest_ic": coefficients("x5_sc", "x5_fwd", "x5_ic", True),
        "study_monthly_illiq_backtest_ic_pearson": coefficients("x5_sc", "x5_fwd", "x5_icp", False),
        "study_mvo_report": f"SELECT date, {r('c', 7, 'cumulative_return')} FROM x6_curve",
        "study_mvo_report_summary": summary("x6_series", "", 252),
        "study_mvo_report_regression": fit_rows("x6_fit", ""),
        "study_signal_comparison": summary("x7_series", "signal", 252),
        "study_signal_comparison_curve": f"""
SELECT date, signal, {r('c', 7, 'cumulative_return')} FROM x7_curve""",
    }
    # A layout or a way of solving changes the plan, not the rows.
    for name in ("composite_exposure_signal", "portfolio_returns"):
        finals[f"{name}_bucketed"] = finals[name]
    finals["ols_by_group_qr"] = finals["ols_by_group"]
    finals["multi_signal_weights_by_table"] = finals["multi_signal_weights"]
    finals["refuse_repeats"] = finals["forward_returns"]
    return {name: statement(final) for name, final in finals.items()}
