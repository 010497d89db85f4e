"""Window specifications and join helpers shared by the operators.

Two shapes of data occur. A *panel* has one row per (date, asset): one asset's history is
bounded by the calendar, while one date's cross-section has no bound. So per-asset
work may use a window partitioned by asset, and per-date work never uses a window: it is an
aggregate with map-side combine whose result is joined back. A *dated* frame has one row per
date (and per label); it is bounded by the calendar, so windows over it are always small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def asset_window(key: str, date: str = "date") -> WindowSpec:
    """One asset's rows in date order."""
    return Window.partitionBy(key).orderBy(date)


def series_window(series: Sequence[str] = (), date: str = "date") -> WindowSpec:
    """One dated series in date order; only for frames with one row per date and label."""
    return Window.partitionBy(*series).orderBy(date)


def broadcast_dated(df: DataFrame, date: str = "date") -> DataFrame:
    """Broadcast hint for a frame with one row per calendar date.

    The type is the size bound: a DATE has under four million values in total and a century
    of days is 36,525 rows. Keyed by anything else, the frame is returned without a hint and
    the optimizer decides from its measured size.
    """
    if isinstance(df.schema[date].dataType, T.DateType):
        return F.broadcast(df)
    return df


def join_null_safe(
    rows: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL keys meet; the key columns of ``rows`` stay."""
    renamed = other.withColumnsRenamed({c: f"_{c}_other" for c in on})
    same = [rows[c].eqNullSafe(renamed[f"_{c}_other"]) for c in on]
    return rows.join(renamed, same, how).drop(*[f"_{c}_other" for c in on])


def join_dated(
    rows: DataFrame,
    dated: DataFrame,
    how: str = "inner",
    date: str = "date",
    aggregated: bool = True,
) -> DataFrame:
    """Attach per-date values to rows, NULL dates included, without shuffling the rows.

    Only frames the library itself reduced to one row per date are ``aggregated`` and get the
    broadcast hint; a caller's table is left to the optimizer's measured size.
    """
    return join_null_safe(rows, broadcast_dated(dated, date) if aggregated else dated, [date], how)


def long_rolling(
    df: DataFrame, key: str, rows: int, sums: dict[str, str], deviations: dict[str, str]
) -> DataFrame:
    """Rolling sums and sample deviations over long frames, in one sort of each asset's rows.

    A sliding frame is re-aggregated for every row, which at hundreds of rows per frame
    dominates a job. Here spans double: one of 2k rows is a span of k rows and the one that
    ends k rows earlier, and a frame is put together from the spans in the binary digits of
    ``rows``. Every step is a lag in date order, so the rows of a task are sorted once and
    narrow, whatever the frame. Spans merge without cancellation, and a non-finite value
    touches no frame but its own. ``sums`` and ``deviations`` map an output name to its input
    column. Frames that are not full of non-null values give NULL. All steps stay in the one
    shuffle by ``key``.
    """
    order = asset_window(key)
    # A span has a sum per sum, and a mean and a sum of squares around it per deviation.
    parts = [f"{n}_sum" for n in sums] + [f"{n}_{p}" for n in deviations for p in ("avg", "sq")]

    def merged(later: str, n_later: int, earlier: str, n_earlier: int) -> dict[str, Column]:
        """The spans ``later`` and ``earlier`` as one; a missing or NULL row makes it NULL."""
        out = {f"{n}_sum": F.col(f"{later}{n}_sum") + F.col(f"{earlier}{n}_sum") for n in sums}
        total = float(n_later + n_earlier)
        for n in deviations:
            gap = F.col(f"{earlier}{n}_avg") - F.col(f"{later}{n}_avg")
            square = F.col(f"{later}{n}_sq") + F.col(f"{earlier}{n}_sq")
            out[f"{n}_avg"] = F.col(f"{later}{n}_avg") + gap * (n_earlier / total)
            out[f"{n}_sq"] = square + gap * gap * (n_later * n_earlier / total)
        return out

    def named(prefix: str, columns: dict[str, Column]) -> dict[str, Column]:
        return {f"{prefix}{n}": c for n, c in columns.items()}

    def lagged(prefix: str, offset: int) -> dict[str, Column]:
        return named(prefix, {n: F.lag(f"_span{n}", offset).over(order) for n in parts})

    single = {f"{n}_sum": F.col(c).cast("double") for n, c in sums.items()}
    for n, c in deviations.items():
        x = F.col(c).cast("double")
        single |= {f"{n}_avg": x, f"{n}_sq": x - x}  # zero, but NaN where x is not finite
    df = df.withColumns(named("_span", single))
    size, done = 1, 0
    while done < rows:
        taken, grows = bool(rows & size), rows >= 2 * size
        earlier = (lagged("_next", size) if grows else {}) | (lagged("_more", done) if taken and done else {})
        df = df.withColumns(earlier) if earlier else df
        step = named("_span", merged("_span", size, "_next", size)) if grows else {}
        if taken:
            frame = merged("_frame", done, "_more", size) if done else {n: F.col(f"_span{n}") for n in parts}
            step |= named("_frame", frame)
            done += size
        df = df.withColumns(step).drop(*earlier)
        size *= 2

    results = {n: F.col(f"_frame{n}_sum") for n in sums}
    for n in deviations:
        square = F.col(f"_frame{n}_sq")
        # Merging equal means keeps them as they are, so a constant frame has exactly no squares.
        results[n] = F.sqrt(square / float(max(rows - 1, 1)))
    return df.withColumns(results).drop(*[f"{prefix}{n}" for prefix in ("_span", "_frame") for n in parts])
