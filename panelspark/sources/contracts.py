"""Column contracts of the input tables and the check applied by every loader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_D, _F, _S = T.DateType(), T.DoubleType(), T.StringType()

ASSETS = T.StructType(
    [
        T.StructField("date", _D),
        T.StructField("barrid", _S),
        T.StructField("ticker", _S),
        T.StructField("price", _F),
        T.StructField("return", _F),
        T.StructField("daily_volume", _F),
        T.StructField("market_cap", _F),
        T.StructField("bid_ask_spread", _F),
        T.StructField("specific_return", _F),
        T.StructField("specific_risk", _F),
        T.StructField("predicted_beta", _F),
        T.StructField("in_universe", T.BooleanType()),
    ]
)

MARKET_DAILY = _schema(
    date=_D,
    permno=T.LongType(),
    cusip=_S,
    ticker=_S,
    primaryexch=_S,
    securitytype=_S,
    ret=_F,
    prc=_F,
    vol=_F,
    shrout=_F,
)

EXPOSURE_KEYS = _schema(date=_D, barrid=_S)

FACTORS = _schema(date=_D, mkt_rf=_F, smb=_F, hml=_F, rmw=_F, cma=_F, rf=_F)

WEIGHTS = _schema(
    date=_D, barrid=_S, weight=_F, signal=_S, gamma=_F, year=T.IntegerType()
)

COVARIANCES = _schema(date=_D, factor_1=_S, factor_2=_S, covariance=_F)


class ContractError(ValueError):
    """A table lacks a column it must have, or stores it with another type."""


def check_contract(df: DataFrame, contract: T.StructType, columns: Sequence[str]) -> None:
    """Metadata-only check that ``columns`` exist in ``df`` with their contract types.

    Columns the contract does not list (extra factor exposures) only have to exist.
    """
    actual = {field.name: field.dataType for field in df.schema.fields}
    expected = {field.name: field.dataType for field in contract.fields}
    for name in columns:
        if name not in actual:
            raise ContractError(f"column {name!r} is missing; found {sorted(actual)}")
        if name in expected and actual[name] != expected[name]:
            raise ContractError(
                f"column {name!r} is {actual[name].simpleString()}, "
                f"expected {expected[name].simpleString()}"
            )
