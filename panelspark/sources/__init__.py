from panelspark.sources.contracts import ContractError, check_contract
from panelspark.sources.layout import LayoutError, clustered_joins, read_panel, write_panel
from panelspark.sources.loaders import (
    load_assets,
    load_covariances,
    load_exposures,
    load_factors,
    load_market_daily,
    read_weights,
)
from panelspark.sources.staging import new_path, release, scope, stage, staging_root
from panelspark.sources.state import StateError, read_state, write_state
from panelspark.sources.writers import write_alphas, write_weights

__all__ = [
    "ContractError",
    "LayoutError",
    "StateError",
    "check_contract",
    "clustered_joins",
    "load_assets",
    "load_covariances",
    "load_exposures",
    "load_factors",
    "load_market_daily",
    "new_path",
    "read_panel",
    "read_state",
    "read_weights",
    "release",
    "scope",
    "stage",
    "staging_root",
    "write_alphas",
    "write_panel",
    "write_state",
    "write_weights",
]
