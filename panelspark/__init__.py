"""Cross-sectional panel analytics as Spark jobs."""

from panelspark.operators import *  # noqa: F403
from panelspark.operators import __all__ as __all__
