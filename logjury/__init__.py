"""Log normalization, rule evaluation and decisions on Spark DataFrames."""

from logjury.operators import *  # noqa: F403
from logjury.operators import __all__ as _operators
from logjury.session import ensure_checkpoint_dir, prepare
from logjury.sources import *  # noqa: F403
from logjury.sources import __all__ as _sources

__all__ = [*_operators, *_sources, "ensure_checkpoint_dir", "prepare"]
