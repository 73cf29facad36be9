"""Column-level helpers built from Spark's own functions."""

from .columns import *  # noqa: F401,F403
