"""Network flow analytics on Spark: frames, packets, flows and features."""

from .operators import *  # noqa: F401,F403
from .operators import __all__  # noqa: F401
