"""Column-level functions (all built-in Spark SQL expressions, JVM-side)."""
from canopy.functions.text import *  # noqa: F401,F403
from canopy.functions.vector import *  # noqa: F401,F403
