"""Column expressions. Everything here stays JVM-side (whole-stage codegen)."""
from .parse import *  # noqa: F401,F403
from .mathx import *  # noqa: F401,F403
