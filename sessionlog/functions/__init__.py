"""Column expressions (JVM-side; no Python UDFs)."""

from sessionlog.functions.scalar import *  # noqa: F401,F403
