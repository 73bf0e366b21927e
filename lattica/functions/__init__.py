"""Functions on columns, with the semantics of the typed language where Spark's own differ.

All are built-in expressions, evaluated in the JVM. Collections are array or map columns, or Items (tracked arrays).
"""

from lattica.functions.collections import *  # noqa: F403
from lattica.functions.scalars import *  # noqa: F403
