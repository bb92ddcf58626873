"""Scalar functions as Column expressions; all of them stay in the JVM."""

from vellumspark.functions.colour import *  # noqa: F403
from vellumspark.functions.samples import *  # noqa: F403
from vellumspark.functions.text import *  # noqa: F403
from vellumspark.functions.values import *  # noqa: F403
