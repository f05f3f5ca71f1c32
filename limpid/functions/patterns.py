"""Regular expressions as users write them, for the engine that runs them."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException

#: A character taken literally, a reference to a named group, or the begin of one.
NAMED = re.compile(r"\\k<(?P<back>[A-Za-z_$][\w$]*)>|\\.|\(\?<(?P<name>[A-Za-z_$][\w$]*)>", re.S)


def pattern(text: str) -> str:
    """text with names of groups that Java takes, which knows letters and digits alone."""
    names: dict[str, str] = {}

    def own(m: re.Match) -> str:
        if name := m["name"] or m["back"]:
            new = names.setdefault(name, name if name.isalnum() and name.isascii() else f"g{len(names)}x{name.encode().hex()}")
            return f"(?<{new}>" if m["name"] else f"\\k<{new}>"
        return m[0]

    return NAMED.sub(own, text)


def groups_of(text: str) -> int | None:
    """How many groups a pattern has; None if it is none. Java says so, as Java runs it."""
    try:
        return SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern(text)).matcher("").groupCount()
    except (IllegalArgumentException, Py4JJavaError):
        return None
