"""Container identity from cgroup lines and process environments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A container id is 64 hex digits, shown by its first 12.
ID_PATTERN = "[0-9a-f]{64}"
SHORT_ID_LENGTH = 12
IMAGE_VARIABLES = ("IMAGE_NAME", "CONTAINER_IMAGE")
NAMESPACE_VARIABLES = ("NAMESPACE", "POD_NAMESPACE", "K8S_NAMESPACE")


def cgroup_container_id(line: Column) -> Column:
    """Short container id of one cgroup line, null when it names no container.

    Both cgroup generations are ``a:b:path``. The id is the first 64-hex run of the
    rightmost path segment that has one, so one greedy match finds it: the leading
    ``.*`` settles on the last segment, the lazy part on its first run.
    """
    path = F.element_at(F.split(line, ":", 3), -1)
    found = F.regexp_extract(path, f"(?s)^(?:.*/)?[^/]*?({ID_PATTERN})[^/]*(?:/.*)?$", 1)
    return F.nullif(F.substring(found, 1, SHORT_ID_LENGTH), F.lit(""))


def environment_variable(blob: Column, name: str) -> Column:
    """Value of ``name`` in a NUL-separated environment; the last setting wins, '' is null."""
    value = F.regexp_extract(F.concat(F.lit("\0"), blob), f"(?s)^.*\\x00{name}=([^\\x00]*)", 1)
    return F.nullif(value, F.lit(""))


def image_from_environment(blob: Column) -> Column:
    return F.coalesce(*[environment_variable(blob, v) for v in IMAGE_VARIABLES])


def namespace_from_environment(blob: Column) -> Column:
    return F.coalesce(*[environment_variable(blob, v) for v in NAMESPACE_VARIABLES])
