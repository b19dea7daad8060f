"""Host probe records (syscall and network probes) to runtime events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerspark.functions.containers import (
    cgroup_container_id,
    image_from_environment,
    namespace_from_environment,
)
from fingerspark.functions.fixed import HOST_CONTAINER
from fingerspark.functions.syscalls import dotted_address, protocol_name, syscall_name


def container_of_process(cgroup_lines: DataFrame, keys: tuple[str, ...] = ("hostname", "pid"),
                         line: str = "line", line_no: str = "line_no") -> DataFrame:
    """Per process the id of its first cgroup line that yields one (null when none does)."""
    container = cgroup_container_id(F.col(line))
    # min_by over the numbered lines: a partial aggregate, so a process with very many
    # lines is reduced where its lines are read.
    first = F.min_by("container_id", "ordinal").alias("container_id")
    return (cgroup_lines
            .select(*keys, container.alias("container_id"), F.col(line_no).alias("ordinal"))
            .withColumn("ordinal", F.when(F.col("container_id").isNotNull(), F.col("ordinal")))
            .groupBy(*keys).agg(first))


def with_environment(processes: DataFrame, blob: str = "environ") -> DataFrame:
    """Image and namespace of processes that run in a container, null for the others."""
    inside = F.col("container_id").isNotNull()
    return processes.withColumns({
        "image_name": F.when(inside, image_from_environment(F.col(blob))),
        "namespace": F.when(inside, namespace_from_environment(F.col(blob))),
    }).drop(blob)


def attribute_container(probes: DataFrame, containers_only: bool = True) -> DataFrame:
    """Keep container activity only, or label the rest as the host's."""
    if containers_only:
        return probes.filter(F.coalesce(F.col("container_id"), F.lit("")) != "")
    named = F.nullif(F.col("container_id"), F.lit(""))
    return probes.withColumn("container_id", F.coalesce(named, F.lit(HOST_CONTAINER)))


_CONTEXT = ("event_id", "timestamp", "container_id", "image_name", "namespace", "pid")


def syscall_probe_events(probes: DataFrame) -> DataFrame:
    return probes.select(
        *_CONTEXT,
        "ppid",
        syscall_name("syscall_id").alias("syscall"),
        "syscall_id",
        F.col("comm").alias("process_name"),
        F.lit(None).cast("string").alias("args"),
        "return_value",
        "uid",
        "hostname",
    )


def network_probe_events(probes: DataFrame) -> DataFrame:
    """Every network probe record is an outgoing connection."""
    return probes.select(
        *_CONTEXT,
        F.lit("connect").alias("syscall"),
        F.col("comm").alias("process_name"),
        dotted_address(F.col("daddr")).alias("destination_ip"),
        dotted_address(F.col("saddr")).alias("source_ip"),
        F.col("dport").alias("port"),
        protocol_name(F.col("protocol_code")).alias("protocol"),
        "uid",
        "hostname",
    )


def runtime_events(syscall_probes: DataFrame, network_probes: DataFrame,
                   containers_only: bool = True) -> DataFrame:
    """Both probe feeds as one stream of runtime events."""
    syscalls = syscall_probe_events(attribute_container(syscall_probes, containers_only))
    connections = network_probe_events(attribute_container(network_probes, containers_only))
    return syscalls.unionByName(connections, allowMissingColumns=True)
