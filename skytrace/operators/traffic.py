"""Passive traffic queries: who talks to whom, in which protocol, signed or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skytrace.functions.scalars import is_labelled, protocol_version

COMMAND_TYPES = ["COMMAND_LONG", "COMMAND_INT", "MISSION_ITEM", "MISSION_ITEM_INT", "SET_MODE", "PARAM_SET"]


def endpoints(df: DataFrame, is_command: Column | None = None) -> DataFrame:
    """Address pairs with their message counts by type and by telemetry or command."""
    command = is_command if is_command is not None else F.col("mav_packet_type").isin(COMMAND_TYPES)
    return df.groupBy("ip_src", "ip_dst", "mav_packet_type").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(command).alias("commands"),
        F.count_if(~command).alias("telemetry"),
    )


def protocol_fingerprint(df: DataFrame) -> DataFrame:
    """Protocol versions and signing per (sysid, compid)."""
    version = protocol_version("magic")
    return df.groupBy("sysid", "compid").agg(
        F.sort_array(F.collect_set(version)).alias("_versions"),  # at most two values
        F.bool_or(is_labelled("signature")).alias("signed"),
        F.count(F.lit(1)).alias("messages"),
    ).select("sysid", "compid", F.array_join(F.transform("_versions", lambda v: v.cast("string")), ",").alias("versions"), "signed", "messages")
