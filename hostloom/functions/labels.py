"""Class codes as expressions: host role, facility class, slice label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostloom.schema import BLUE, FACILITY_NAMES, GRAY, IGNORED, INACTIVE, RED, UNRESPONSIVE


def is_ghost() -> Column:
    """Sent 0 bytes as source and 0 as destination (on host totals)."""
    return (F.col("source_bytes") == 0) & (F.col("destination_bytes_dst") == 0)


def is_ignored() -> Column:
    """Received nothing in either role (on host totals)."""
    return (F.col("destination_bytes") == 0) & (F.col("source_bytes_dst") == 0)


def is_blue(blue_team: Column) -> Column:
    """Anything but the text ``None``; a missing team is a team too."""
    return ~blue_team.eqNullSafe("None")


def role_code(ghost: Column, ignored: Column, red_team: Column, blue: Column) -> Column:
    """Role 0-4. ``ghost``/``ignored`` are null for a host without traffic, which counts as ignored."""
    code = (
        F.when(ghost, UNRESPONSIVE)
        .when(ignored | ignored.isNull(), IGNORED)
        .when(red_team, RED)
        .when(blue, BLUE)
        .otherwise(GRAY)
    )
    return code.cast("bigint")


def facility_code(role: Column, facility: Column) -> Column:
    """Facility class 0-5: the two silent roles keep their code, then the facility decides."""
    code = F.when(role.isin(UNRESPONSIVE, IGNORED), role)
    for value in (2, 3, 4):
        code = code.when(facility == FACILITY_NAMES[value], value)
    return code.otherwise(5).cast("bigint")


def slice_code_simple(active: Column, role: Column) -> Column:
    return F.when(active, role).otherwise(INACTIVE).cast("bigint")


def slice_code(active: Column, responded: Column, reached: Column, role: Column) -> Column:
    """Slice label: inactive -1, never sent nor replied 0, never reached nor answered 1, else the role."""
    code = (
        F.when(~active, INACTIVE)
        .when(~responded, UNRESPONSIVE)
        .when(~reached, IGNORED)
        .otherwise(role)
    )
    return code.cast("bigint")
