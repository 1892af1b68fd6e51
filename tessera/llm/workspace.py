"""Staged tables in the folder that the cluster shares, and names for helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.workspace import Workspace, shared_dir

__all__ = ["Workspace", "shared_dir", "spare_names"]


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, made longer where df has a column of that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
