"""Decisions of recovery and replication, as expressions and small functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def handshake(same_cluster: Column, replica: Column, durable: Column, history: Column, same_hash: Column) -> Column:
    """What a primary does with a replica that has applied `replica`."""
    return (
        F.when(~same_cluster, "cluster mismatch")
        .when(replica > durable, "replica ahead")
        .when(replica < history, "snapshot")
        .when(~same_hash, "history differs")
        .otherwise("stream")
    )


def recovery_base(snapshots: list[tuple[int, bool]], first_lsn: int, contiguous_after) -> int | None:
    """LSN to start replay from: the newest whole snapshot with a contiguous tail, else 0 if the
    log starts at 1 and has no gap, else None (recovery fails)."""
    for lsn, whole in sorted(snapshots, reverse=True):
        if whole and contiguous_after(lsn):
            return lsn
    return 0 if first_lsn <= 1 and contiguous_after(0) else None


def greet(same_cluster: bool, replica: int, durable: int, known: int | None, mark: int) -> str:
    """The same decision for one replica, from the hash that the primary has at its number (None
    if that is reclaimed) and the one it sent."""
    if not same_cluster:
        return "cluster mismatch"
    if replica > durable:
        return "replica ahead"
    if known is None:
        return "snapshot"
    return "stream" if known == mark else "history differs"
