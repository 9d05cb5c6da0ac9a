"""Version order and the copy decision, as column expressions.

Strings are '' and never null where nothing is known; a null time is older than any other. f is where a rule's functions
come from: those of columns, or of one row's plain values (functions.plain).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import col


def moment(ts, f=F) -> Column:
    """ts for comparison: null as the zero time."""
    return f.coalesce(col(ts), f.expr("TIMESTAMP_NTZ '0001-01-01 00:00:00'"))


def order_of(a: Column, b: Column, f=F) -> Column:
    return f.when(a < b, -1).when(a > b, 1).otherwise(0)


def compare_sequencers(a, b, f=F) -> Column:
    """-1, 0 or 1: hexadecimal strings of any length, in either case, the shorter one padded with zeros."""
    a, b = col(a), col(b)
    width = f.greatest(f.length(a), f.length(b))
    pad = lambda x: f.lpad(f.lower(x), width, f.lit("0"))
    return order_of(pad(a), pad(b), f)


def compare_versions(a_seq, a_time, b_seq, b_time, f=F) -> Column:
    """-1, 0 or 1: by sequencers if both sides have one, else by times."""
    both = (col(a_seq) != "") & (col(b_seq) != "")
    return f.when(both, compare_sequencers(a_seq, b_seq, f)).otherwise(order_of(moment(a_time, f), moment(b_time, f), f))


def is_newer(seq, time, version, known_seq, known_time, known_version, f=F) -> Column:
    """Whether a version replaces the known one: newer, or as old with another name."""
    return (
        f.when(col(known_version) == "", col(version) != "")
        .when(col(version) == col(known_version), False)
        .otherwise(compare_versions(seq, time, known_seq, known_time, f) >= 0)
    )


def lease_held(status, claimed_until, now, f=F) -> Column:
    """A lease that ends right now is over."""
    return f.coalesce((col(status) == "copying") & (moment(claimed_until, f) > col(now)), f.lit(False))


def decide(exists, r: str, c: str, now) -> Column:
    """copy, already_synced, stale or busy, for the record columns under prefix r and the candidate's under prefix c."""
    R, C = (lambda name: F.col(r + name)), (lambda name: F.col(c + name))
    synced = F.coalesce(R("synced_version"), F.lit(""))
    older_than_synced = compare_versions(C("sequencer"), C("mtime"), R("synced_sequencer"), R("synced_mtime")) < 0
    older_than_claimed = compare_versions(C("sequencer"), C("mtime"), R("source_sequencer"), R("source_mtime")) < 0
    held = lease_held(R("status"), R("claimed_until"), now)
    return (
        F.when(~col(exists), "copy")
        .when((R("status") != "deleted") & (synced != "") & (synced == C("version")), "already_synced")
        .when((synced != "") & (synced != C("version")) & older_than_synced, "stale")
        .when(held & (R("source_version") != C("version")) & older_than_claimed, "stale")
        .when(held, "busy")
        .otherwise("copy")
    )
