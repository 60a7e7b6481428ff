"""Scalar rules of the protocol, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lease: 150 ms less a 10 % drift allowance on either clock, in microseconds.
LEASE_MICROS = 150_000 * 90 // 110
TIMEOUT_LOW_MICROS, TIMEOUT_HIGH_MICROS = 150_000, 300_000
# The header of a durable record.
MAGIC, VERSION = "HLRS", 1


def quorum(n_nodes: Column) -> Column:
    """Smallest majority of a cluster."""
    return F.floor(n_nodes / 2).cast("long") + 1


def up_to_date(candidate_term: Column, candidate_idx: Column, voter_term: Column, voter_idx: Column) -> Column:
    """A later last term wins; with equal terms the log that is at least as long."""
    return F.struct(candidate_term.alias("t"), candidate_idx.alias("i")) >= F.struct(voter_term.alias("t"), voter_idx.alias("i"))


def vote_granted(term: Column, current_term: Column, voted_for: Column, candidate: Column, recent: Column) -> Column:
    """Current term, no other vote in it (a newer term clears the vote), and a recent log."""
    open_vote = F.when(term > current_term, F.lit(True)).otherwise(voted_for.isNull() | (voted_for == candidate))
    return (term >= current_term) & open_vote & recent


def next_index_after_conflict(current: Column, conflict_index: Column, last_of_term: Column) -> Column:
    """One past the leader's last entry of the conflicting term, or the hint; kept within [1, current - 1], and 1 at 1."""
    wanted = F.when(last_of_term > 0, last_of_term + 1).otherwise(conflict_index)
    return F.greatest(F.lit(1).cast("long"), F.least(current - 1, wanted))


def commit_clamp(old: Column, wanted: Column, last: Column) -> Column:
    """Never backwards, never beyond the log."""
    return F.when((wanted <= old) | (wanted > last), old).otherwise(wanted)


def role_name(role: Column) -> Column:
    return F.when(role == 0, "follower").when(role == 1, "candidate").when(role == 2, "leader").otherwise("unknown")


def timeout_micros(node: Column, draw: Column) -> Column:
    """A reproducible draw from [150 ms, 300 ms)."""
    return F.pmod(F.xxhash64(node, draw), F.lit(TIMEOUT_HIGH_MICROS - TIMEOUT_LOW_MICROS)) + TIMEOUT_LOW_MICROS


def encode_put(key: Column, value: Column) -> Column:
    return F.concat_ws("|", F.lit("put"), key.cast("string"), value)


def decode_put(command: Column) -> tuple[Column, Column, Column]:
    """(valid, key, value): exactly three parts, the first of which is put."""
    parts = F.split(command, r"\|")
    valid = F.coalesce((F.size(parts) == 3) & (F.try_element_at(parts, F.lit(1)) == "put"), F.lit(False))
    return valid, F.when(valid, F.try_element_at(parts, F.lit(2))), F.when(valid, F.try_element_at(parts, F.lit(3)))


def trimmed(x: Column, prefix: str = "") -> Column:
    """Without white space at both ends, then without the prefix."""
    x = F.trim(x)
    return F.when(F.startswith(x, F.lit(prefix)), F.substring(x, len(prefix) + 1, 2147483647)).otherwise(x) if prefix else x


def parsed_int(x: Column) -> Column:
    """The whole number that the text is, or null."""
    return F.when(F.trim(x).rlike(r"^[+-]?[0-9]+$"), F.trim(x).try_cast("long"))


def padded(x: Column, width: int) -> Column:
    """Zero-padded, as client and key names are."""
    return F.lpad(x.cast("string"), width, "0")


def _be32(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x), 8, "0"))


def frame(payload: Column, magic: str = MAGIC, version: int = VERSION) -> Column:
    """magic, version, length, CRC-32, payload; integers big-endian."""
    return F.concat(F.encode(F.lit(magic), "UTF-8"), _be32(F.lit(version).cast("long")), _be32(F.length(payload).cast("long")), _be32(F.crc32(payload)), payload)


def frame_fault(blob: Column, magic: str = MAGIC, version: int = VERSION) -> Column:
    """The first of five faults in their order, or null: short, magic, version, length, checksum."""
    number = lambda at: F.conv(F.hex(F.substring(blob, at, 4)), 16, 10).cast("long")
    body = F.substring(blob, 17, 2147483647)
    return (
        F.when(blob.isNull() | (F.length(blob) < 16), "short")
        .when(F.substring(blob, 1, 4) != F.encode(F.lit(magic), "UTF-8"), "magic")
        .when(number(5) != version, "version")
        .when(number(9) != F.length(blob) - 16, "length")
        .when(number(13) != F.crc32(body), "checksum")
    )
