"""Scalar functions of the log's codecs, clocks and packed words, as Column expressions.

Counts of bits work on non-negative numbers; a deadline of 0 means none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG = (1 << 63) - 1


def bit_length(v: Column) -> Column:
    """0 for 0."""
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(v)))


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1).cast("long"))))


def uleb_size(v: Column) -> Column:
    """Bytes of an unsigned number in base-128 groups."""
    return F.greatest(F.lit(1), F.ceil(bit_length(v) / 7)).cast("long")


def next_pow2(v: Column) -> Column:
    """The least power of two that is at least ``v`` (1 for 0 and 1), without floating point."""
    return F.when(v <= 1, F.lit(1).cast("long")).otherwise(_pow2(bit_length(v - 1)))


def earlier(a: Column, b: Column) -> Column:
    """The earlier of two deadlines; also what a child inherits."""
    zero = F.lit(0).cast("long")
    return F.coalesce(F.least(F.nullif(a, zero), F.nullif(b, zero)), zero)


def deadline_after(now: Column, delay: Column) -> Column:
    """now + delay, saturating, and never the value that means none."""
    room = F.lit(MAX_LONG) - now
    at = F.when((delay > 0) & (now > 0) & (delay > room), F.lit(MAX_LONG)).otherwise(now + delay)
    return F.when(at == 0, F.lit(1).cast("long")).otherwise(at)


def expired(deadline: Column, now: Column) -> Column:
    return (deadline != 0) & (deadline <= now)


def remaining(deadline: Column, now: Column) -> Column:
    """Null without a deadline; negative once it has passed."""
    return F.when(deadline != 0, deadline - now)


def remaining_clamped(deadline: Column, now: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), remaining(deadline, now))


def rebase(left: Column, round_trip: Column, now: Column) -> Column:
    """A deadline on the receiver's clock: half of the round trip is taken for the way here."""
    way = F.when(round_trip > 0, F.floor(round_trip / 2)).otherwise(0).cast("long")
    budget = left - way
    return F.when((budget > 0) & (now > 0) & (budget > F.lit(MAX_LONG) - now), F.lit(MAX_LONG)).otherwise(now + budget)


def ticks_ceil(duration: Column, tick: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor((duration + (tick - 1)) / tick).cast("long"))


# Widths of a packed message word, from the low end, and of a packed configuration.
MESSAGE_WORD = (("flags", 12), ("state", 4), ("generation", 48))
CONFIG_WORD = (("budget", 14), ("overflow", 2), ("bound", 24), ("idle", 16), ("log", 3), ("shed", 5))


def pack(fields: dict[str, Column], layout: tuple[tuple[str, int], ...]) -> Column:
    """One 64-bit word; each field is cut to its width."""
    word, at = F.lit(0).cast("long"), 0
    for name, width in layout:
        part = fields[name].cast("long").bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        word = word.bitwiseOR(F.shiftleft(part, at))
        at += width
    return word


def unpack(word: Column, name: str, layout: tuple[tuple[str, int], ...]) -> Column:
    at = 0
    for field, width in layout:
        if field == name:
            return F.shiftrightunsigned(word, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        at += width
    raise ValueError(f"no field {name}")


def xor_distance(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def distance_bucket(d: Column) -> Column:
    """floor(log2(d)) of a distance above 0."""
    return (bit_length(d) - 1).cast("long")


def hex16(v: Column) -> Column:
    return F.lower(F.lpad(F.hex(v), 16, "0"))


def from_hex(text: Column) -> Column:
    """A number of at most 15 hex digits after leading zeros; null for anything else."""
    return F.when(text.rlike("^0?[0-9a-fA-F]{1,15}$|^0[0-9a-fA-F]{15}$"), F.conv(text, 16, 10).cast("long"))


def format_traceparent(trace: Column, span: Column, sampled: Column) -> Column:
    zeros = F.lit("0" * 16)
    return F.concat(F.lit("00-"), zeros, hex16(trace), F.lit("-"), hex16(span), F.lit("-0"), F.when(sampled, "1").otherwise("0"))


def parse_traceparent(text: Column) -> dict[str, Column]:
    """trace, span, sampled; null unless version, separators and digits are right and neither id is all zeros."""
    shape = text.rlike("^(?!ff)[0-9a-fA-F]{2}-[0-9a-fA-F]{32}-[0-9a-fA-F]{16}-[0-9a-fA-F]{2}")
    high, low, span = F.substring(text, 4, 16), F.substring(text, 20, 16), F.substring(text, 37, 16)
    valid = shape & ~F.concat(high, low).rlike("^0+$") & ~span.rlike("^0+$")
    flags = F.conv(F.substring(text, 54, 2), 16, 10).cast("int")
    return {
        "trace": F.when(valid, from_hex(low)),
        "span": F.when(valid, from_hex(span)),
        "sampled": F.when(valid, flags.bitwiseAND(F.lit(1)) == 1),
    }


def log2_bucket(v: Column) -> Column:
    """0 for 0, else the bit length, at most 63."""
    return F.least(F.lit(63), bit_length(v)).cast("long")


def linear_log_bucket(v: Column, buckets: int, shift: int, step: int) -> Column:
    """A linear head, then 2^step equal parts of each octave; the last bucket takes the rest."""
    sub = 1 << step
    octave = bit_length(v) - 1
    width = (octave - step).cast("int")
    part = _shift_right(v - _pow2(octave), width)
    tail = sub + (octave - (shift + step)) * sub + part
    found = F.when(v < (sub << shift), F.shiftright(v, shift)).otherwise(tail)
    return F.least(F.lit(buckets - 1), found).cast("long")


def _pow2(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _shift_right(v: Column, n: Column) -> Column:
    return F.call_function("shiftright", v.cast("long"), n.cast("int"))


def boundaries(buckets: int, shift: int, step: int) -> list[int]:
    """Inclusive upper bounds of ``linear_log_bucket``'s buckets; the last is the largest unsigned number."""
    sub, out = 1 << step, []
    for i in range(buckets):
        if i < sub:
            out.append(((i + 1) << shift) - 1)
        else:
            octave, k = shift + step + (i - sub) // sub, (i - sub) % sub
            width = 1 << (octave - step)
            out.append((1 << octave) + (k + 1) * width - 1)
    return [*out[:-1], (1 << 64) - 1]


#: Buckets, shift and step of the two histograms in use.
LATENCY_NS, MAILBOX_DEPTH = (48, 4, 4), (32, 0, 3)


_SAMPLED = -(1 << 63)


def make_trace_id(seed: Column, sampled: Column) -> Column:
    """A trace's id: the seed's low 63 bits, and the sampling decision on top, made once and carried along."""
    kept = seed.bitwiseAND(F.lit(MAX_LONG))
    return F.when(sampled, kept.bitwiseOR(F.lit(_SAMPLED).cast("long"))).otherwise(kept)


def trace_is_sampled(trace_id: Column) -> Column:
    return trace_id < 0


def trace_correlation(trace_id: Column) -> Column:
    return trace_id.bitwiseAND(F.lit(MAX_LONG))
