"""Counting quotient filters of sorted fingerprints, as bytes.

A fingerprint of ``bits`` bits is split into a quotient (its high bits) and a remainder. A filter keeps one bit for each
quotient that occurs, one bit for each slot that ends its quotient's run, the remainders of all runs in sorted order, and
the counts above one. Slots are dense, since filters are built from sorted input and only merged, never inserted into:
the run of the i-th quotient that occurs ends at the i-th run end. Nothing is lost: items() gives back what was stored.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def build(fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of distinct ascending ``fingerprints`` (uint64, below 2^bits) with their counts (1 at least)."""
    n = len(fingerprints)
    q = min(bits, max(0, n - 1).bit_length())
    rest = bits - q
    quotient = (fingerprints >> U(rest)) if rest < 64 else np.zeros(n, U)
    remainder = fingerprints & U((1 << rest) - 1)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient.astype(np.int64)] = True
    ends = np.ones(n, bool)
    ends[:-1] = quotient[1:] != quotient[:-1]
    many = counts > 1
    width = -(-rest // 8)
    slots = remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    head = np.array([n, q, bits], "<i8")
    return b"".join((head.tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), np.packbits(many).tobytes(), np.ascontiguousarray(slots).tobytes(), counts[many].astype("<i8").tobytes()))


def items(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ascending fingerprints of a filter, and their counts."""
    n, q, bits = (int(x) for x in np.frombuffer(data, "<i8", 3))
    rest, at = bits - q, 24

    def bitmap(size: int) -> np.ndarray:
        nonlocal at
        got = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).view(bool)
        at += -(-size // 8)
        return got

    occupied, ends, many = bitmap(1 << q), bitmap(n), bitmap(n)
    width = -(-rest // 8)
    slots = np.zeros((n, 8), np.uint8)
    slots[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    counts = np.ones(n, np.int64)
    counts[many] = np.frombuffer(data, "<i8", int(many.sum()), at)
    run = np.cumsum(ends) - ends
    quotient = np.flatnonzero(occupied)[run].astype(U)
    remainder = slots.view("<u8").reshape(n).astype(U)
    return (quotient << U(rest) if rest < 64 else quotient) | remainder, counts


def merge(filters: list[bytes], bits: int) -> bytes:
    """One filter that holds the counts of all: their sorted remainders run together, equal ones add up."""
    parts = [items(f) for f in filters]
    values = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U)
    counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")  # runs that are sorted already
    values, counts = values[order], counts[order]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(first)
    return build(values[at], np.add.reduceat(counts, at) if len(at) else counts, bits)
