"""Derived columns of benchmark tables."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def mkeys_per_second(n: Column, ms: Column) -> Column:
    return n / 1e6 / (ms / 1e3)


def gb_per_second(n: Column, ms: Column, bytes_per_key: int = 12) -> Column:
    return n * bytes_per_key / (ms * 1e6)


def ns_per_key(n: Column, ms: Column) -> Column:
    return ms * 1e6 / n


def variation_percent(stddev: Column, median: Column) -> Column:
    return stddev / median * 100


def gops(mkeys: Column, ops: int = 4) -> Column:
    return mkeys * ops / 1000


def speedup(t_seq: Column, t_par: Column) -> Column:
    return t_seq / t_par


def efficiency(t_seq: Column, t_par: Column, p: Column) -> Column:
    return t_seq / t_par / p


def cost(t: Column, p: Column) -> Column:
    return t * p


def amdahl(p: Column, f) -> Column:
    """Speedup bound for serial fraction f."""
    return F.lit(1.0) / (f + (1 - f) / p)


def serial_fraction(s: Column, p: Column) -> Column:
    """Serial fraction from a measured speedup; null for one worker."""
    return F.when(p > 1, (1 / s - 1 / p) / (1 - 1 / p))


def roofline(intensity: Column, peak: float, bandwidth: float) -> Column:
    return F.least(F.lit(float(peak)), intensity * bandwidth)


def ridge(peak: float, bandwidth: float) -> float:
    return peak / bandwidth


def hockney_startup(ranks: Column, alpha_us: float, volume_mb: float, mb_per_s: float) -> Column:
    return (ranks - 1) * alpha_us / 1e6 + volume_mb / mb_per_s


def hockney_nic(ranks: Column, nodes: int, volume_mb: float, mb_per_s: float) -> Column:
    own = ranks / nodes
    return own * volume_mb * ((ranks - own) / ranks) / mb_per_s


def knuth_probes(alpha: Column) -> Column:
    """Expected probes of a successful search with linear probing."""
    return 0.5 * (1 + 1 / (1 - alpha))


def size_label(n: float) -> str:
    """A count as a power of ten for axis labels."""
    if n <= 0:
        return str(int(n))
    power = int(math.log10(n))
    head = n / 10**power
    if abs(head - round(head)) >= 0.01:
        return f"{n:.0g}"
    return f"$10^{{{power}}}$" if round(head) == 1 else rf"${round(head)}\times10^{{{power}}}$"


def workers_for(n_r: int, n_s: int, most: int, rows_each: int = 8192) -> int:
    """Workers worth starting for two relations of these sizes."""
    return min(max(1, min(n_r, n_s) // rows_each), most)


def block_bounds(n: int, parts: int) -> list[tuple[int, int]]:
    """Proportional split: part t gets [n t / parts, n (t + 1) / parts)."""
    return [(n * t // parts, n * (t + 1) // parts) for t in range(parts)]


def balanced_bounds(n: int, parts: int) -> list[tuple[int, int]]:
    """Split with the remainder spread over the first parts."""
    q, r = divmod(n, parts)
    starts = [q * i + min(i, r) for i in range(parts + 1)]
    return list(zip(starts[:-1], starts[1:]))
