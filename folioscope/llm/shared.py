"""What the operators here share of the library's written tables."""

from folioscope.lineage import BROADCAST_BYTES, having, is_small, written


__all__ = ["BROADCAST_BYTES", "having", "is_small", "written"]
