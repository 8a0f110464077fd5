"""Scalar column functions (all JVM-side expressions unless stated)."""
