"""Scalar expressions: pure Column functions, JVM-side."""
