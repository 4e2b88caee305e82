"""Operators that prepare crawled text as training data.

Nothing outside this subpackage imports it; the driver entry adds its queries only when it is there.
"""
