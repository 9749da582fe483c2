"""Operators for preparing training corpora at scale.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its
queries only when it can be imported.
"""
