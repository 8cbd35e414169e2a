"""Operators that prepare text for language-model training.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is there.
"""
