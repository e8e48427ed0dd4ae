"""Operations of a training-data pipeline: filters, deduplication, decontamination, mixing, formatting.

Nothing outside this subpackage imports it. Every operator is a function of DataFrames; the registered
queries are in ``catalog``.
"""
