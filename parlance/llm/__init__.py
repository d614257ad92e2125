"""Operations of a training-data pipeline: counts, filters, near copies, packing.

Nothing else in the library imports this subpackage.
"""
