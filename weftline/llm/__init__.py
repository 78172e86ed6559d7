"""Operations of a training-data pipeline: one module per operation.

Nothing else in the library imports this subpackage.
"""
