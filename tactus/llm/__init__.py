"""Training-data operators: ten single-module operators and their queries.

Nothing outside this package imports it.  Every operator works on DataFrames,
keeps its state in tables of the shared checkpoint folder, and runs its
vectorised parts through Arrow batches (``mapInArrow``).
"""
