"""Operations for large-scale training-data pipelines.

The subpackage stands alone: nothing else in the library imports it, and its
queries, SQL and operators live in its own modules.
"""
