"""Column expressions: all built-in Spark functions, so they stay in codegen."""

from .parsing import PY_WHITESPACE, py_strip, int_field, float_field, text_field
from .splits import ts_bucket, hash_bucket, split_label, SPLIT_NAMES
from .vectors import dot, vector_dim
from .metrics import rmse_of

__all__ = [
    "PY_WHITESPACE", "py_strip", "int_field", "float_field", "text_field",
    "ts_bucket", "hash_bucket", "split_label", "SPLIT_NAMES",
    "dot", "vector_dim", "rmse_of",
]
