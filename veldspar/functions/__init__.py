"""Column functions: vectors, matrices, scalars and vector aggregates, all JVM-side."""

from .aggregates import avg_vec, check_widths, max_vec, min_vec, sum_vec, vec_by_position
from .matrix import as_matrix, as_vector, flatten, mat_arith, mat_shape, matmul, matrix_literal, transpose
from .scalar import cast_bool, cast_int, concat_text, div, length, nullif, substr, trim, try_div
from .vector import cosine_sim, distance, dot, l2_norm, normalize, vec_add, vec_scale, vector_literal

__all__ = [
    "as_matrix", "as_vector", "avg_vec", "cast_bool", "cast_int", "check_widths", "concat_text", "cosine_sim", "distance", "div",
    "dot", "flatten", "l2_norm", "length", "mat_arith", "mat_shape", "matmul", "matrix_literal", "max_vec", "min_vec", "normalize",
    "nullif", "substr", "sum_vec", "transpose", "trim", "try_div", "vec_add", "vec_by_position", "vec_scale", "vector_literal",
]
