from wordpair.functions.vec import (
    as_col, dot, sqnorm, norm, vadd, vsub, vscale, cosine, normalize, safe_div,
)

__all__ = ["as_col", "dot", "sqnorm", "norm", "vadd", "vsub", "vscale", "cosine",
           "normalize", "safe_div"]
