"""Spark-native word / item co-occurrence, PMI and word-vector diagnostics.

Layout
------
``sources``     readers for token sequences, analogy lines and stage tables
``functions``   Column-level vector helpers (dot, norm, cosine, ...)
``operators``   vocabulary, encoding, window pairs, PMI, SN loss / gradient,
                training, diagnostics, analogies, emissions
``plans``       staged pipeline and the derived fixture tables
``streaming``   incremental pair counts over a stream of new sequences
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Ship the in-task kernels by value: Python workers then need no copy of
# this package on their path (no --py-files step for local or cluster runs).
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from wordpair.session import get_session, ensure_checkpoint_dir  # noqa: E402

__all__ = ["get_session", "ensure_checkpoint_dir"]
