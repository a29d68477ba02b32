"""The reference reads bounded inputs only; the one streaming use here is
appending new documents to an existing pair table (merge-with-plus, U2)."""

from wordpair.streaming.incremental import compact, latest_pairs, start_incremental_pairs, update_pairs

__all__ = ["compact", "latest_pairs", "start_incremental_pairs", "update_pairs"]
