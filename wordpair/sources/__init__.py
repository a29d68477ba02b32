from wordpair.sources.corpus import (
    Tokens, split_tokens, document_tokens, conversation_tokens, event_tokens,
    read_corpus, sequence_tokens, read_table,
)
from wordpair.sources.analogies import read_analogy_lines, parse_analogies
from wordpair.sources.stages import write_stage, load_stage, stage_exists

__all__ = ["Tokens", "split_tokens", "document_tokens", "conversation_tokens",
           "event_tokens", "read_corpus", "sequence_tokens", "read_table",
           "read_analogy_lines", "parse_analogies", "write_stage", "load_stage",
           "stage_exists"]
