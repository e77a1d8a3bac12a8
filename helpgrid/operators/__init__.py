"""DataFrame operators: indexing, search, prompts, evaluation, knowledge-base growth."""
