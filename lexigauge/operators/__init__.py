"""Operators over documents, observations, intervals, tokens, drafts, papers and proofs."""
