"""Scalar functions: state machine, hashes, canonical texts and row mappers."""
