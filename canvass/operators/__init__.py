"""Relational, statistical and sampling operators."""
