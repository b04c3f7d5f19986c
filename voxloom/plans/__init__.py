"""Registered queries of the engine and their oracles."""
