"""Retrieval, answering, index and evaluation operators on DataFrames."""
