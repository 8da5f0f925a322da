"""Retrieval, memory, learning, episode and policy operators over DataFrames."""
