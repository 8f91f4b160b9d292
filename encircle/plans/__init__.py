"""The greedy cover: how the single operators are put together."""
