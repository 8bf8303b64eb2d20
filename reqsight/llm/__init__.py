"""Operators of a training-data pipeline over the ``documents``, ``pages``, ``benchmark`` and ``conversations`` tables."""
