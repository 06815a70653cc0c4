"""tidemark: customer analytics on PySpark.

Operators take DataFrames, an explicit evaluation time (``as_of``) and one
:class:`~tidemark.config.Config`, and return lazy DataFrames.
"""

from tidemark.config import DEFAULT, Config

__all__ = ["Config", "DEFAULT"]
