"""Recommendation and pattern mining over rating and basket tables on PySpark.

Every operator is a function from DataFrames to DataFrames.  The long form
``user, item, rating`` is the one representation of a rating matrix, and
``basket, items`` the one representation of a basket table.
"""

from ratingloom.session import release_scratch, session, stage

__all__ = ["release_scratch", "session", "stage"]
