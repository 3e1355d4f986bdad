"""Catalog resolution on Spark: DataFrame operators that keep a catalog of works up to date."""

from folioframe.session import configure, local_session

__all__ = ["configure", "local_session"]
