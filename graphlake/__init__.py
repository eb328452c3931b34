"""graphlake: graph queries, feature engineering and learning as DataFrame plans."""

from graphlake.session import get_session

__all__ = ["get_session"]
