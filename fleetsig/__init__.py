"""fleetsig: Spark operators for fleets of instruments that log parameter changes."""

from fleetsig.session import build_session, prepare

__all__ = ["build_session", "prepare"]
