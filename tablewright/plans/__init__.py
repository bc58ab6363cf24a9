"""Running a table config end to end: read, transition, commit, report."""

from .strategies import materialize, source_frame

__all__ = ["materialize", "source_frame"]
