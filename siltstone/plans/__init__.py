
from . import functions, relational, sources, streams, udfs, windows

__all__ = ["functions", "relational", "sources", "streams", "udfs", "windows"]
