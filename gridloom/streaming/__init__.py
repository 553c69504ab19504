"""Running reductions over unbounded arrays: monoids make them incremental."""

from gridloom.streaming.reductions import running_reduce, windowed_reduce

__all__ = ["running_reduce", "windowed_reduce"]
