"""Interval analytics on Spark: closed ``[start, end]`` ranges in ordinary DataFrames."""

from spanmill.frame import IntervalFrame

__all__ = ["IntervalFrame"]
