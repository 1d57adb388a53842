"""Streaming: intentionally empty.

The reference reads finished files and writes finished files; it has no
streams, watermarks, windows over time or state. Every operator here is a
batch DataFrame job, which also runs unchanged on a micro-batch inside
``foreachBatch`` should a caller feed judgements incrementally.
"""
