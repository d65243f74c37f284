"""Streams into tables."""

from .append import AppendStream, kafka_batches, kafka_messages, kafka_stream, segments

__all__ = ["AppendStream", "kafka_batches", "kafka_messages", "kafka_stream", "segments"]
