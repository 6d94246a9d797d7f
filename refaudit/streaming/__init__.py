"""Structured Streaming: audits of arriving documents as an event stream."""
