"""Structured Streaming: apply staged files, gate transactions by commit, read recorded replication frames."""
