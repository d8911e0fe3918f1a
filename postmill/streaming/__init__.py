"""Structured Streaming jobs: intake, de-duplication, publishing, delayed retry, time-outs, live counts and rates."""
