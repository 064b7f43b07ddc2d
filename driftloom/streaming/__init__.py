"""Row-wise migrations over Structured Streaming sources."""
