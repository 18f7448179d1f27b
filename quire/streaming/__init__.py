"""Documents that arrive page by page, with Structured Streaming."""
