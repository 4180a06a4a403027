"""Developer tools: oracle comparison and plan dumps."""
