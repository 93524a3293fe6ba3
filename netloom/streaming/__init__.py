"""Records into flow rows and summaries as they come."""
