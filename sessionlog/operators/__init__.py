"""DataFrame -> DataFrame operators over the canonical events table."""
