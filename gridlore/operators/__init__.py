"""The analyses, by domain."""
