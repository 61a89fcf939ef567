"""Jobs that run the library's operators over given tables."""
