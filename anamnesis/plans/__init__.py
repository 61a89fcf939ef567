"""Plans that are put together from operators."""
