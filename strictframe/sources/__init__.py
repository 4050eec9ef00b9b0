"""Tables from files, Arrow data and generators."""
