"""Tables that grow."""
