"""From text to typed plans."""
