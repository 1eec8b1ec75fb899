"""Extension: the same operators over streams."""
