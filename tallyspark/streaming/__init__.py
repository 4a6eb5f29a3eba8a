"""Tables that are filled by a stream."""
