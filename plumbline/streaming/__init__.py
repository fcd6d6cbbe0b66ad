"""Empty: what this engine matches has no streams, watermarks or state."""
