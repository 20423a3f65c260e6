"""Part of the skyloom engine."""
