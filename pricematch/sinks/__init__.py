"""Table maintenance."""
