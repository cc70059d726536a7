"""Table readers and domain views."""
