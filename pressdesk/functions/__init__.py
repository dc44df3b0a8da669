"""Text column functions and fixed values."""
