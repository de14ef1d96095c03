"""Reading statements and stores, and writing results."""
