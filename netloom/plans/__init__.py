"""What is asked for, and which tables answer it."""
