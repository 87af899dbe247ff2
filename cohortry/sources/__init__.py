"""Reading the seven base tables and writing results."""
