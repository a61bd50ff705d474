"""What is described before anything runs: schemas and filters."""
