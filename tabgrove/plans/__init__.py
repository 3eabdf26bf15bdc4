"""The two jobs (train, score) and the queries registered for checking."""
