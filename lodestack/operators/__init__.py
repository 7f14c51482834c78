"""DataFrame-to-DataFrame operators; every one takes all queries or documents at once."""
