"""DataFrame-to-DataFrame jobs over claims, segments, votes and appearances."""
