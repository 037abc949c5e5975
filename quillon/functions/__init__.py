"""Special functions and probability distributions."""
