"""Jobs a user runs, composed of the operators."""
