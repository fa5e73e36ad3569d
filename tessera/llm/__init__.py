"""Training-corpus operators: each module holds one operator and states its defined results."""
