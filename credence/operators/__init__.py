"""Tables, factors, counts, distributions, networks, learning, sampling and inference over DataFrames."""
