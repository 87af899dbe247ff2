"""The query catalogue, its shared inputs, and the equivalent SQL used to check it."""
