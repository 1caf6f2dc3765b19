"""Batch analytics for panels of regularly sampled series, the networks estimated from them, and the tables around them."""
