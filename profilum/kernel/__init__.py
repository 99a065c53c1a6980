"""The scoring kernel: profile models and their recurrences in numpy, without any Spark."""
