"""feedlens: command-feed analytics on Spark."""
