"""DataFrame-in, DataFrame-out surveillance operators."""
