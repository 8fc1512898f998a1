"""Typed readers, the star-schema adapters and the result snapshot."""
