"""Operators for building training corpora on Spark. Nothing outside this subpackage imports it."""
