"""Scalar functions: column builders."""
